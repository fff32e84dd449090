"""Risk ranks, composite score, tiers, drivers, screens and sector comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import RISK_DIRECTION, TIERS
from ..session import cut_lineage
from .clean import present, to_long
from .order_stats import mid_rank, mid_rank_pct, peer_medians, sector_mid_pct, with_ranks


def literal_map(values: dict) -> Column:
    """Small fixed dictionary as a map column."""
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])


def tier_of_ranks(below: str = "below", cnt: str = "cnt", n: str = "n") -> Column:
    """Tier of a mid-rank percentile in integers, so cut points are exact."""
    scaled = 100 * mid_rank(below, cnt)
    out = F.lit(TIERS[-1][0])
    for name, _, hi in reversed(TIERS[:-1]):
        out = F.when(scaled < hi * 2 * F.col(n), F.lit(name)).otherwise(out)
    return F.when(F.col(n).isNotNull(), out)


def tier_of_pct(pct: Column) -> Column:
    out = F.lit(TIERS[-1][0])
    for name, _, hi in reversed(TIERS[:-1]):
        out = F.when(pct < hi, F.lit(name)).otherwise(out)
    return F.when(pct.isNotNull(), out)


def feature_ranks(df: DataFrame, by: Sequence[str], entity: str = "entity", cols: Sequence[str] | None = None,
                  direction: dict[str, int] = RISK_DIRECTION) -> DataFrame:
    """Long table ``by, entity, feature, x, risk_pct``: mid-rank percentile flipped where low is risky.

    One pass for all features: the feature name is part of the group key.
    """
    cols = list(cols or present(df))
    long = to_long(df, [*by, entity], cols)
    pct = F.lit(100.0) * mid_rank() / (2 * F.col("n"))
    flip = literal_map({c: direction.get(c, 1) for c in cols})[F.col("feature")]
    return (with_ranks(long, [*by, "feature"], "x")
            .withColumn("risk_pct", F.when(flip == -1, 100 - pct).otherwise(pct))
            .drop("cnt", "below", "n"))


def composite(df: DataFrame, by: Sequence[str], entity: str = "entity", cols: Sequence[str] | None = None,
              direction: dict[str, int] = RISK_DIRECTION, keep_ranks: bool = True) -> DataFrame:
    """``composite_score`` = null-skipping mean of the risk ranks; ranks stay as ``pct_<feature>``.

    The mean is rounded to nine decimals so that equal scores tie whatever the order of summation was.
    """
    cols = list(cols or present(df))
    ranks = feature_ranks(df, by, entity, cols, direction)
    wide = [F.max(F.when(F.col("feature") == c, F.col("risk_pct"))).alias(f"pct_{c}") for c in cols] if keep_ranks else []
    return ranks.groupBy(*by, entity).agg(F.round(F.avg("risk_pct"), 9).alias("composite_score"), *wide)


def score(df: DataFrame, by: Sequence[str], entity: str = "entity", cols: Sequence[str] | None = None,
          direction: dict[str, int] = RISK_DIRECTION, keep_ranks: bool = True) -> DataFrame:
    """Composite score, its percentile in the cross-section and the risk tier."""
    scored = cut_lineage(composite(df, by, entity, cols, direction, keep_ranks))
    return (with_ranks(scored, by, "composite_score")
            .withColumn("score_percentile", F.lit(100.0) * mid_rank() / (2 * F.col("n")))
            .withColumn("risk_tier", tier_of_ranks())
            .drop("cnt", "below", "n"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group in a total order.

    Spark turns the rank filter into a group limit that runs before the exchange, so the shuffle moves at most
    k rows per group and input partition however large a group is.
    """
    return (df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
            .where(F.col(rank) <= k))


def drivers(ranks: DataFrame, by: Sequence[str], entity: str = "entity", k: int = 3) -> DataFrame:
    """The k features with the highest risk rank per entity."""
    rows = ranks.where(F.col("risk_pct").isNotNull())
    return top_k(rows, [*by, entity], [F.col("risk_pct").desc(), F.col("feature")], k)


def safest(ranks: DataFrame, by: Sequence[str], entity: str = "entity", k: int = 3) -> DataFrame:
    """The k features with the lowest risk rank per entity (O3)."""
    rows = ranks.where(F.col("risk_pct").isNotNull())
    return top_k(rows, [*by, entity], [F.col("risk_pct").asc(), F.col("feature")], k)


def driver_text(top: DataFrame, by: Sequence[str], entity: str = "entity", sep: str = "; ") -> DataFrame:
    """``name(98); name(95); …`` per entity (F15); at most k entries each."""
    entry = F.concat("feature", F.lit("("), F.bround("risk_pct", 0).cast("long").cast("string"), F.lit(")"))
    items = F.array_sort(F.collect_list(F.struct("rank", entry.alias("t"))))
    return top.groupBy(*by, entity).agg(F.array_join(F.transform(items, lambda s: s["t"]), sep).alias("drivers"))


def opportunity_screen(df: DataFrame, by: Sequence[str], entity: str = "entity", limit: int = 25) -> DataFrame:
    """Sound balance sheet, clean earnings, crowded short, fallen price (P5).

    The contrarian score ranks among the candidates only; the ``limit`` best per cross-section are the report.
    """
    picks = df.where((F.col("altman_z") > 2) & (F.col("accruals_ratio") > 0.7) &
                     (F.col("short_pct_float") > 8) & (F.col("momentum_90d") < 0))
    picks = mid_rank_pct(picks, by, "short_pct_float", "_short")
    picks = mid_rank_pct(picks, by, "momentum_90d", "_mom")
    picks = picks.withColumn("contrarian", F.round(F.col("_short") - F.col("_mom"), 9)).drop("_short", "_mom")
    return top_k(picks, by, [F.col("contrarian").desc(), F.col(entity)], limit)


def sector_comparison(scores: DataFrame, by: Sequence[str], score_col: str = "composite_score",
                      sector: str = "sector") -> DataFrame:
    """Own score against the median of the sector's other members, with its label."""
    out = peer_medians(scores, [*by, sector], score_col, "sector_median")
    delta = F.col(score_col) - F.col("sector_median")
    text = F.format_string("%+.1f", delta)
    return (out.withColumn("sector_delta", delta)
            .withColumn("sector_label",
                        F.when(delta.isNull(), F.lit("no sector peers in universe"))
                        .when(delta > 0, F.concat(F.lit("riskier than sector ("), text, F.lit(")")))
                        .otherwise(F.concat(F.lit("safer than sector ("), text, F.lit(")")))))


def sector_percentile(scores: DataFrame, by: Sequence[str], score_col: str = "composite_score",
                      sector: str = "sector") -> DataFrame:
    return sector_mid_pct(scores, [*by, sector], score_col, "sector_percentile")
