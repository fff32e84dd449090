"""Report tables composed from scores, ranks and holdings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import expr as X
from . import scoring
from .order_stats import quantiles


def head(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Top rows of a report; each task keeps n rows (O2)."""
    return df.orderBy(*order).limit(n)


def sort_abs(df: DataFrame, col: str, *ties: str) -> DataFrame:
    """Descending absolute value (O1)."""
    return df.orderBy(F.abs(F.col(col)).desc(), *ties)


def search(df: DataFrame, text: str | None, columns: Sequence[str], isin: dict[str, list] | None,
           order: Sequence[Column], page: int, size: int, offset: bool = False) -> DataFrame:
    """Case-insensitive substring over some columns, value filters, order, one page."""
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
        df = df.where(hit)
    for c, values in (isin or {}).items():
        df = df.where(F.col(c).isin(values))
    return df.orderBy(*order).offset(page if offset else page * size).limit(size)


def suggest(df: DataFrame, prefix: str, n: int = 8) -> DataFrame:
    """Candidates whose key starts with, or whose name contains, the text."""
    t = prefix.lower()
    return head(df.where(F.lower("entity").startswith(t) | F.contains(F.lower("name"), F.lit(t))), [F.col("entity")], n)


def sector_distribution(scores: DataFrame, by: Sequence[str], value: str = "composite_score") -> DataFrame:
    """Box statistics of the score per sector (A22), exact quartiles."""
    keys = [*by, "sector"]
    q = quantiles(scores, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return ends.join(q, keys)


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between minimum and maximum."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    slot = F.least(F.floor(F.try_divide(F.col(value) - F.col("_s.lo"), width)), F.lit(bins - 1))      # null when flat
    return (df.where(F.col(value).isNotNull()).withColumn("_s", span)
            .groupBy(F.coalesce(slot, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def headline(scores: DataFrame, holdings: DataFrame, by: Sequence[str], directions: DataFrame | None = None) -> DataFrame:
    """Weighted mean score and count of the top tier among holdings (A24); with ``directions`` also of deteriorating ones."""
    held = scores.join(holdings, "entity").where(F.col("composite_score").isNotNull())
    more = []
    if directions is not None:
        held = held.join(directions.select("entity", "direction"), "entity", "left")
        more = [F.count_if(F.col("direction") == "Deteriorating").alias("n_deteriorating")]
    return held.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("weight") * F.col("composite_score")), F.sum("weight")).alias("weighted_score"),
        F.count_if(F.col("risk_tier") == "Elevated").alias("n_elevated"), F.count(F.lit(1)).alias("n_held"), *more)


def sector_rollup(held: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count and weight of holdings per sector."""
    return held.groupBy(*by, "sector").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def attach_holdings(df: DataFrame, holdings: DataFrame) -> DataFrame:
    """``is_portfolio`` and ``weight`` with default 0."""
    return (df.join(holdings.select("entity", F.col("weight").alias("_w")), "entity", "left")
            .withColumn("is_portfolio", F.col("_w").isNotNull())
            .withColumn("weight", F.coalesce("_w", F.lit(0.0))).drop("_w"))


def holdings_report(holdings: DataFrame, scores: DataFrame, ranks: DataFrame,
                    clusters: DataFrame | None = None, trajectory: DataFrame | None = None) -> DataFrame:
    """One row per holding, also for names outside the universe.

    ``scores`` and ``ranks`` hold one cross-section; ``clusters`` (entity, cluster, style) and ``trajectory``
    (entity, direction, drift) are attached when given.
    """
    by = ["date"]
    peers = (scoring.sector_comparison(scores, by)
             .select("entity", "sector_median", "sector_delta", "sector_label"))
    text = scoring.driver_text(scoring.drivers(ranks.join(holdings, "entity", "left_semi"), by), by)
    out = (holdings.join(scores, "entity", "left")
           .join(text.select("entity", "drivers"), "entity", "left")
           .join(peers, "entity", "left")
           .withColumn("status", F.when(F.col("composite_score").isNull(), "NOT_IN_UNIVERSE").otherwise("OK"))
           .withColumn("combined_display", X.combined_label("risk_tier", "score_percentile")))
    if clusters is not None:
        out = out.join(clusters, "entity", "left").withColumn("style", F.coalesce("style", F.lit("?")))
    if trajectory is not None:
        out = out.join(trajectory, "entity", "left").withColumn("direction", F.coalesce("direction", F.lit("Unknown")))
    return out


def top_sectors(members: DataFrame, k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent sectors per cluster as text."""
    counts = members.groupBy(*by, "cluster", "sector").agg(F.count(F.lit(1)).alias("n"))
    top = scoring.top_k(counts, [*by, "cluster"], [F.col("n").desc(), F.col("sector")], k)
    items = F.array_sort(F.collect_list(F.struct("rank", "sector")))
    return top.groupBy(*by, "cluster").agg(F.array_join(F.transform(items, lambda s: s["sector"]), ", ").alias("sectors"))


def positive_scale(betas: DataFrame, by: str = "factor", value: str = "beta", q: float = 0.95, floor: float = 1e-6):
    """Per factor the floor-index 95th percentile of the positive absolute betas (A27); default 1."""
    from .order_stats import value_table
    mags = betas.select(by, F.abs(F.col(value)).alias("m")).where("m > 0")
    table = value_table(mags, [by], "m")
    pos = F.floor(F.lit(q) * F.col("n"))
    pos = F.least(pos, F.col("n") - 1)
    at = F.max(F.when((F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt")), F.col("m")))
    found = table.groupBy(by).agg(F.greatest(at, F.lit(floor)).alias("scale"))
    return betas.select(by).distinct().join(found, by, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
