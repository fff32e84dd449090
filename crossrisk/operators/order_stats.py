"""Exact order statistics of groups of any size.

A window over ``partitionBy(group)`` puts a whole group into one task, so a date that holds a third of all rows
becomes the job.  Everything here works on the *value table* of a group instead: one row per distinct value with
its count and the number of rows below it.  The value table is built from partial counts, sorted once over ranges of
(group, value), and written; a group is spread over as many ranges as its size asks for, a range holds pieces of groups,
and the running counts inside a range start from the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage


def value_table(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``by, value, cnt, below, n``: exact counts per distinct non-null value, and rows below it in its group.

    ``sums`` adds totals of further integer columns the same way: ``x, x_below, x_total`` for every entry ``x``.
    """
    by, sums = list(by), dict(sums or {})
    measures = {"cnt": F.count(F.lit(1)), **{k: F.sum(c) for k, c in sums.items()}}
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[a.alias(k) for k, a in measures.items()])
    ordered = cut_lineage(counts.orderBy(*by, value).withColumn("_range", F.spark_partition_id()))
    per_range = ordered.groupBy("_range", *by).agg(*[F.sum(k).alias(f"_r_{k}") for k in measures])
    whole = W.partitionBy(*by)                    # one row for each range that holds a piece of the group
    earlier = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range", *by,
        *[F.coalesce(F.sum(f"_r_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in measures],
        *[F.sum(f"_r_{k}").over(whole).alias(f"_t_{k}") for k in measures])
    inside = W.partitionBy("_range", *by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    low = {k: F.col(f"_o_{k}") + F.coalesce(F.col(f"_i_{k}"), F.lit(0)) for k in measures}
    return (ordered.select("*", *[F.sum(k).over(inside).alias(f"_i_{k}") for k in measures])
            .join(offsets, ["_range", *by])
            .select(*by, value, "cnt", low["cnt"].alias("below"), F.col("_t_cnt").alias("n"),
                    *[c for k in sums for c in (F.col(k), low[k].alias(f"{k}_below"),
                                                F.col(f"_t_{k}").alias(f"{k}_total"))]))


def with_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows of ``df`` plus ``cnt, below, n`` of their value; null values keep nulls there.

    The join back is on (group, value); a tie group that holds a large share of the rows is split by AQE's skew
    join because the value table has one row for it.
    """
    return df.join(value_table(df, by, value), [*by, value], "left")


def positions(df: DataFrame, by: Sequence[str], value: str, tie: str, out: str = "pos") -> DataFrame:
    """Zero-based position in the group by (value, tie), with the group size ``n``.

    Meant for values that rarely tie (hashes, measures): only a tie group is ordered in one task.
    """
    nth = F.row_number().over(W.partitionBy(*by, value).orderBy(tie))
    return with_ranks(df, by, value).withColumn(out, F.col("below") + nth - 1).drop("cnt", "below")


def mid_rank(below: str | Column = "below", cnt: str | Column = "cnt") -> Column:
    """Average rank over ties, as twice the rank to stay in integers."""
    below, cnt = (F.col(c) if isinstance(c, str) else c for c in (below, cnt))
    return 2 * below + cnt + 1


def mid_rank_pct(df: DataFrame, by: Sequence[str], value: str, out: str = "pct_rank") -> DataFrame:
    """Average rank over ties as a percentage of the non-null count."""
    return (with_ranks(df, by, value)
            .withColumn(out, F.lit(100.0) * mid_rank() / (2 * F.col("n")))
            .drop("cnt", "below", "n"))


def strict_pct(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of the group strictly below, in percent."""
    return (with_ranks(df, by, value)
            .withColumn(out, F.lit(100.0) * F.col("below") / F.col("n")).drop("cnt", "below", "n"))


def sector_mid_pct(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """(below + ties/2) / n in percent, self included; groups of one give null."""
    pct = F.lit(100.0) * (2 * F.col("below") + F.col("cnt")) / (2 * F.col("n"))
    return (with_ranks(df, by, value)
            .withColumn(out, F.when(F.col("n") >= 2, pct)).drop("cnt", "below", "n"))


def _at(position: Column, value: str) -> Column:
    """Value at a zero-based position of the sorted group, as an aggregate over its value table."""
    return F.max(F.when((F.col("below") <= position) & (position < F.col("below") + F.col("cnt")), F.col(value)))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``."""
    table = value_table(df, by, value)
    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n") - 1)
        lo = F.floor(h)
        aggs += [_at(lo, value).alias(f"_lo_{name}"), _at(F.ceil(h), value).alias(f"_hi_{name}"),
                 F.max(h - lo).alias(f"_f_{name}")]
    out = table.groupBy(*by).agg(*aggs)
    return out.select(*by, *[
        (F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_f_{q}")).alias(q) for q in probs])


def medians(df: DataFrame, by: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group: mean of the two middle values."""
    table = value_table(df, by, value)
    lo, hi = F.expr("(n - 1) div 2"), F.expr("n div 2")
    return (table.groupBy(*by).agg(_at(lo, value).alias("_lo"), _at(hi, value).alias("_hi"))
            .select(*by, ((F.col("_lo") + F.col("_hi")) / 2).alias(out)))


def peer_medians(df: DataFrame, by: Sequence[str], value: str, out: str = "peer_median") -> DataFrame:
    """Median of the other members of the group (leave one out), without a self join.

    The peers' sorted list is the group's list with one copy of the row's own value removed, so the peers' value
    at position p is the group's value at p, or at p + 1 from the own position on.  Four positions per group
    suffice for every member.  Groups of one give null.
    """
    table = value_table(df, by, value)
    lo, hi = F.expr("(n - 2) div 2"), F.expr("(n - 1) div 2")
    spots = table.groupBy(*by).agg(
        _at(lo, value).alias("_lo0"), _at(lo + 1, value).alias("_lo1"),
        _at(hi, value).alias("_hi0"), _at(hi + 1, value).alias("_hi1"))
    ranked = df.join(table.join(spots, list(by)), [*by, value], "left")
    pick_lo = F.when(lo < F.col("below"), F.col("_lo0")).otherwise(F.col("_lo1"))
    pick_hi = F.when(hi < F.col("below"), F.col("_hi0")).otherwise(F.col("_hi1"))
    return (ranked.withColumn(out, F.when(F.col("n") >= 2, (pick_lo + pick_hi) / 2))
            .drop("cnt", "below", "n", "_lo0", "_lo1", "_hi0", "_hi1"))


def row_numbers(df: DataFrame, order: Sequence[str | Column], out: str = "rn") -> DataFrame:
    """Global one-based row number in a total order, plus the row count as ``n``.

    Range sort, reliable checkpoint, then per-partition counts: no task sees more than one range of the order.
    """
    lit = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sizes = lit.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    w = W.orderBy("_part")                        # one row per partition of the sort
    offsets = sizes.select("_part",
                           F.coalesce(F.sum("_rows").over(w.rowsBetween(W.unboundedPreceding, -1)),
                                      F.lit(0)).alias("_before"),
                           F.sum("_rows").over(W.partitionBy()).alias("n"))
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (lit.withColumn("_part", part).join(offsets, "_part")
            .withColumn(out, F.col("_before") + inside + 1)
            .drop("_mid", "_part", "_before"))


def equal_frequency_bin(rn: Column | str, n: Column | str, bins: int = 10) -> Column:
    """Bin of a row number so that bins hold equal counts by linear cut points (W3); one-based."""
    rn, n = (F.col(c) if isinstance(c, str) else c for c in (rn, n))
    edge = F.ceil(((rn - 1) * bins) / F.greatest(n - 1, F.lit(1)))
    return F.greatest(edge, F.lit(1)).cast("long")


def pooled_deciles(df: DataFrame, order: Sequence[str | Column], bins: int = 10, out: str = "decile") -> DataFrame:
    """Equal-frequency bin over the whole table in a total order."""
    return row_numbers(df, order, "_rn").withColumn(out, equal_frequency_bin("_rn", "n", bins)).drop("_rn", "n")
