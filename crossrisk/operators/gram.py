"""Moments of column sets per group: the sufficient statistics of every regression and PCA here.

Means and central co-moments come from Spark's own mergeable aggregates, so a group of any size is reduced by
partial aggregation before anything is shuffled, and Python only ever sees one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths

ONE = "all_rows"


def keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Group keys, with a constant one when there is none."""
    return (df, list(by)) if by else (df.withColumn(ONE, F.lit(0)), [ONE])


def _pairs(cols: Sequence[str]) -> list[Column]:
    return [F.covar_pop(cols[i], cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str], chunk: int = 150) -> DataFrame:
    """``by, n, means, cov``: row count, means and the upper triangle of the population covariance.

    Wide sets (a full factor library) are aggregated in chunks of pairs joined by group, which keeps the generated
    code of each aggregate small.
    """
    by, pairs = list(by), _pairs(cols)
    n, means = F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("means")
    if len(pairs) <= chunk:
        return df.groupBy(*by).agg(n, means, F.array(*pairs).alias("cov"))
    out, parts = df.groupBy(*by).agg(n, means), []
    for i in range(0, len(pairs), chunk):
        part = df.groupBy(*by).agg(F.array(*pairs[i:i + chunk]).alias(f"_c{i}"))
        out, parts = out.join(part, by), [*parts, f"_c{i}"]
    return out.select(*by, "n", "means", F.concat(*parts).alias("cov"))


def window_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str], window: int, date: str = "date") -> DataFrame:
    """``df`` with ``_n, _means, _cov`` of ``cols`` over the last ``window`` rows of its group, as ``moments`` has them.

    Rows are dealt by group once and sorted by date.  They are cut into blocks of ``window`` rows; a window is what is left of one
    block and the start of the next, and running moments from the two ends of every block give both, so a row costs the same at
    every window length.  The two parts are merged in central form; nothing is subtracted, so a constant column has a variance of
    exactly zero.  ``cols`` are null together and such rows count as rows of the window only; ``_n`` is below ``window`` where the
    window is not full.  One row per group and date.
    """
    names, by = list(cols), list(by)
    kernel = paths.by_entity(lambda part, who: paths.windowed(part, who, names, window), by)
    return dealt(df, by, date).mapInArrow(kernel, f"{key_schema(df, df.columns)}, _n long, _means array<double>, _cov array<double>")


def dealt(df: DataFrame, by: Sequence[str], date: str, placed: bool = False) -> DataFrame:
    """Rows of a group in one task, sorted by group and date; ``placed`` if a group's rows are in one task already."""
    return (df if placed else df.repartition(*by)).sortWithinPartitions(*by, date)


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
