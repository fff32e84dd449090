"""Coverage gates, sparse-row removal and cross-sectional imputation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..config import FEATURES, FUNDAMENTAL_CORE
from .order_stats import medians


def present(df: DataFrame, wanted: Sequence[str] = FEATURES) -> list[str]:
    """Configured features the table has, in configured order."""
    return [c for c in wanted if c in df.columns]


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "x") -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in cols], name, value)


def missing_count(cols: Sequence[str]) -> Column:
    return reduce(add, [F.col(c).isNull().cast("int") for c in cols])


def sparse_drop(df: DataFrame, cols: Sequence[str], max_missing: float = 0.5) -> DataFrame:
    """Drop rows with more than ``max_missing`` of the features missing."""
    return df.where(missing_count(cols) / len(cols) <= max_missing)


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null rows and share per feature (A28), one partial aggregate."""
    agg = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in cols])
    return (agg.unpivot("n", list(cols), "feature", "non_null")
            .select("feature", "n", "non_null", F.try_divide("non_null", "n").alias("coverage")))


def fundamentals_gate(df: DataFrame, cols: Sequence[str] = FUNDAMENTAL_CORE, min_cov: float = 0.10, limit: int = 3) -> None:
    """Raise when at least ``limit`` core features are nearly empty (P11); decided from one aggregate row."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in cols]).first()
    empty = [c for c in cols if row["n"] == 0 or row[c] / row["n"] < min_cov]
    if len(empty) >= limit:
        raise ValueError(f"fundamentals feed failed: coverage below {min_cov:.0%} for {empty}")


def imputation_mask(df: DataFrame, cols: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Which values are missing before the fill (A2)."""
    return df.select(*ids, *[F.col(c).isNull().alias(c) for c in cols])


def median_row(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per cross-section with the exact median of every feature as ``_med_<feature>``."""
    med = medians(to_long(df, by, cols), [*by, "feature"], "x")
    wide = [F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_med_{c}") for c in cols]
    return med.groupBy(*by).agg(*wide)


def impute_median(df: DataFrame, cols: Sequence[str], by: Sequence[str], mode: str = "screener",
                  min_names: int = 5) -> DataFrame:
    """Fill gaps with the median of the cross-section (A1).

    ``screener`` removes sparse rows first and fills an all-null feature with 0.  ``panel`` takes the medians over
    all rows, keeps an all-null feature null, drops rows with no value at all and cross-sections below
    ``min_names`` rows.
    """
    if mode == "screener":
        df = sparse_drop(df, cols)
    med = median_row(df, cols, by)
    if by:
        joined = df.join(med, list(by), "left")
    else:
        joined = df.withColumn("_m", med.select(F.struct("*")).scalar()).select("*", "_m.*")
    last = [F.lit(0.0)] if mode == "screener" else []
    filled = joined.select(*[c for c in df.columns if c not in cols],
                           *[F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"), *last).alias(c) for c in cols])
    if mode == "panel":
        filled = filled.where(missing_count(cols) < len(cols))
        sizes = filled.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_names)
        filled = filled.join(sizes.drop("_n"), list(by), "left_semi")
    return filled
