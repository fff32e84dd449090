"""Sinks: parquet, CSV, JSON-safe records, nested documents, tails (K1-K7)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.expr import finite


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), gate: Callable[[], None] | None = None):
    """Overwrite a parquet table; the gate must pass first (K1).

    Rows are clustered by the partition column so each partition value gets few files; AQE splits a value that
    holds much of the table.
    """
    if gate is not None:
        gate()
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, dates and timestamps to ISO text (K3)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def to_records(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def nested_paths(paths: DataFrame, cols: Sequence[str], key: str = "entity") -> DataFrame:
    """Ordered path of snapshots per entity (K5); a path has one entry per snapshot date."""
    return paths.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", *cols))).alias("path"))


def beta_maps(betas: DataFrame, factors: Sequence[str], value: str, default: float, digits: int | None = None,
              key: str = "entity") -> DataFrame:
    """Map factor -> value per entity over a fixed factor list, gaps filled (K5: beta 0, p 1, se 0)."""
    have = betas.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("factor", value))).alias("_m"))
    fixed = F.array(*[F.lit(f) for f in factors])
    cell = lambda f: F.coalesce(F.col("_m")[f], F.lit(default))
    out = F.map_from_arrays(fixed, F.transform(fixed, (lambda f: F.round(cell(f), digits)) if digits else cell))
    return have.select(key, out.alias(value))


def beta_arrays(betas: DataFrame, factors: Sequence[str], key: str = "entity", beta_digits: int = 4, p_digits: int = 3):
    """Rounded arrays in fixed factor order, missing factors null (K5)."""
    have = betas.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("factor", F.struct("beta", "p_value"))))
                                  .alias("_m"))
    fixed = F.array(*[F.lit(f) for f in factors])
    return have.select(
        key, F.transform(fixed, lambda f: F.bround(F.col("_m")[f]["beta"], beta_digits)).alias("beta"),
        F.transform(fixed, lambda f: F.bround(F.col("_m")[f]["p_value"], p_digits)).alias("p"))


def series_arrays(long: DataFrame, key: str = "factor") -> DataFrame:
    """Column -> array of values in date order (K5); one entry per calendar day."""
    pairs = F.array_sort(F.collect_list(F.struct("date", "value")))
    return long.groupBy(key).agg(F.transform(pairs, lambda p: p["date"]).alias("dates"),
                                 F.transform(pairs, lambda p: p["value"]).alias("values"))


def tail(df: DataFrame, n: int = 504, order: str = "date") -> DataFrame:
    """Most recent ``n`` rows of a calendar table (K6)."""
    return df.orderBy(F.col(order).desc()).limit(n)
