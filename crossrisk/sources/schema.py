"""Table schemas and fail-loud ingest gates.

A gate is one aggregate pass that returns violation counts; the driver reads one row and raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import FEATURES
from ..functions.expr import normalize_key

_D, _S, _N = T.DateType(), T.StringType(), T.DoubleType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "features": _struct(("date", _D), ("entity", _S), ("sector", _S), *[(f, _N) for f in FEATURES]),
    "prices": _struct(("date", _D), ("entity", _S), ("adj_close", _N)),
    "universe": _struct(("date", _D), ("entity", _S), ("in_index", T.BooleanType())),
    "holdings": _struct(("date", _D), ("entity", _S), ("weight", _N)),
    "delistings": _struct(("entity", _S), ("delist_date", _D), ("final_value", _N)),
}
REQUIRED: dict[str, list[str]] = {
    "features": ["date", "entity", "sector"],
    "prices": ["date", "entity", "adj_close"],
    "universe": ["date", "entity", "in_index"],
    "holdings": ["date", "entity", "weight"],
    "delistings": ["entity", "delist_date", "final_value"],
}
_NAMES = {"ticker": "entity", "Ticker": "entity", "Sector": "sector"}


def require_columns(df: DataFrame, cols: Sequence[str], name: str) -> None:
    """Raise naming the missing columns and the actual schema."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}; found {df.columns}")


def to_day(df: DataFrame, col: str) -> Column:
    """Day of a date, timestamp or text column; null when unparseable (S3)."""
    kind = df.schema[col].dataType
    return F.try_to_date(F.col(col)) if isinstance(kind, T.StringType) else F.to_date(F.col(col))


def to_number(col: str | Column) -> Column:
    """Number or null, NaN as null."""
    c = F.col(col) if isinstance(col, str) else col
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def violations(df: DataFrame, date: str | None, keys: Sequence[str] | None) -> dict[str, int]:
    """Unparseable dates and duplicate keys, each one aggregate."""
    out = {"bad_dates": 0, "duplicate_keys": 0}
    if date is not None:
        day = to_day(df, date)
        out["bad_dates"] = df.agg(F.count_if(day.isNull()).alias("n")).first()["n"]
    if keys:
        out["duplicate_keys"] = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: tables of which the last row of a key counts, and the column with a row's position in the files, if a table has it
KEEP_LAST = ("prices", "universe", "holdings")
ORDER = "_order"


def validated(df: DataFrame, name: str) -> DataFrame:
    """Normalize names, keys, dates and numbers of a store table and raise on any violation.

    Of repeated (entity, date) rows of prices, universe and holdings the last one stays, by the column ``_order`` (W31).
    """
    for old, new in _NAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    require_columns(df, REQUIRED[name], name)
    date = "delist_date" if name == "delistings" else "date"
    out = df.withColumn("entity", normalize_key("entity"))
    found = violations(out, date, None)
    if found["bad_dates"]:
        raise ValueError(f"{name}: {found['bad_dates']} unparseable dates in {date}")
    out = out.withColumn(date, to_day(out, date))
    for field in SCHEMAS[name].fields:
        if isinstance(field.dataType, T.DoubleType) and field.name in out.columns:
            out = out.withColumn(field.name, to_number(field.name))
    if name == "features":
        found = violations(out, None, ["date", "entity"])
        if found["duplicate_keys"]:
            raise ValueError(f"features: {found['duplicate_keys']} duplicate (date, entity) keys")
    if name == "prices":
        out = out.where(F.col("adj_close").isNotNull())
    if name in KEEP_LAST and ORDER in out.columns:
        rest = F.struct(*[c for c in out.columns if c not in ("entity", "date", ORDER)])
        out = out.groupBy("entity", "date").agg(F.max_by(rest, ORDER).alias("_last")).select("entity", "date", "_last.*")
    if name == "delistings":
        out = out.withColumn("final_value", F.coalesce("final_value", F.lit(0.0)))
    if name == "universe":
        out = out.withColumn("in_index", F.col("in_index").cast("boolean"))
    return out
