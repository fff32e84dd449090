"""The point-in-time store: five parquet tables, two of them mandatory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from .schema import ORDER, SCHEMAS, validated

MANDATORY = ("features", "prices")


@dataclass(frozen=True)
class Store:
    features: DataFrame
    prices: DataFrame
    universe: DataFrame | None = None
    holdings: DataFrame | None = None
    delistings: DataFrame | None = None

    @property
    def survivorship_safe(self) -> bool:
        """False without point-in-time membership: names that left earlier are invisible."""
        return self.universe is not None


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        rows = spark.read.parquet(path)
        return rows.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(ORDER))
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err.getCondition()):
            return None
        raise


def load_store(spark: SparkSession, directory: str) -> Store:
    """Load and validate ``<table>.parquet`` under a directory; works on any Hadoop path."""
    tables: dict[str, DataFrame | None] = {}
    for name in SCHEMAS:
        df = _read(spark, f"{directory}/{name}.parquet")
        if df is None and name in MANDATORY:
            raise FileNotFoundError(f"required table {name} missing under {directory}")
        tables[name] = None if df is None else validated(df, name).drop(ORDER)
    return Store(**tables)


def coverage_report(features: DataFrame, thin: int = 10) -> DataFrame:
    """Distinct entities per date with a flag for thin dates."""
    n = F.countDistinct("entity")
    return features.groupBy("date").agg(n.alias("n_entities"), (n < thin).alias("thin"))
