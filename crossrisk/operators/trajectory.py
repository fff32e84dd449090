"""Paths through component space, drift, transitions and alerts.

A path has one row per (entity, snapshot); windows per entity are bounded by the number of snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import BOUNDARY_RADIUS, DRIFT_SIGMA
from . import cluster, pca


def _by_entity():
    return W.partitionBy("entity").orderBy("date")


def build(features: DataFrame, model: DataFrame, centroids: DataFrame, cols: Sequence[str], medians: DataFrame,
          k: int = 4) -> DataFrame:
    """Snapshots (entity, date, features) to ``entity, date, PC1.., cluster`` under one fitted model.

    ``medians`` is one row (``clean.median_row``) of the universe the model was fitted on; gaps are filled with it, and
    a feature without a median counts as zero.
    """
    filled = features.withColumn("_m", medians.select(F.struct("*")).scalar())
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_m._med_{c}"), F.lit(0.0)) for c in cols}).drop("_m")
    pcs = [f"PC{i + 1}" for i in range(k)]
    points = pca.project(filled, model, cols, (), k, keep=["entity", "date"])
    return cluster.gap(points, centroids, pcs).select("entity", "date", *pcs, "cluster", "gap")


def valid(paths: DataFrame, pcs: Sequence[str]) -> DataFrame:
    return paths.dropna(subset=list(pcs))


def steps(paths: DataFrame, pcs: Sequence[str]) -> DataFrame:
    """Distance from the previous valid snapshot of the entity."""
    w = _by_entity()
    sq = sum(((F.col(p) - F.lag(p).over(w)) ** 2 for p in pcs[1:]), (F.col(pcs[0]) - F.lag(pcs[0]).over(w)) ** 2)
    return valid(paths, pcs).withColumn("step", F.sqrt(sq))


def drift(paths: DataFrame, pcs: Sequence[str]) -> DataFrame:
    """Path length and last step per entity, null below two valid snapshots."""
    return steps(paths, pcs).groupBy("entity").agg(
        F.sum("step").alias("distance_traveled"),
        F.max_by("step", "date").alias("last_drift"), F.count(F.lit(1)).alias("n_snapshots"))


def transitions(paths: DataFrame) -> DataFrame:
    """Cluster changes over known clusters and whether the last step crossed (W17); unknown is null or negative."""
    known = paths.where(F.col("cluster") >= 0)
    changed = (F.col("cluster") != F.lag("cluster").over(_by_entity())).cast("long")
    return (known.withColumn("_c", changed).groupBy("entity")
            .agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("transitions"),
                 F.coalesce(F.max_by("_c", "date") == 1, F.lit(False)).alias("crossed_last")))


def large_drift(drifts: DataFrame, sigma: float = DRIFT_SIGMA) -> DataFrame:
    """Flag drifts of at least mean + sigma deviations across entities.

    A missing or zero deviation counts as 1, a missing mean as 0.
    """
    sd, mean = F.stddev_samp("last_drift"), F.avg("last_drift")
    limit = drifts.agg((F.coalesce(mean, F.lit(0.0)) + sigma * F.when(sd > 0, sd).otherwise(F.lit(1.0))).alias("t")).scalar()
    return drifts.withColumn("_t", limit).withColumn("large_drift", F.coalesce(F.col("last_drift") >= F.col("_t"), F.lit(False))).drop("_t")


def direction(paths: DataFrame, ranks: DataFrame) -> DataFrame:
    """Deteriorating, Improving or Steady from first to last cluster rank (W19); ``ranks`` is cluster, risk_rank."""
    known = paths.where(F.col("cluster") >= 0).join(ranks, "cluster", "left")
    agg = known.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk_rank").isNull()).alias("_u"),
        F.min_by("risk_rank", "date").alias("_a"), F.max_by("risk_rank", "date").alias("_b"))
    text = (F.when((F.col("n") < 2) | (F.col("_u") > 0), "Unknown").when(F.col("_b") > F.col("_a"), "Deteriorating")
            .when(F.col("_b") < F.col("_a"), "Improving").otherwise("Steady"))
    every = paths.select("entity").distinct()
    return every.join(agg.select("entity", text.alias("direction")), "entity", "left") \
        .withColumn("direction", F.coalesce("direction", F.lit("Unknown")))


def segments(paths: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each step as riskier, safer or same."""
    prev = F.lag("risk_rank").over(_by_entity())
    rows = paths.join(ranks, "cluster", "left").withColumn("_p", prev)
    text = F.when(F.col("risk_rank") > F.col("_p"), "riskier").when(F.col("risk_rank") < F.col("_p"), "safer").otherwise("same")
    return rows.where(F.col("_p").isNotNull()).select("entity", "date", text.alias("segment"))


def alerts(gaps: DataFrame, drifts: DataFrame, moves: DataFrame, holdings: DataFrame, radius: float = BOUNDARY_RADIUS) -> DataFrame:
    """Borderline, crossed or drifting names, holdings first, then the smallest gap."""
    out = (gaps.join(drifts.select("entity", "last_drift", "large_drift"), "entity", "left")
           .join(moves.select("entity", "crossed_last"), "entity", "left")
           .join(holdings.select("entity", F.lit(True).alias("_h")), "entity", "left"))
    no = F.lit(False)
    return (out.withColumn("borderline", F.coalesce(F.col("gap") < radius, no))
            .withColumn("crossed_last", F.coalesce("crossed_last", no)).withColumn("large_drift", F.coalesce("large_drift", no))
            .withColumn("is_portfolio", F.coalesce("_h", no)).drop("_h")
            .where(F.col("borderline") | F.col("crossed_last") | F.col("large_drift"))
            .orderBy(F.col("is_portfolio").desc(), F.col("gap"), "entity"))


def nested(paths: DataFrame, pcs: Sequence[str]) -> DataFrame:
    """One document per entity: ordered snapshots (K5)."""
    item: Column = F.struct("date", "cluster", *pcs)
    return paths.groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("path"))
