"""Backtest panel: every rebalance date of a point-in-time store in one plan keyed by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import FEATURES, RunConfig
from ..session import cut_lineage
from ..sources.store import Store
from . import asof, clean, cluster, scoring


def lookahead_rows(df: DataFrame, src: str = "src_date", as_of: str = "as_of") -> DataFrame:
    """Rows dated after their as-of date."""
    return df.where(F.col(src) > F.col(as_of))


def assert_no_lookahead(df: DataFrame, src: str = "src_date", as_of: str = "as_of") -> None:
    """Raise with a sample when any row is dated after its as-of date (B2)."""
    sample = lookahead_rows(df, src, as_of).limit(3).collect()
    if sample:
        raise AssertionError(f"look-ahead: rows dated after their as-of date, e.g. {sample}")


def scoreable(store: Store, cfg: RunConfig) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """As-of features of the members, imputed per date; with the rebalance dates and as-of holdings."""
    dates = asof.rebalance_dates(store.features, cfg.cadence, cfg.start, cfg.end)
    days = asof.calendar(dates)
    rows = asof.features_asof(store.features, days)
    if store.universe is not None:
        # Spark sizes the members by their file, not by the dates they are expanded to, and would broadcast millions of rows
        members = asof.membership_asof(store.universe, days).hint("merge")
        rows = rows.join(members, ["as_of", "entity"], "left_semi")
    held = None
    if store.holdings is not None:
        held = asof.snapshot_asof(store.holdings, days).select("as_of", "entity", F.col("weight").alias("held_weight"))
        if cfg.portfolio_only:
            rows = rows.join(held, ["as_of", "entity"], "left_semi")
    rows = rows.drop("src_date").withColumnRenamed("as_of", "date")
    if cfg.gate:
        clean.fundamentals_gate(rows)
    cols = clean.present(rows)
    return clean.impute_median(rows, cols, ["date"], "panel", cfg.min_names), dates, held


def build_panel(store: Store, cfg: RunConfig = RunConfig(), clusters: DataFrame | None = None) -> DataFrame:
    """One row per (date, entity): score, tier, holding, forward labels (B1).

    ``clusters`` (date, entity, cluster, cluster_style) is attached when given; names without one keep null.  With
    ``cfg.run_clusters`` the run fits PCA, clusters and styles of every large enough date itself.  With ``cfg.gate`` it raises when
    the core fundamentals of the members are nearly empty (P11).  Rows whose drawdown window reaches past the last price keep
    their label and carry ``window_complete = false``.
    """
    rows, dates, held = scoreable(store, cfg)
    rows = cut_lineage(rows)
    cols = [c for c in FEATURES if c in rows.columns]
    scores = scoring.score(rows, ["date"], cols=cols, keep_ranks=False)
    if clusters is None and cfg.run_clusters:
        clusters = cluster.cluster_cross_sections(rows, cols, ["date"])
    fwd = (asof.forward_stats(store.prices, dates, cfg.horizons, cfg.horizon_months, store.delistings)
           .withColumnRenamed("as_of", "date"))
    panel = (rows.select("date", "entity", "sector").join(scores, ["date", "entity"])
             .join(fwd, ["date", "entity"], "left"))
    if held is not None:
        panel = panel.join(held.withColumnRenamed("as_of", "date"), ["date", "entity"], "left")
    else:
        panel = panel.withColumn("held_weight", F.lit(None).cast("double"))
    if clusters is not None:
        panel = panel.join(clusters, ["date", "entity"], "left")
    else:
        panel = (panel.withColumn("cluster", F.lit(None).cast("int"))
                 .withColumn("cluster_style", F.lit(None).cast("string")))
    if store.delistings is not None:
        gone = store.delistings.select("entity", F.lit(True).alias("_gone"))
        panel = panel.join(gone, "entity", "left")
    else:
        panel = panel.withColumn("_gone", F.lit(None).cast("boolean"))
    last_price = store.prices.agg(F.max("date")).scalar()
    return panel.withColumn("_last", last_price).select(
        "date", "entity", "sector", "composite_score", "score_percentile", "risk_tier", "cluster", "cluster_style",
        F.col("held_weight").isNotNull().alias("is_held"), F.coalesce("held_weight", F.lit(0.0)).alias("held_weight"),
        *[f"fwd_ret_{h}m" for h in cfg.horizons], "fwd_maxdd",
        (F.col("fwd_maxdd") >= cfg.dd_threshold).cast("int").alias("label"),
        F.coalesce("_gone", F.lit(False)).alias("delisted"), "period_ret",
        (F.add_months("date", cfg.horizon_months) <= F.col("_last")).alias("window_complete"))
