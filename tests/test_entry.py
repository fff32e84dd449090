import math

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
# the smallest scale has six complete dates, below the thirty a regression needs
REGRESSIONS = {"ols_hac_single", "timeframe_betas", "timeframe_residualized", "timeframe_comparison", "timeframe_scenarios",
               "rolling_beta_252", "rolling_ols_252", "rolling_entity_betas", "rolling_beta_by_timeframe",
               "significant_contributors", "macro_summary_joint"}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]
NAMES = ["screen_scores", "backtest_panel", "decile_hit_rates", "spearman_ic", "newey_west_t", "roc", "asof_features", "forward_maxdd",
         "sector_peer_delta", "ols_hac_single", "timeframe_betas", "feature_audit", "centroid_gap", "path_drift", "altman", "event_count_90d",
         "placebo", "cluster_styles", "headline_direction", "daily_block", "largest_absolute", "knn5", "squared_silhouette", "timeframe_residualized",
         "timeframe_comparison", "timeframe_scenarios", "rolling_beta_252", "rolling_ols_252", "rolling_entity_betas",
         "rolling_beta_by_timeframe", "calibration_by_tier", "significant_contributors", "macro_summary_joint"]


def test_the_panel_run_stops_when_fundamentals_are_empty(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from crossrisk.config import FUNDAMENTAL_CORE, RunConfig
    from crossrisk.operators import backtest
    from crossrisk.plans import backtests
    store = backtests.store(spark, SMALL)
    backtest.scoreable(store, RunConfig(gate=True))
    empty = store.features.withColumns({c: F.lit(None).cast("double") for c in FUNDAMENTAL_CORE[:3]})
    with pytest.raises(ValueError):
        backtest.scoreable(replace(store, features=empty), RunConfig(gate=True))
    backtest.scoreable(replace(store, features=empty), RunConfig())


def _duck(directory):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def _clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    directory = LARGER if name in REGRESSIONS else SMALL
    df = entry.queries()[name](spark, directory)
    cols = sorted(df.columns)
    got = sorted((tuple(_clean(r[c]) for c in cols) for r in df.collect()), key=str)
    duck = _duck(directory)
    rel = duck.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_clean(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want
