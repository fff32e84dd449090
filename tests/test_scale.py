"""What a task holds and what is shuffled does not follow the number of groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from crossrisk.config import RunConfig
from crossrisk.operators import backtest, pca, starts
from crossrisk.plans import macro, views
from crossrisk.sources.store import Store


def test_rows_of_timeframe_fits_are_shuffled_once(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"entity": [f"e{i % 3}" for i in range(150)], "date": pd.date_range("2020-01-01", periods=150).date,
                         "ret": rng.normal(size=150), **{f: rng.normal(size=150) for f in views.FACTORS}})
    fits = macro.each_timeframe(spark.createDataFrame(rows), "ret", ["entity"])
    plan = fits._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    executed = fits._jdf.queryExecution().sparkPlan()
    prepared = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, executed).toString()
    assert prepared.count("Exchange hashpartitioning") == 1
    one = fits.where("entity = 'e0' and which = factor and timeframe = 'all'").toPandas().set_index("which")["beta"]
    own = rows[rows["entity"] == "e0"]
    for f, beta in one.items():
        assert beta == pytest.approx(np.polyfit(own[f], own["ret"], 1)[0])


def test_vectors_of_a_task_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame(pd.DataFrame({"entity": np.repeat([f"e{i}" for i in range(90)], 20), "ret": rng.normal(size=1800),
                                               "date": np.tile(pd.date_range("2020-01-01", periods=20).date, 90)}))
    whole = pca.corr_pca(rows, 2)[2].collect()
    monkeypatch.setattr(pca, "VECTOR_CELLS", 20 * 3)
    vectors = pca._standard_vectors(rows, pca._calendar_days(rows))
    held = vectors.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert held.sum() == 90 and held.max() <= 15
    for a, b in zip(whole, pca.corr_pca(rows, 2)[2].collect()):
        assert a["pc"] == b["pc"] and a["eigenvalue"] == pytest.approx(b["eigenvalue"])


def test_starts_need_no_package_in_a_task():
    assert b"weighted_starts" in cloudpickle.dumps(starts.weighted_starts) and b"crossrisk.operators.starts\x94\x8c" not in cloudpickle.dumps(
        starts.weighted_starts)[:60]


def test_members_are_dealt_and_not_broadcast(spark, tmp_path):
    """A member's file row stands for a row at every date, so the size of the file says nothing."""
    days = [pd.Timestamp(f"{y}-{m}-28").date() for y in (2020, 2021) for m in (3, 6, 9, 12)]
    rng = np.random.default_rng(1)
    facts = pd.DataFrame([{"date": d, "entity": f"e{i}", "sector": "s", "altman_z": rng.normal()} for d in days for i in range(8)])
    flags = pd.DataFrame([{"date": days[0], "entity": f"e{i}", "in_index": i % 4 > 0} for i in range(8)])
    tables = {}
    for name, own in (("features", facts), ("universe", flags)):
        spark.createDataFrame(own).write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    rows, dates, _ = backtest.scoreable(Store(prices=None, **tables), RunConfig())
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    semi = [line for line in plan.splitlines() if "Join [as_of" in line and "LeftSemi" in line]
    assert semi and all("SortMergeJoin" in line for line in semi)
    assert dates.count() == 8
    assert {(r["date"], r["entity"]) for r in rows.collect()} == {(d, f"e{i}") for d in days for i in range(8) if i % 4}
