import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossrisk.config import TIMEFRAMES
from crossrisk.operators import cube, regress as R, returns
from crossrisk.operators.gram import window_moments

FIELDS = ["beta", "std_err", "t_stat", "p_value", "ci_low", "ci_high", "vif", "factor_move", "n", "r2", "adj_r2", "resid_std"]


@pytest.fixture(scope="module")
def panel(spark):
    """Three groups over three years with gaps, far-off levels and nulls; one group too short for the shorter timeframes."""
    rng = np.random.default_rng(8)
    days = [dt.date(2018, 9, 1) + dt.timedelta(days=i) for i in range(1000)]
    rows = []
    for g, first in (("a", 0), ("b", 300), ("c", 0)):
        for i, d in enumerate(days[first:]):
            if rng.random() < 0.3 or g == "c" and i > 860:
                continue
            a, b = rng.normal(50, 2), rng.normal(0, 0.01)
            y = 0.3 * a - 4 * b + rng.normal() * (1 + 0.5 * np.sin(i / 40)) + 1000
            rows.append((g, d, y, a + 20 * b, None if rng.random() < 0.02 else b))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["g", "date", "y", "a", "b"]).astype({"b": float}).replace({np.nan: None}),
                                 "g string, date date, y double, a double, b double")


def same(got, want, keys):
    got, want = (d.toPandas().set_index(keys).sort_index() for d in (got, want))
    assert list(got.index) == list(want.index) and len(got) > 0
    for f in FIELDS:
        np.testing.assert_allclose(got[f].astype(float), want[f].astype(float), rtol=1e-6, atol=1e-9, err_msg=f)


@pytest.mark.parametrize("xs", [["a"], ["a", "b"]])
def test_cube_gives_the_fits_of_copied_rows(spark, panel, xs):
    got = cube.timeframe_fits(panel, "y", xs, ["g"])
    want = R.ols_hac(returns.by_timeframe(panel, TIMEFRAMES), "y", xs, ["g", "timeframe"])
    assert {r["timeframe"] for r in got.where("g = 'a'").collect()} == set(TIMEFRAMES)
    assert {r["timeframe"] for r in got.where("g = 'c'").collect()} < set(TIMEFRAMES)
    same(got, want, ["g", "timeframe", "factor"])


def test_cube_residualizes_inside_each_timeframe(spark, panel):
    got = cube.timeframe_fits(panel, "y", ["a"], ["g"], controls=["b"])
    want = R.residualized(returns.by_timeframe(panel, TIMEFRAMES), "y", ["b"], ["a"], ["g", "timeframe"])
    same(got, want, ["g", "timeframe", "factor"])


def test_cube_without_groups_rows_or_variance(spark, panel):
    one = panel.where("g = 'a'").drop("g")
    assert cube.timeframe_fits(one, "y", ["a"]).columns[0] == "timeframe"
    assert cube.timeframe_fits(panel.limit(0), "y", ["a"], ["g"]).count() == 0
    flat = cube.timeframe_fits(one.withColumn("a", F.lit(3.0)), "y", ["a"]).where("factor = 'a'").collect()
    assert flat and all(r["beta"] == 0 for r in flat)


@pytest.mark.parametrize("window", [1, 7, 60, 400])
def test_window_moments_against_numpy(spark, window):
    rng = np.random.default_rng(window)
    rows = []
    for g, n in (("a", 400), ("b", 59), ("c", 1)):
        v = rng.normal(size=(n, 2)) * 3 + 1e6
        v[10:90, 1] = 5.0                                    # a stretch without variance
        rows += [(g, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, date date, a double, b double")
    got = window_moments(df, ["a", "b"], ["g"], window).orderBy("g", "date").toPandas()
    M = {c: i + 1 for i, c in enumerate(got.columns)}        # places in a named tuple
    for g, part in got.groupby("g"):
        v = part[["a", "b"]].to_numpy()
        for i, r in enumerate(part.itertuples()):
            cut = v[max(0, i - window + 1):i + 1]
            if i + 1 < window:
                assert r[M["_n"]] < window                         # not full
                continue
            c = np.cov(cut.T, bias=True) if len(cut) > 1 else np.zeros((2, 2))
            assert r[M["_n"]] == window
            np.testing.assert_allclose(r[M["_means"]], cut.mean(axis=0), rtol=1e-12)
            np.testing.assert_allclose(r[M["_cov"]], [c[0, 0], c[0, 1], c[1, 1]], rtol=1e-6, atol=1e-8 * max(c[1, 1], 1))
            if (cut[:, 1] == 5.0).all():
                assert r[M["_cov"]][2] == 0.0


def test_rolling_beta_is_null_where_a_row_of_the_window_is_incomplete(spark):
    rng = np.random.default_rng(3)
    y, x = rng.normal(size=50), rng.normal(size=50)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(y[i]), None if i == 20 else float(x[i])) for i in range(50)]
    rows.insert(5, (dt.date(2019, 1, 1), None, None))        # left out whole
    got = R.rolling_beta(spark.createDataFrame(rows, "date date, y double, x double"), "y", "x", 10).orderBy("date").collect()
    assert len(got) == 50
    for i, r in enumerate(got):
        if i < 9 or 20 <= i < 30:
            assert r["beta"] is None
        else:
            c = np.cov(y[i - 9:i + 1], x[i - 9:i + 1])
            assert r["beta"] == pytest.approx(c[0, 1] / c[1, 1])
