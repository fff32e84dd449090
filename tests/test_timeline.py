import datetime as dt

import pytest
from pyspark.sql import functions as F

from crossrisk.config import RunConfig
from crossrisk.operators import asof, backtest, evaluate as E, fundamentals as FU, returns, trajectory

D = dt.date


def _prices(spark, rows):
    return spark.createDataFrame(rows, "entity string, date date, adj_close double")


def test_asof_is_newest_not_future(spark):
    f = spark.createDataFrame([("a", D(2020, 1, 5), 1.0), ("a", D(2020, 2, 5), 2.0), ("b", D(2020, 3, 1), 9.0)], "entity string, date date, v double")
    days = F.array(*[F.lit(x).cast("date") for x in ("2020-01-01", "2020-02-05", "2020-02-20")])
    out = {(r["entity"], r["as_of"]): (r["v"], r["src_date"]) for r in asof.features_asof(f, days).collect()}
    assert out == {("a", D(2020, 2, 5)): (2.0, D(2020, 2, 5)), ("a", D(2020, 2, 20)): (2.0, D(2020, 2, 5))}


def test_snapshot_asof_drops_absent_entities(spark):
    h = spark.createDataFrame([(D(2020, 1, 1), "a", 1.0), (D(2020, 2, 1), "b", 1.0)], "date date, entity string, weight double")
    days = F.array(F.lit("2020-03-01").cast("date"))
    assert [r["entity"] for r in asof.snapshot_asof(h, days).collect()] == ["b"]


def test_forward_window_and_delisting(spark):
    px = _prices(spark, [
        ("in", D(2020, 1, 31), 100.0), ("in", D(2020, 3, 2), 120.0), ("in", D(2020, 4, 1), 60.0), ("in", D(2020, 9, 1), 500.0),
        ("gone", D(2020, 1, 31), 100.0), ("gone", D(2020, 2, 10), 90.0), ("gone", D(2020, 2, 20), 95.0),
        ("late", D(2020, 1, 31), 10.0), ("late", D(2020, 2, 15), 11.0), ("one", D(2020, 2, 1), 5.0)])
    ends = spark.createDataFrame([("gone", D(2020, 2, 15), 10.0), ("late", D(2021, 1, 1), 0.0)], "entity string, delist_date date, final_value double")
    dates = spark.createDataFrame([(D(2020, 1, 31),)], "date date")
    out = {r["entity"]: r for r in asof.forward_stats(px, dates, (1, 3), 6, ends).collect()}
    assert out["in"]["fwd_ret_1m"] is None                        # one point up to 29 February
    assert out["in"]["fwd_ret_3m"] == pytest.approx(-0.4)
    assert out["in"]["fwd_maxdd"] == pytest.approx(0.5)           # September is outside six months
    assert out["gone"]["fwd_ret_3m"] == pytest.approx(-0.9) and out["gone"]["fwd_maxdd"] == pytest.approx(0.9)
    assert out["late"]["fwd_ret_1m"] == pytest.approx(0.1)        # delisting after the window changes nothing
    assert out["one"]["fwd_ret_1m"] is None and out["one"]["fwd_maxdd"] is None


def test_lookahead_guard(spark):
    bad = spark.createDataFrame([("a", D(2020, 2, 1), D(2020, 1, 1))], "entity string, src_date date, as_of date")
    with pytest.raises(AssertionError):
        backtest.assert_no_lookahead(bad)


@pytest.mark.parametrize("limit,want", [(1, [1, 1, None, None, 5]), (2, [1, 1, 1, None, 5]), (8, [1, 1, 1, 1, 5])])
def test_ffill_limit(spark, limit, want):
    rows = [("s", D(2020, 1, i + 1), v) for i, v in enumerate([1.0, None, None, None, 5.0])]
    df = spark.createDataFrame(rows, "factor string, date date, value double")
    out = asof.ffill_limit(df, ["factor"], "date", "value", limit).orderBy("date").collect()
    assert [r["value"] for r in out] == want
    by_col = asof.ffill_limit(df.withColumn("k", F.lit(limit)), ["factor"], "date", "value", F.col("k"), 31).orderBy("date").collect()
    assert [r["value"] for r in by_col] == want


def test_weeks_friday_and_empty(spark):
    r = spark.createDataFrame([("a", D(2024, 1, 5), 0.1), ("a", D(2024, 1, 8), 0.1), ("a", D(2024, 1, 9), 0.1), ("a", D(2024, 1, 22), 0.5)],
                              "entity string, date date, ret double")
    out = {x["week"]: x["ret"] for x in returns.weekly_returns(r, fill_empty=True).collect()}
    assert out[D(2024, 1, 5)] == pytest.approx(0.1) and out[D(2024, 1, 12)] == pytest.approx(0.21)
    assert out[D(2024, 1, 19)] == 0.0 and out[D(2024, 1, 26)] == pytest.approx(0.5)


def test_newey_west_against_numpy(spark):
    import numpy as np
    x = np.random.default_rng(1).normal(0.1, 1, 40)
    s = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "date date, ic double")
    got = E.newey_west(s, "ic").first()
    n, lags = 40, int(np.floor(4 * (40 / 100) ** (2 / 9)))
    e = x - x.mean()
    var = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    assert got["t_stat"] == pytest.approx(x.mean() / np.sqrt(var / n)) and got["lags"] == lags
    one = E.newey_west(s.limit(1), "ic").first()
    assert one["t_stat"] is None


def test_wilson_and_single_class(spark):
    z = E.with_rates(spark.createDataFrame([(0, 0), (10, 10)], "n long, events long")).orderBy("n").collect()
    assert z[0]["rate"] is None and z[0]["ci_low"] is None and z[1]["ci_high"] == 1.0 and 0.7 < z[1]["ci_low"] < 0.73
    p = spark.createDataFrame([(D(2020, 1, 1), str(i), float(i), 1, 50.0) for i in range(6)],
                              "date date, entity string, composite_score double, label int, score_percentile double")
    assert E.auc(p).first()["auc"] is None


def test_auc_and_roc_of_a_perfect_score(spark):
    p = spark.createDataFrame([(D(2020, 1, 1), str(i), float(i), int(i >= 5)) for i in range(10)],
                              "date date, entity string, composite_score double, label int")
    assert E.auc(p).first()["auc"] == 1.0
    pts = sorted((r["fpr"], r["tpr"]) for r in E.roc(p).collect())
    assert pts == [(0.0, 0.0), (0.0, 0.2), (0.0, 1.0), (1.0, 1.0)]


def test_turnover_and_equity(spark):
    w = spark.createDataFrame([(D(2020, 1, 1), "a", 0.5), (D(2020, 1, 1), "b", 0.5), (D(2020, 4, 1), "b", 1.0)], "date date, entity string, weight double")
    t = [r["turnover"] for r in E.turnover(w, w).orderBy("date").collect()]
    assert t == pytest.approx([1.0, 1.0])
    r = spark.createDataFrame([(D(2020, 1, 1), 0.1), (D(2020, 4, 1), -0.5), (D(2020, 7, 1), 0.2)], "date date, ret double")
    s = E.equity_stats(r).first()
    assert s["total_return"] == pytest.approx(1.1 * 0.5 * 1.2 - 1) and s["max_drawdown"] == pytest.approx(0.5)


def test_placebo_keeps_every_score(spark):
    p = spark.createDataFrame([(D(2020, 1, 1), str(i), float(i)) for i in range(50)], "date date, entity string, composite_score double")
    out = E.shuffled_scores(p).collect()
    assert sorted(r["composite_score"] for r in out) == [float(i) for i in range(50)]
    assert any(float(r["entity"]) != r["composite_score"] for r in out)


def test_net_debt_rules(spark):
    cols = "total_debt double, long_term_debt double, short_term_debt double, cash double, ebitda_ttm double"
    rows = [(100.0, None, None, 20.0, 10.0), (100.0, None, None, None, -5.0), (None, None, None, 1.0, 5.0), (None, 30.0, None, 0.0, 10.0),
            (1e6, None, None, 0.0, 1.0)]
    out = [r["v"] for r in spark.createDataFrame(rows, cols).select(FU.net_debt_to_ebitda().alias("v")).collect()]
    assert out == [8.0, 20.0, None, 3.0, 20.0]


def test_path_rules(spark):
    p = spark.createDataFrame([("a", D(2020, 1, 1), 0, 0.0), ("a", D(2020, 4, 1), 2, 3.0), ("a", D(2020, 7, 1), 1, None), ("a", D(2020, 10, 1), 2, 7.0),
                               ("b", D(2020, 1, 1), 1, 1.0)], "entity string, date date, cluster int, PC1 double")
    d = {r["entity"]: r for r in trajectory.drift(p, ["PC1"]).collect()}
    assert d["a"]["distance_traveled"] == 7.0 and d["a"]["last_drift"] == 4.0 and d["b"]["last_drift"] is None
    t = {r["entity"]: r for r in trajectory.transitions(p).collect()}
    assert t["a"]["transitions"] == 3 and t["a"]["crossed_last"] and t["b"]["transitions"] == 0
    rank = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "cluster int, risk_rank int")
    w = {r["entity"]: r["direction"] for r in trajectory.direction(p, rank).collect()}
    assert w == {"a": "Deteriorating", "b": "Unknown"}


def test_config_cadence():
    assert RunConfig().periods_per_year == 4 and RunConfig(cadence="M").periods_per_year == 12
