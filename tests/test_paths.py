"""Windows of price paths: no row is copied to its windows, and blocks of rows change nothing."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossrisk.functions import paths
from crossrisk.operators import asof, regress as R, returns
from crossrisk.plans import fundamental, macro as M, views as V

START = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(5)
    out = []
    for e in range(7):
        days = np.sort(rng.choice(700, size=20 + 60 * e, replace=False))
        out += [(f"e{e}", START + dt.timedelta(days=int(d)), float(c), float(v)) for d, c, v in zip(
            days, np.exp(np.cumsum(rng.normal(scale=0.05, size=len(days)))), rng.integers(0, 50, size=len(days)))]
    return pd.DataFrame(out, columns=["entity", "date", "adj_close", "volume"])


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_signals_are_those_of_trailing_windows(spark, walk, monkeypatch, block):
    monkeypatch.setattr(paths, "BLOCK_ROWS", block)
    signals = returns.price_signals(spark.createDataFrame(walk))
    assert "Window" not in plan_of(signals)
    got = signals.toPandas().sort_values(["entity", "date"]).reset_index(drop=True)
    want = []
    for _, g in walk.groupby("entity", sort=True):
        n = np.arange(1, len(g) + 1)
        day, close = pd.to_datetime(g["date"]), g["adj_close"].to_numpy()
        past = [day.searchsorted(day - pd.Timedelta(days=k), "right") - 1 for k in (30, 90)]
        mom = [np.where((p >= 0) & (n >= 10), close / close[np.maximum(p, 0)] - 1, np.nan) for p in past]
        vol = g["adj_close"].pct_change().rolling(60, min_periods=2).std().where(n >= 30) * np.sqrt(252)
        v20, v60 = (g["volume"].rolling(w, min_periods=1).mean() for w in (20, 60))
        want.append(np.column_stack([*mom, vol, (v20 / v60).where(n >= 60)]))
    np.testing.assert_allclose(got[["momentum_30d", "momentum_90d", "volatility_60d", "relative_volume"]].to_numpy(dtype=float),
                               np.vstack(want), rtol=1e-9)


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_forward_windows_are_slices_of_the_path(spark, walk, monkeypatch, block):
    monkeypatch.setattr(paths, "BLOCK_ROWS", block)
    dates = [dt.date(2020, 3, 31), dt.date(2020, 8, 31), dt.date(2021, 5, 31)]
    px = walk[["entity", "date", "adj_close"]].copy()
    px.loc[px.index % 9 == 4, "adj_close"] = np.nan
    frame = spark.createDataFrame([(e, d, None if np.isnan(c) else c) for e, d, c in px.itertuples(index=False)],
                                  "entity string, date date, adj_close double")
    out = asof.forward_stats(frame, spark.createDataFrame([(d,) for d in dates], "date date"), (1, 12), 6)
    assert "explode" not in plan_of(out)
    got = {(r["entity"], r["as_of"]): r for r in out.collect()}
    end = lambda d, m: (pd.Timestamp(d) + pd.DateOffset(months=m)).date()
    seen = 0
    for e, g in px.groupby("entity"):
        for d, period in zip(dates, (5, 9, None)):
            inside = lambda m: g[(g["date"] >= d) & (g["date"] <= end(d, m))]  # noqa: E731, B023
            if inside(12).empty:
                assert (e, d) not in got
                continue
            row, seen = got[e, d], seen + 1
            for name, m in (("fwd_ret_1m", 1), ("fwd_ret_12m", 12), ("period_ret", period)):
                part = inside(m)["adj_close"].to_numpy() if m else []
                ret = part[-1] / inside(12)["adj_close"].iloc[0] - 1 if len(part) >= 2 else np.nan
                assert row[name] is None if np.isnan(ret) else row[name] == pytest.approx(ret)
            part = inside(6)["adj_close"]
            fall = ((part.cummax() - part) / part.cummax()).max() if len(part) >= 2 else np.nan
            assert row["fwd_maxdd"] is None if np.isnan(fall) else row["fwd_maxdd"] == pytest.approx(fall)
    assert seen == len(got) and seen > 12


def _panel(rng, n=330):
    """Returns of entities with gaps, nulls, a flat stretch and far-off levels; one too short for a fit, one without a name."""
    rows = []
    for e, size in (("a", n), ("b", 61), ("c", 12), (None, 90)):
        x = rng.normal(size=(size, len(V.FACTORS))) + 1e4
        x[5:80, 1] = 7.0
        y = x[:, 0] * 0.4 + rng.normal(size=size)
        for i in range(size):
            xs = [None if rng.random() < 0.03 else float(v) for v in x[i]]
            rows.append((e, START + dt.timedelta(days=int(i)), None if i % 50 == 9 else float(y[i]), *xs))
    return rows


_PANEL = "entity string, date date, ret double, " + ", ".join(f"{f} double" for f in V.FACTORS)


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_one_factor_fits_are_those_of_copied_rows(spark, monkeypatch, block):
    monkeypatch.setattr(paths, "BLOCK_ROWS", block)
    df = spark.createDataFrame(_panel(np.random.default_rng(2)), _PANEL)
    got = M.each_factor(df, "ret", ["entity"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan and "Join" not in plan     # rows are dealt once and not copied
    long = df.unpivot(["entity", "date", "ret"], V.FACTORS, "which", "x")
    want = R.ols_hac(long, "ret", ["x"], ["entity", "which"])
    want = want.withColumn("factor", F.when(F.col("factor") == "x", F.col("which")).otherwise(F.col("factor")))
    assert got.columns == want.columns
    keys = ["entity", "which", "factor"]
    got, want = (d.toPandas().set_index(keys).sort_index() for d in (got, want))
    assert list(got.index) == list(want.index) and len(got) == 2 * 2 * len(V.FACTORS)
    for c in got.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("block", [1 << 16, 50])
@pytest.mark.parametrize("xs", [["A_F"], ["A_F", "A_O"]])
def test_rolling_betas_are_solved_many_at_once(spark, monkeypatch, block, xs):
    monkeypatch.setattr(paths, "BLOCK_ROWS", block)
    rows = _panel(np.random.default_rng(4))
    out = R.rolling_betas(spark.createDataFrame(rows, _PANEL), "ret", xs, 60, ["entity"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Window" not in plan and plan.count("Exchange") == 1
    got = {(r["entity"], r["date"], r["factor"]): r["beta"] for r in out.collect()}
    frame, seen = pd.DataFrame(rows, columns=["entity", "date", "ret", *V.FACTORS]), 0
    for e in ("a", "b", "c", None):
        own = frame[frame["entity"].isna() if e is None else frame["entity"] == e].dropna(subset=["ret", *xs])
        for i in range(59, len(own)):
            part = own.iloc[i - 59:i + 1]
            x = part[xs].to_numpy() - part[xs].to_numpy().mean(axis=0)
            want = np.linalg.pinv(x, rcond=1e-6) @ (part["ret"] - part["ret"].mean()).to_numpy()
            have = [got[e, part["date"].iloc[-1], f] for f in xs]
            np.testing.assert_allclose(have, want, rtol=1e-5, atol=1e-8)
            seen += 1
    assert seen * len(xs) == len(got) and seen > 200


def test_a_row_group_of_customers_is_dealt_before_its_items_are_made(spark, tmp_path, monkeypatch):
    """All customers lie in one row group, so without dealing one task makes and sums the items of all."""
    made = {}
    monkeypatch.setattr(fundamental.FU, "build_features", lambda stmt, *rest: made.setdefault("stmt", stmt))
    monkeypatch.setattr(V, "stmt", lambda *a: spark.createDataFrame([], "entity string, statement string, period_end date, item string, value double"))
    for name in ("prices", "filings"):
        monkeypatch.setattr(V, name, lambda *a: spark.createDataFrame([], "entity string, date date, adj_close double, volume double"))
    spark.createDataFrame([(i, "n", 1.0, "s") for i in range(1, 241)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string") \
        .coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = fundamental.features.__wrapped__(spark, str(tmp_path))
    assert "RepartitionByExpression" in plan_of(rows)
    assert rows.groupBy("entity").count().where("count <> 6").count() == 0 and rows.count() == 240 * 6
