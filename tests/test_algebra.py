import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossrisk.operators import assess, cluster, knn, pca, regress as R


@pytest.fixture(scope="module")
def reg():
    rng = np.random.default_rng(5)
    n = 120
    x = rng.normal(size=(n, 3))
    x[:, 1] += 0.5 * x[:, 0]
    y = 0.01 + x @ [0.5, -0.2, 0.0] + rng.normal(size=n) * 0.3
    d = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    return pd.DataFrame({"date": d, "y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})


def _hac(y, x, lags):
    X = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    s = X * (y - X @ b)[:, None]
    m = s.T @ s
    for k in range(1, lags + 1):
        g = s[k:].T @ s[:-k]
        m += (1 - k / (lags + 1)) * (g + g.T)
    return b, np.sqrt(np.diag(inv @ m @ inv))


def test_hac_ols_against_numpy(spark, reg):
    got = R.ols_hac(spark.createDataFrame(reg), "y", ["a", "b", "c"]).toPandas().set_index("factor")
    b, se = _hac(reg["y"].to_numpy(), reg[["a", "b", "c"]].to_numpy(), 5)
    for i, f in enumerate(["const", "a", "b", "c"]):
        assert got.loc[f, "beta"] == pytest.approx(b[i]) and got.loc[f, "std_err"] == pytest.approx(se[i])
        assert got.loc[f, "p_value"] == pytest.approx(math.erfc(abs(b[i] / se[i]) / math.sqrt(2)))
    corr = np.linalg.inv(np.corrcoef(reg[["a", "b", "c"]].T))
    assert got.loc["a", "vif"] == pytest.approx(corr[0, 0])


def test_short_groups_have_no_estimates(spark, reg):
    df = spark.createDataFrame(pd.concat([reg.assign(e="long"), reg.head(20).assign(e="short")]))
    out = R.ols_hac(df, "y", ["a"], ["e"]).select("e").distinct().collect()
    assert [r["e"] for r in out] == ["long"]


def test_residualized_equals_joint_fit(spark, reg):
    got = R.residualized(spark.createDataFrame(reg), "y", ["a"], ["b", "c"]).toPandas().set_index("factor")
    b, se = _hac(reg["y"].to_numpy(), reg[["a", "b", "c"]].to_numpy(), 5)
    assert got.loc["b", "beta"] == pytest.approx(b[2]) and got.loc["b", "std_err"] == pytest.approx(se[2])
    assert got.loc["a", "beta"] == pytest.approx(np.polyfit(reg["a"], reg["y"], 1)[0])
    assert abs(got.loc["b", "contribution"]) < 1e-9


def test_attribution_adds_up(spark, reg):
    out = R.attribution(spark.createDataFrame(reg), "y", "c", ["a", "b"]).collect()
    r = out[0]
    assert sum(x["contribution"] for x in out) == pytest.approx(r["explained"])
    assert r["total_active"] == pytest.approx(r["explained"] + r["selection"])


def test_pca_against_numpy(spark, reg):
    m = pca.fit(spark.createDataFrame(reg), ["y", "a", "b", "c"], (), 2).toPandas()
    val, vec = np.linalg.eigh(np.corrcoef(reg[["y", "a", "b", "c"]].T))
    v = vec[:, -1] * np.sign(vec[np.abs(vec[:, -1]).argmax(), -1])
    got = m[m["pc"] == "PC1"].set_index("feature").loc[["y", "a", "b", "c"], "loading"]
    np.testing.assert_allclose(got, v, atol=1e-9)
    assert m["variance_ratio"].max() == pytest.approx(val[-1] / 4)
    rows = spark.createDataFrame(reg.assign(entity=range(len(reg))))
    s = pca.project(rows, pca.fit(rows, ["y", "a", "b", "c"], (), 2), ["y", "a", "b", "c"], (), 2).toPandas()
    assert s["PC1"].std(ddof=0) ** 2 == pytest.approx(val[-1])


def test_return_pca_against_entity_matrix(spark):
    rng = np.random.default_rng(2)
    t, n = 30, 8
    x = rng.normal(size=(t, 1)) @ rng.normal(size=(1, n)) + rng.normal(size=(t, n))
    rows = [(f"e{j}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x[i, j])) for i in range(t) for j in range(n)]
    loads, scores, var = pca.corr_pca(spark.createDataFrame(rows, "entity string, date date, ret double"), 2)
    val, vec = np.linalg.eigh(np.corrcoef(x.T))
    v = var.toPandas().set_index("pc")
    assert v.loc["PC1", "eigenvalue"] == pytest.approx(val[-1]) and v.loc["PC1", "variance_ratio"] == pytest.approx(val[-1] / n)
    got = loads.where("pc = 'PC1'").orderBy("entity").toPandas()["loading"].to_numpy()
    want = vec[:, -1] * np.sign(vec[np.abs(vec[:, -1]).argmax(), -1])
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert scores.where("pc = 'PC1'").agg(F.var_samp("score")).first()[0] == pytest.approx(val[-1])


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(9)
    c = np.array([[0, 0], [8, 0], [0, 8]])
    pdf = pd.DataFrame(np.vstack([rng.normal(size=(20, 2)) + m for m in c]), columns=["PC1", "PC2"])
    return pdf.assign(entity=np.arange(60), cluster=np.repeat([0, 1, 2], 20))


def test_kmeans_finds_separated_groups(spark, blobs):
    df = spark.createDataFrame(blobs)
    labels, cents = cluster.kmeans(df.drop("cluster"), ["PC1", "PC2"], (3,), n_init=8)
    both = labels.withColumnRenamed("cluster", "found").join(df, "entity")
    assert cluster.adjusted_rand(both, "found", "cluster").first()["ari"] == 1.0
    assert cluster.adjusted_rand(df, "cluster", "cluster").first()["ari"] == 1.0
    within = sum(((g[["PC1", "PC2"]] - g[["PC1", "PC2"]].mean()) ** 2).sum().sum() for _, g in blobs.groupby("cluster"))
    assert cents.first()["inertia"] == pytest.approx(within)


@pytest.mark.parametrize("tile", [7, 2048])
def test_silhouettes_brute_force(spark, blobs, tile):
    df = spark.createDataFrame(blobs)
    x = blobs[["PC1", "PC2"]].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    lab = blobs["cluster"].to_numpy()
    want = []
    for i in range(60):
        a = d[i, lab == lab[i]].sum() / 19
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b))
    got = cluster.silhouette_points(df, ["PC1", "PC2"], tile=tile).orderBy("entity").toPandas()["silhouette"]
    np.testing.assert_allclose(got, want)
    squared = cluster.squared_silhouette_points(df, ["PC1", "PC2"]).orderBy("entity").toPandas()["silhouette"]
    want = []
    for i in range(60):
        a = (d[i, lab == lab[i]] ** 2).sum() / 19
        b = min((d[i, lab == c] ** 2).mean() for c in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b))
    np.testing.assert_allclose(squared, want)


def test_gap_tie_takes_lowest_cluster(spark):
    p = spark.createDataFrame([("a", 0.0)], "entity string, PC1 double")
    c = spark.createDataFrame([(1, 1.0), (0, -1.0)], "cluster int, PC1 double")
    r = cluster.gap(p, c, ["PC1"]).first()
    assert (r["cluster"], r["nearest_other"], r["gap"]) == (0, 1, 0.0)


def test_duplicate_style_names(spark):
    rows = [(str(i), i % 3, float(i % 3 == 0)) for i in range(30)]
    out = cluster.styles(spark.createDataFrame(rows, "entity string, cluster int, short_pct_float double"), ["short_pct_float"])
    assert sorted(r["style"] for r in out.collect()) == ["Core", "Core (2)", "Crowded / Volatile"]


def test_select_k_prefers_default_within_tolerance(spark):
    t = spark.createDataFrame([(3, 0.32), (4, 0.35), (5, 0.2)], "k int, silhouette double")
    assert cluster.select_k(t).first()["k"] == 3
    assert cluster.select_k(t, tol=0.01).first()["k"] == 4


def test_assessment_flags_and_unknown(spark, blobs):
    pts = spark.createDataFrame(blobs.assign(entity=blobs["entity"].astype(str)))
    day = dt.date(2020, 1, 1)
    s = spark.createDataFrame([(day, str(i), "s", float(i), i / 0.6, "Elevated" if i >= 48 else "In Line") for i in range(60)],
                              "date date, entity string, sector string, composite_score double, score_percentile double, risk_tier string")
    ranks = spark.createDataFrame([(day, str(i), "pe_ratio", float(i)) for i in range(60)], "date date, entity string, feature string, risk_pct double")
    held = spark.createDataFrame([(str(i), 0.1) for i in range(20)], "entity string, weight double")
    asked = spark.createDataFrame([("5",), ("59",), ("??",)], "entity string")
    out = {r["entity"]: r for r in assess.assess(asked, pts, s, ranks, held, ["PC1", "PC2"]).collect()}
    assert out["??"]["status"] == "not in universe" and out["59"]["recommendation"] == "AVOID"
    assert out["5"]["n_held"] == 5 and out["5"]["similarity"].startswith("highly") and out["5"]["recommendation"] == "PROCEED WITH CAVEATS"
    assert len(out["59"]["bullets"]) == 4


def test_factor_panel_keeps_more_than_a_thousand_factors(spark):
    from pyspark.sql import functions as F
    from crossrisk.operators import regress
    names = spark.range(1005).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("factor"))
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in ("2020-01-02", "2020-01-03", "2020-01-06")])).alias("date")
    levels = names.select("factor", days).withColumn("value", F.day("date").cast("double"))
    meta = names.select("factor", F.lit("log_return").alias("transform"), F.lit("daily").alias("frequency"))
    assert len(regress.factor_panel(levels, meta, []).columns) == 1006


def test_short_sample_and_empty_weights_are_errors(spark):
    import pytest
    from crossrisk.operators import pca, regress
    rows = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(20)], "date int, y double, x double")
    with pytest.raises(ValueError, match="complete rows"):
        regress.ols_hac(rows, "y", ["x"])
    with pytest.raises(ValueError, match="universe"):
        pca.align_weights(spark.createDataFrame([("A", 1.0)], "entity string, weight double"), spark.createDataFrame([("B",)], "entity string"))


def test_doubled_price_day_has_no_forward_return(spark):
    import datetime as dt
    from crossrisk.operators import asof
    day = dt.date(2020, 1, 2)
    prices = spark.createDataFrame([("A", day, 1.0), ("A", day, 1.0)], "entity string, date date, adj_close double")
    row = asof.forward_stats(prices, spark.createDataFrame([(day,)], "date date"), [1], 6).first()
    assert row["fwd_ret_1m"] is None and row["fwd_maxdd"] is None
