"""PCA, clustering, neighbours, trajectories, assessment and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FEATURES, K_CANDIDATES, N_INIT_FINAL, N_PCS, STYLE_DEFAULT, STYLE_FAMILIES, STYLE_TRIGGER
from ..operators import assess, audit, cluster, knn, pca, report, trajectory
from ..session import cut_lineage
from . import macro as M
from . import screen as SC

from . import views as V
from .registry import query, r6

PCS = V.PCS

DIMS = V.DIMS

V.SQL_VIEWS["cdist"] = (["points", "centroids"], f"""
    SELECT p.entity, p.cluster AS own, c.cluster, sqrt({V.squared("PC{i}", "c{i}")}) AS d FROM points p CROSS JOIN centroids c""")
V.SQL_VIEWS["pairs"] = (["points"], f"""
    SELECT a.entity, a.cluster, b.entity AS other, b.cluster AS other_cluster, sqrt({V.squared("a.PC{i}", "b.PC{i}")}) AS d
    FROM points a JOIN points b ON a.entity <> b.entity""")
V.SQL_VIEWS["sil"] = (["pairs"], """
    SELECT entity, cluster, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM (
      SELECT entity, cluster, max(m) FILTER (cluster = other_cluster) AS a, min(m) FILTER (cluster <> other_cluster) AS b
      FROM (SELECT entity, cluster, other_cluster, avg(d) AS m FROM pairs GROUP BY 1, 2, 3) GROUP BY 1, 2)""")


def last_screen(spark, sf_dir):
    """The newest cleaned cross-section."""
    rows = SC.screened(spark, sf_dir)
    return rows.withColumn("_l", rows.agg(F.max("date")).scalar()).where(F.col("date") == F.col("_l")).drop("_l")


@query("centroid_gap", "cdist", """
    SELECT entity, min_by(cluster, (d, cluster)) AS cluster, round(min(d), 6) AS distance,
           list(cluster ORDER BY d, cluster)[2] AS nearest_other, round(list(d ORDER BY d, cluster)[2] - min(d), 6) AS gap
    FROM cdist GROUP BY entity""")
def centroid_gap(spark, sf_dir):
    """J11, M10."""
    p = V.points(spark, sf_dir)
    return cluster.gap(p, cluster.centroids_of(p, DIMS), DIMS).select("entity", "cluster", r6("distance"), "nearest_other", r6("gap"))


@query("borderline", "cdist", """
    SELECT entity, round(g, 6) AS gap FROM (SELECT entity, list(d ORDER BY d, cluster)[2] - min(d) AS g FROM cdist GROUP BY entity) WHERE g < 0.05""")
def borderline(spark, sf_dir):
    """M11."""
    p = V.points(spark, sf_dir)
    return cluster.borderline(cluster.gap(p, cluster.centroids_of(p, DIMS), DIMS), 0.05).select("entity", r6("gap"))


@query("knn5", "pairs", """
    SELECT entity, other AS neighbour, round(d, 6) AS distance, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d, other) AS rank FROM pairs) WHERE rank <= 5""")
def knn5(spark, sf_dir):
    """Every point against every point, by pivot cells."""
    p = V.points(spark, sf_dir)
    return knn.nearest(p, p, DIMS, 5).select("entity", "neighbour", r6("distance"), F.col("rank").cast("long").alias("rank"))


@query("silhouette", "sil", "SELECT entity, cluster, round(silhouette, 6) AS silhouette FROM sil")
def silhouette(spark, sf_dir):
    """M6: per point."""
    return cluster.silhouette_points(V.points(spark, sf_dir), DIMS).select("entity", "cluster", r6("silhouette"))


V.SQL_VIEWS["sil2"] = (["pairs"], """
    SELECT entity, cluster, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM (
      SELECT entity, cluster, max(m) FILTER (cluster = other_cluster) AS a, min(m) FILTER (cluster <> other_cluster) AS b
      FROM (SELECT entity, cluster, other_cluster, avg(d * d) AS m FROM pairs GROUP BY 1, 2, 3) GROUP BY 1, 2)""")


@query("squared_silhouette", "sil2", "SELECT entity, cluster, round(silhouette, 6) + 0.0 AS silhouette FROM sil2")
def squared_silhouette(spark, sf_dir):
    """M6 with squared distances, per point, from cluster moments."""
    return cluster.squared_silhouette_points(V.points(spark, sf_dir), DIMS).select("entity", "cluster", r6("silhouette"))


@query("silhouette_by_cluster", "sil", """
    SELECT cluster, count(*) AS n, round(avg(silhouette), 6) AS silhouette FROM sil GROUP BY cluster""")
def silhouette_by_cluster(spark, sf_dir):
    """M6: per cluster."""
    s = cluster.silhouette_points(V.points(spark, sf_dir), DIMS)
    return s.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("silhouette"), "silhouette"))


@query("calinski", "cdist points centroids", f"""
    , w AS (SELECT sum(d * d) AS w FROM cdist WHERE own = cluster),
    g AS (SELECT {", ".join(f"avg(PC{i}) AS g{i}" for i in range(1, 65))}, count(*) AS n, count(DISTINCT cluster) AS k FROM points),
    b AS (SELECT sum(m * ({V.squared("c{i}", "g{i}")})) AS b
          FROM centroids JOIN (SELECT cluster, count(*) AS m FROM points GROUP BY cluster) USING (cluster), g)
    SELECT n, k, round(w, 6) AS inertia, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM w, g, b""")
def calinski(spark, sf_dir):
    """M7."""
    return cluster.calinski(V.points(spark, sf_dir), DIMS).select("n", "k", r6("inertia"), r6("calinski_harabasz"))


@query("separation", "cdist centroids", f"""
    , w AS (SELECT avg(d) AS w FROM cdist WHERE own = cluster),
    b AS (SELECT avg(sqrt({V.squared("a.c{i}", "b.c{i}")})) AS b
          FROM centroids a JOIN centroids b ON a.cluster < b.cluster)
    SELECT round(b, 6) AS between_, round(w, 6) AS within_, round(b / w, 6) AS ratio, b / w < 1.5 AS weak FROM w, b""")
def separation(spark, sf_dir):
    """M14."""
    return cluster.separation(V.points(spark, sf_dir), DIMS).select(r6("between", "between_"), r6("within", "within_"), r6("ratio"), "weak")


@query("ari", "points", """
    , c AS (SELECT cluster AS a, CAST(PC1 > 0 AS INT) + 2 * CAST(PC2 > 0 AS INT) AS b, count(*) AS m FROM points GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(m * (m - 1) / 2) FROM c) AS ij, (SELECT sum(m) FROM c) AS n,
                 (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(m) AS m FROM c GROUP BY a)) AS ai,
                 (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(m) AS m FROM c GROUP BY b)) AS bj)
    SELECT round((ij - ai * bj / (n * (n - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2)), 6) AS ari FROM s""")
def ari(spark, sf_dir):
    """Labels against the quadrant of the first two components."""
    p = V.points(spark, sf_dir).withColumn("b", (F.col("PC1") > 0).cast("int") + 2 * (F.col("PC2") > 0).cast("int"))
    return cluster.adjusted_rand(p, "cluster", "b").select(r6("ari"))


@query("cluster_balance", "points", """
    SELECT cluster, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () > 0.5 AS dominant, n / sum(n) OVER () < 0.03 AS tiny,
           round(max(n) OVER () / min(n) OVER (), 6) AS imbalance FROM (SELECT cluster, count(*) AS n FROM points GROUP BY cluster)""")
def cluster_balance(spark, sf_dir):
    """A21."""
    return cluster.balance(V.points(spark, sf_dir)).select("cluster", "n", r6("share"), "dominant", "tiny", r6("imbalance"))


V.SQL_VIEWS["clustered"] = (["screen"], "SELECT *, CAST(entity AS BIGINT) % 4 AS cluster FROM screen WHERE date = (SELECT max(date) FROM screen)")
V.SQL_VIEWS["zclust"] = (["clustered"], "SELECT entity, cluster, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}" for c in FEATURES)
    + " FROM clustered")


V.SQL_VIEWS["clustered_dates"] = (["screen"], "SELECT *, CAST(entity AS BIGINT) % 4 AS cluster FROM screen")
V.SQL_VIEWS["zclust_dates"] = (["clustered_dates"], "SELECT date, entity, cluster, " + ", ".join(
    f"({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 0 THEN stddev_pop({c}) OVER w ELSE 1 END AS {c}" for c in FEATURES)
    + " FROM clustered_dates WINDOW w AS (PARTITION BY date)")


def clustered(spark, sf_dir):
    return last_screen(spark, sf_dir).withColumn("cluster", F.col("entity").cast("long") % 4)


def clustered_dates(spark, sf_dir):
    """Every cross-section with the same fixed partition."""
    return SC.screened(spark, sf_dir).withColumn("cluster", F.col("entity").cast("long") % 4)


@query("cluster_profile", "clustered", " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median FROM clustered GROUP BY cluster"
    for c in FEATURES))
def cluster_profile(spark, sf_dir):
    """A3: the clusters here are a fixed partition of the suppliers."""
    return cluster.characterize(clustered(spark, sf_dir), FEATURES).select("cluster", "feature", "n", r6("mean"), r6("median"))


@query("cluster_profile_by_date", "clustered_dates", " UNION ALL ".join(
    f"SELECT date, cluster, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median "
    f"FROM clustered_dates GROUP BY date, cluster" for c in FEATURES))
def cluster_profile_by_date(spark, sf_dir):
    """A3: every quarter."""
    out = cluster.characterize(clustered_dates(spark, sf_dir), FEATURES, ["date"])
    return out.select("date", "cluster", "feature", "n", r6("mean"), r6("median"))


_FLIPS = {"altman_z", "current_ratio", "fcf_yield", "interest_coverage", "accruals_ratio", "momentum_30d", "momentum_90d"}


@query("cluster_risk_rank", "zclust", f"""
    SELECT cluster, round(avg(({" + ".join(("-" if c in _FLIPS else "") + c for c in FEATURES)}) / 16), 6) AS risk,
           row_number() OVER (ORDER BY avg({" + ".join(("-" if c in _FLIPS else "") + c for c in FEATURES)})) - 1 AS risk_rank
    FROM zclust GROUP BY cluster""")
def cluster_risk_rank(spark, sf_dir):
    """W29, M1."""
    out = cluster.risk_rank(clustered(spark, sf_dir), FEATURES)
    return out.select("cluster", r6("risk"), F.col("risk_rank").cast("long").alias("risk_rank"))


@query("cluster_risk_rank_by_date", "zclust_dates", f"""
    SELECT date, cluster, round(avg(r / 16), 6) + 0.0 AS risk, row_number() OVER (PARTITION BY date ORDER BY avg(r), cluster) - 1 AS risk_rank
    FROM (SELECT date, cluster, {" + ".join(("-" if c in _FLIPS else "") + c for c in FEATURES)} AS r FROM zclust_dates) GROUP BY date, cluster""")
def cluster_risk_rank_by_date(spark, sf_dir):
    """Every quarter."""
    out = cluster.risk_rank(clustered_dates(spark, sf_dir), FEATURES, ["date"])
    return out.select("date", "cluster", r6("risk"), F.col("risk_rank").cast("long").alias("risk_rank"))


@query("zscores", "zclust", "SELECT entity, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FEATURES) + " FROM zclust")
def zscores(spark, sf_dir):
    """M1."""
    return pca.standardize(last_screen(spark, sf_dir), FEATURES, ()).select("entity", *[r6(c) for c in FEATURES])


@query("zscores_by_date", "zclust_dates", "SELECT date, entity, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FEATURES)
       + " FROM zclust_dates")
def zscores_by_date(spark, sf_dir):
    """M1: every quarter."""
    return pca.standardize(SC.screened(spark, sf_dir), FEATURES, ["date"]).select("date", "entity", *[r6(c) for c in FEATURES])


def _family(members, sign):
    here = [c for c in members if c in FEATURES]
    return f"{sign} * (" + " + ".join(f"avg({c})" for c in here) + f") / {len(here)}"


@query("cluster_styles", "zclust_dates", f"""
    , m AS (SELECT date, cluster, {", ".join(f"{_family(members, sign)} AS f{i}" for i, (_, members, sign) in enumerate(STYLE_FAMILIES))}
            FROM zclust_dates GROUP BY date, cluster),
    named AS (SELECT date, cluster, CASE WHEN greatest({", ".join(f"f{i}" for i in range(len(STYLE_FAMILIES)))}) <= {STYLE_TRIGGER} THEN '{STYLE_DEFAULT}'
      {" ".join(f"WHEN f{i} = greatest({', '.join(f'f{j}' for j in range(len(STYLE_FAMILIES)))}) THEN '{name}'" for i, (name, _, _) in enumerate(STYLE_FAMILIES))}
      END AS name FROM m)
    SELECT date, cluster, name || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END AS style
    FROM (SELECT *, row_number() OVER (PARTITION BY date, name ORDER BY cluster) AS n FROM named)""")
def cluster_styles(spark, sf_dir):
    """Every quarter."""
    return cluster.styles(clustered_dates(spark, sf_dir), FEATURES, ["date"])


@query("cluster_top_sectors", "clustered", """
    SELECT cluster, string_agg(sector, ', ' ORDER BY n DESC, sector) AS sectors FROM (
      SELECT cluster, sector, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, sector) AS r
      FROM clustered GROUP BY cluster, sector) WHERE r <= 3 GROUP BY cluster""")
def cluster_top_sectors(spark, sf_dir):
    """A25."""
    return report.top_sectors(clustered(spark, sf_dir))


@query("cluster_top_sectors_by_date", "clustered_dates", """
    SELECT date, cluster, string_agg(sector, ', ' ORDER BY n DESC, sector) AS sectors FROM (
      SELECT date, cluster, sector, count(*) AS n, row_number() OVER (PARTITION BY date, cluster ORDER BY count(*) DESC, sector) AS r
      FROM clustered_dates GROUP BY date, cluster, sector) WHERE r <= 3 GROUP BY date, cluster""")
def cluster_top_sectors_by_date(spark, sf_dir):
    """Every quarter."""
    return report.top_sectors(clustered_dates(spark, sf_dir), by=["date"])


# ---- PCA --------------------------------------------------------------------------------------

@V.stored
def last_model(spark, sf_dir):
    return pca.fit(last_screen(spark, sf_dir), FEATURES, (), N_PCS)


@V.stored
def last_points(spark, sf_dir):
    return pca.project(last_screen(spark, sf_dir), last_model(spark, sf_dir), FEATURES)


@V.stored
def last_clusters(spark, sf_dir):
    return cluster.kmeans(last_points(spark, sf_dir), PCS, (3,), n_init=N_INIT_FINAL)[1].select("cluster", *PCS, "inertia")


@V.stored
def date_points(spark, sf_dir):
    """Scores of every quarter under its own model."""
    rows = SC.screened(spark, sf_dir)
    return pca.project(rows, cut_lineage(pca.fit(rows, FEATURES, ["date"], N_PCS)), FEATURES, ["date"])


@V.stored
def date_labels(spark, sf_dir):
    """Scores of every quarter with their clusters."""
    p = date_points(spark, sf_dir)
    return p.join(cluster.kmeans(p, PCS, (3,), ["date"], N_INIT_FINAL)[0].drop("k"), ["date", "entity"])


@V.stored
def date_stability(spark, sf_dir):
    """Mean cosine per component and mean adjusted Rand index (pc ``ARI``) of every quarter."""
    cosine, rand = audit.stability(SC.screened(spark, sf_dir), FEATURES, iterations=10, by=["date"])
    return (cosine.select("date", "pc", F.col("mean_cosine").alias("value"))
            .unionByName(rand.select("date", F.lit("ARI").alias("pc"), F.col("mean_ari").alias("value"))))


@query("pca_by_date")
def pca_by_date(spark, sf_dir):
    """M2: every quarter's model from one aggregate; identities are tested with numpy."""
    return pca.explained(pca.fit(SC.screened(spark, sf_dir), FEATURES, ["date"]), ["date"]).select(
        "date", "pc", r6("variance_ratio"), r6("cumulative"))


@query("pca_total_variance", "clustered", """
    SELECT CAST(16 AS DOUBLE) AS total FROM clustered LIMIT 1""")
def pca_total_variance(spark, sf_dir):
    """M2: eigenvalues of a correlation matrix sum to the number of varying features."""
    model = pca.fit(last_screen(spark, sf_dir), FEATURES, (), len(FEATURES))
    return model.groupBy("pc").agg(F.max("eigenvalue").alias("e")).agg(r6(F.sum("e"), "total"))


V.SQL_VIEWS["long_screen"] = (["screen"], f"""
    SELECT date, entity, feature, x, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s
    FROM (UNPIVOT screen ON {", ".join(FEATURES)} INTO NAME feature VALUE x) WINDOW w AS (PARTITION BY date, feature)""")


@query("pca_total_variance_by_date", "long_screen", """
    SELECT date, CAST(count(DISTINCT feature) FILTER (s > 0) AS DOUBLE) AS total FROM long_screen GROUP BY date""")
def pca_total_variance_by_date(spark, sf_dir):
    """M2: every quarter."""
    model = pca.fit(SC.screened(spark, sf_dir), FEATURES, ["date"], len(FEATURES))
    return model.groupBy("date", "pc").agg(F.max("eigenvalue").alias("e")).groupBy("date").agg(r6(F.sum("e"), "total"))


@query("pca_rebuilt_correlation", "long_screen", """
    SELECT a.date, a.feature AS left_feature, b.feature AS right_feature,
           round(avg(CASE WHEN a.s > 0 AND b.s > 0 THEN (a.x - a.m) / a.s * ((b.x - b.m) / b.s) ELSE 0 END), 6) + 0.0 AS correlation
    FROM long_screen a JOIN long_screen b ON a.date = b.date AND a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2, 3""")
def pca_rebuilt_correlation(spark, sf_dir):
    """M2: all components of every quarter; eigenvalues and loadings give the correlations back."""
    model = cut_lineage(pca.fit(SC.screened(spark, sf_dir), FEATURES, ["date"], len(FEATURES)))
    left = model.select("date", "pc", F.col("feature").alias("left_feature"), "eigenvalue", F.col("loading").alias("a"))
    right = model.select("date", "pc", F.col("feature").alias("right_feature"), F.col("loading").alias("b"))
    both = left.join(right, ["date", "pc"]).where("left_feature < right_feature")
    return both.groupBy("date", "left_feature", "right_feature").agg(r6(F.sum(F.col("eigenvalue") * F.col("a") * F.col("b")), "correlation"))


@query("pca_score_norms", "long_screen", """
    SELECT date, entity, round(sum(CASE WHEN s > 0 THEN ((x - m) / s) ** 2 ELSE 0 END), 6) AS norm FROM long_screen GROUP BY date, entity""")
def pca_score_norms(spark, sf_dir):
    """M3: scores on all components have the length of the standardized row."""
    rows = SC.screened(spark, sf_dir)
    model = pca.fit(rows, FEATURES, ["date"], len(FEATURES))
    scores = pca.project(rows, model, FEATURES, ["date"], len(FEATURES))
    return scores.select("date", "entity", r6(sum((F.col(f"PC{i + 1}") ** 2 for i in range(len(FEATURES))), F.lit(0.0)), "norm"))


@query("pc_labels")
def pc_labels(spark, sf_dir):
    """M4."""
    return pca.label_components(pca.fit(SC.screened(spark, sf_dir), FEATURES, ["date"]), ["date"])


@query("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    """Every k of every quarter in the same jobs."""
    out = cluster.sweep(date_points(spark, sf_dir), PCS, K_CANDIDATES, ["date"])
    return out.select("date", "k", r6("silhouette"), r6("smallest"), r6("largest"), r6("calinski_harabasz"), r6("inertia"))


@query("selected_k")
def selected_k(spark, sf_dir):
    """M8: every quarter."""
    return cluster.select_k(cluster.sweep(date_points(spark, sf_dir), PCS, K_CANDIDATES, ["date"]), by=["date"])


@query("clusters_by_date")
def clusters_by_date(spark, sf_dir):
    """B1, M2, M5, M9: PCA, k-means and styles of every quarter in the same jobs."""
    out = cluster.cluster_cross_sections(SC.screened(spark, sf_dir), FEATURES, ["date"])
    return out.groupBy("date", "cluster", "cluster_style").agg(F.count(F.lit(1)).alias("n"))


def recent_returns(spark, sf_dir, months: int | None = 12):
    """Returns of the look-back window; None: the whole history."""
    from ..operators import returns
    rets = returns.simple_returns(V.prices(spark, sf_dir))
    if months is None:
        return rets
    return rets.withColumn("_e", rets.agg(F.max("date")).scalar()).where(F.col("date") > F.add_months("_e", -months)).drop("_e")


def _return_pca(rets):
    loads, scores, var = pca.corr_pca(rets, 5)
    size = loads.groupBy("pc").agg(F.count(F.lit(1)).alias("n_entities"), r6(F.sum(F.col("loading") ** 2), "norm"))
    days = scores.groupBy("pc").agg(F.count(F.lit(1)).alias("n_days"))
    return (var.join(size, "pc").join(days, "pc")
            .select("pc", r6("eigenvalue"), r6("variance_ratio"), "n_entities", "norm",
                    r6(pca.marchenko_pastur(F.col("n_entities"), F.col("n_days")), "noise_edge")))


@query("return_pca")
def return_pca(spark, sf_dir):
    """Entity correlation structure of the look-back window."""
    return _return_pca(recent_returns(spark, sf_dir))


@query("return_pca_all")
def return_pca_all(spark, sf_dir):
    """The same over the whole history."""
    return _return_pca(recent_returns(spark, sf_dir, None))


@query("split_half")
def split_half(spark, sf_dir):
    """R3, O11."""
    return pca.split_half(recent_returns(spark, sf_dir, None), 3).select("pc", r6("cosine"), "verdict")


@query("portfolio_projection")
def portfolio_projection(spark, sf_dir):
    """Weights on components, tilt and variance shares."""
    rets, held = recent_returns(spark, sf_dir), V.holdings(spark, sf_dir)
    loads, _, var = pca.corr_pca(rets, 5)
    loads = cut_lineage(loads)
    shares = pca.variance_decomposition(loads, var, held, rets).select("pc", "share")
    return (shares.join(pca.active_exposure(loads, held), "pc", "left")
            .select("pc", r6("share"), r6("portfolio"), r6("universe"), r6("active_z"), "tilt"))


@query("factor_themes")
def factor_themes(spark, sf_dir):
    """Themes of the factor library and the exposures of three return series."""
    d = M.sample(spark, sf_dir)
    long = d.withColumn("active", F.col("port") - F.col("bench")).unpivot("date", ["port", "bench", "active"], "which", "ret")
    out = pca.factor_pca(M.factors(spark, sf_dir), long, V.FACTORS)
    if out is None:                                  # too little history for themes
        return spark.createDataFrame([], "which string, factor string, label string, beta double, p_value double, r2 double")
    return (out["fits"].where("factor <> 'const'").join(out["labels"], out["fits"]["factor"] == out["labels"]["pc"])
            .select("which", "factor", "label", r6("beta"), r6("p_value"), r6("r2")))


@query("pc_factor_correlation", "points", """
    SELECT 'PC1' AS pc, round(corr(PC1, PC2), 6) AS c2, round(corr(PC1, PC3), 6) AS c3 FROM points
    UNION ALL SELECT 'PC4', round(corr(PC4, PC2), 6), round(corr(PC4, PC3), 6) FROM points""")
def pc_factor_correlation(spark, sf_dir):
    """Scores against factor columns on their common keys."""
    p = V.points(spark, sf_dir).withColumnRenamed("entity", "date")
    scores = p.unpivot("date", ["PC1", "PC4"], "pc", "score")
    left = p.select("date", F.col("PC2").alias("f2"))
    right = p.select("date", F.col("PC3").alias("f3"))
    merged = pca.join_factors(left, right, p.select("date", F.lit(0.0).alias("RF")))
    return pca.factor_correlation(scores, merged, ["f2", "f3", "RF"]).select("pc", r6("f2", "c2"), r6("f3", "c3"))


# ---- trajectories -----------------------------------------------------------------------------

V.SQL_VIEWS["paths"] = (["scores", "ranks"], """
    SELECT s.date, s.entity, CASE s.risk_tier WHEN 'Low Risk' THEN 0 WHEN 'In Line' THEN 1 ELSE 2 END AS cluster, r.PC1, r.PC2
    FROM scores s JOIN (SELECT date, entity, max(risk_pct) FILTER (feature = 'pe_ratio') / 50 AS PC1,
                               max(risk_pct) FILTER (feature = 'current_ratio') / 50 AS PC2 FROM ranks GROUP BY 1, 2) r USING (date, entity)""")
V.SQL_VIEWS["drifts"] = (["paths"], """
    SELECT entity, sum(step) AS distance_traveled, max_by(step, date) AS last_drift, count(*) AS n_snapshots FROM (
      SELECT *, sqrt((PC1 - lag(PC1) OVER w) ** 2 + (PC2 - lag(PC2) OVER w) ** 2) AS step FROM paths
      WINDOW w AS (PARTITION BY entity ORDER BY date)) GROUP BY entity""")


@V.stored
def paths(spark, sf_dir):
    """Paths over the quarters: two risk ranks as coordinates, the tier as cluster."""
    pick = lambda f: (F.max(F.when(F.col("feature") == f, F.col("risk_pct"))) / 50)
    coords = SC.ranks(spark, sf_dir).groupBy("date", "entity").agg(pick("pe_ratio").alias("PC1"), pick("current_ratio").alias("PC2"))
    tier = F.when(F.col("risk_tier") == "Low Risk", 0).when(F.col("risk_tier") == "In Line", 1).otherwise(2)
    return SC.scores(spark, sf_dir).select("date", "entity", tier.alias("cluster")).join(coords, ["date", "entity"])


def _tier_ranks(spark):
    return spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "cluster int, risk_rank int")


@query("path_drift", "drifts", """
    SELECT entity, round(distance_traveled, 6) AS distance_traveled, round(last_drift, 6) AS last_drift, n_snapshots,
           coalesce(last_drift >= (SELECT avg(last_drift) + 1.5 * stddev_samp(last_drift) FROM drifts), false) AS large_drift FROM drifts""")
def path_drift(spark, sf_dir):
    """W16, W18."""
    out = trajectory.large_drift(trajectory.drift(paths(spark, sf_dir), ["PC1", "PC2"]))
    return out.select("entity", r6("distance_traveled"), r6("last_drift"), "n_snapshots", "large_drift")


@query("transitions", "paths", """
    SELECT entity, CAST(coalesce(sum(c), 0) AS BIGINT) AS transitions, coalesce(max_by(c, date) = 1, false) AS crossed_last FROM (
      SELECT *, CAST(cluster <> lag(cluster) OVER (PARTITION BY entity ORDER BY date) AS INT) AS c FROM paths) GROUP BY entity""")
def transitions(spark, sf_dir):
    """W17."""
    return trajectory.transitions(paths(spark, sf_dir))


@query("direction", "paths", """
    SELECT entity, CASE WHEN count(*) < 2 THEN 'Unknown' WHEN max_by(cluster, date) > min_by(cluster, date) THEN 'Deteriorating'
                        WHEN max_by(cluster, date) < min_by(cluster, date) THEN 'Improving' ELSE 'Steady' END AS direction
    FROM paths GROUP BY entity""")
def direction(spark, sf_dir):
    """W19."""
    return trajectory.direction(paths(spark, sf_dir), _tier_ranks(spark))


@query("headline_direction", "scores holdings paths", """
    , d AS (SELECT entity, CASE WHEN count(*) < 2 THEN 'Unknown' WHEN max_by(cluster, date) > min_by(cluster, date) THEN 'Deteriorating'
                                ELSE 'other' END AS direction FROM paths GROUP BY entity)
    SELECT date, round(sum(weight * composite_score) / sum(weight), 6) AS weighted_score, count(*) FILTER (risk_tier = 'Elevated') AS n_elevated,
           count(*) AS n_held, count(*) FILTER (direction = 'Deteriorating') AS n_deteriorating
    FROM scores JOIN holdings USING (entity) LEFT JOIN d USING (entity) GROUP BY date""")
def headline_direction(spark, sf_dir):
    """A24 with W19: holdings that moved to a riskier cluster since their first snapshot."""
    moved = trajectory.direction(paths(spark, sf_dir), _tier_ranks(spark))
    return (report.headline(SC.scores(spark, sf_dir), V.holdings(spark, sf_dir), ["date"], moved)
            .select("date", r6("weighted_score"), "n_elevated", "n_held", "n_deteriorating"))


@query("segments", "paths", """
    SELECT entity, date, CASE WHEN cluster > p THEN 'riskier' WHEN cluster < p THEN 'safer' ELSE 'same' END AS segment FROM (
      SELECT *, lag(cluster) OVER (PARTITION BY entity ORDER BY date) AS p FROM paths) WHERE p IS NOT NULL""")
def segments(spark, sf_dir):
    """W20."""
    return trajectory.segments(paths(spark, sf_dir), _tier_ranks(spark))


@query("nested_paths", "paths", """
    SELECT entity, count(*) AS n, min(date) AS first_date, min_by(cluster, date) AS first_cluster FROM paths GROUP BY entity""")
def nested_paths(spark, sf_dir):
    """K5: nested documents, unfolded here for the comparison."""
    docs = trajectory.nested(paths(spark, sf_dir), ["PC1", "PC2"])
    first = F.get("path", F.lit(0))
    return docs.select("entity", F.size("path").cast("long").alias("n"), first["date"].alias("first_date"),
                       first["cluster"].alias("first_cluster"))


@query("drift_alerts")
def drift_alerts(spark, sf_dir):
    """The fitted model applied to four snapshots 91 days apart, then the alert rules."""
    from ..operators import asof, clean
    feats = V.features_pit(spark, sf_dir)
    last = feats.agg(F.max("date").alias("d"))
    days = last.select(asof.step_back(F.col("d"), 4, 91).alias("a")).scalar()
    snaps = asof.features_asof(feats, days).drop("src_date").withColumnRenamed("as_of", "date")
    med = clean.median_row(last_screen(spark, sf_dir), FEATURES, [])
    p = cut_lineage(trajectory.build(snaps, last_model(spark, sf_dir), last_clusters(spark, sf_dir).drop("inertia"), FEATURES, med))
    drifts = trajectory.large_drift(trajectory.drift(p, PCS))
    gaps = cluster.gap(last_points(spark, sf_dir), last_clusters(spark, sf_dir).drop("inertia"), PCS)
    out = trajectory.alerts(gaps, drifts, trajectory.transitions(p), V.holdings(spark, sf_dir))
    return out.select("entity", "is_portfolio", r6("gap"), "borderline", "crossed_last", "large_drift", r6("last_drift"))


# ---- assessment and audits --------------------------------------------------------------------

@query("assessment")
def assessment(spark, sf_dir):
    """Every name outside the portfolio as candidate, plus one unknown."""
    last = last_screen(spark, sf_dir)
    cand = last.select("entity").join(V.holdings(spark, sf_dir), "entity", "left_anti").union(
        last.limit(1).select(F.lit("NOBODY")))
    s = SC.scores(spark, sf_dir).join(last.select("date", "entity"), ["date", "entity"], "left_semi")
    rk = SC.ranks(spark, sf_dir).join(last.select("date", "entity"), ["date", "entity"], "left_semi")
    out = assess.assess(cand, last_points(spark, sf_dir), s, rk, V.holdings(spark, sf_dir), PCS)
    return out.select("entity", "status", "n_held", "similarity", r6("diversification"), "risk_tier", r6("sector_delta"),
                      "recommendation", "rationale")


@query("feature_audit", "features_pit screen", " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, round(count(f.{c}) / count(*), 6) AS coverage, round(stddev_pop(f.{c}), 6) AS raw_std,
           round(quantile_cont(f.{c}, 0.05), 6) AS raw_p5, round(quantile_cont(f.{c}, 0.95), 6) AS raw_p95,
           round(skewness(s.{c}), 5) AS skewness, round(kurtosis(s.{c}), 5) AS kurtosis,
           round((quantile_cont(s.{c}, 0.95) - quantile_cont(s.{c}, 0.05)) / stddev_pop(s.{c}), 6) AS standardized_range
    FROM features_pit f LEFT JOIN screen s USING (date, entity)""" for c in FEATURES))
def feature_audit(spark, sf_dir):
    """A20."""
    raw, clean_rows = V.features_pit(spark, sf_dir), SC.screened(spark, sf_dir)
    points = clean_rows.select("date", "entity", F.col("pe_ratio").alias("PC1"), F.col("volatility_60d").alias("PC2"))
    out = audit.feature_audit(raw, clean_rows, points, FEATURES, ["PC1", "PC2"], ["date", "entity"])
    return out.select("feature", r6("coverage"), r6("raw_std"), r6("raw_p5"), r6("raw_p95"),
                      (F.round("skewness", 5) + F.lit(0.0)).alias("skewness"), (F.round("kurtosis", 5) + F.lit(0.0)).alias("kurtosis"),
                      r6("standardized_range"))


@query("subsample_exact", "points", """
    SELECT CAST(i AS BIGINT) AS iteration, CAST(floor(count(*) * 0.8) AS BIGINT) AS n FROM points, (SELECT unnest(range(0, 4)) AS i) GROUP BY i""")
def subsample_exact(spark, sf_dir):
    """Exact counts."""
    out = audit.subsample(V.points(spark, sf_dir), [], 0.8, 42, 4)
    return out.groupBy(F.col("iteration").cast("long").alias("iteration")).agg(F.countDistinct("entity").alias("n"))


@query("stability")
def stability(spark, sf_dir):
    """Every quarter."""
    return date_stability(spark, sf_dir).select("date", "pc", r6("value"))


@query("ablation")
def ablation(spark, sf_dir):
    """Every quarter."""
    out = audit.ablation(SC.screened(spark, sf_dir), FEATURES, by=["date"])
    return out.select("date", "config", "n_features", r6("silhouette"), r6("ari"))


@query("entity_audit")
def entity_audit(spark, sf_dir):
    """Holdings as the audited names."""
    last = last_screen(spark, sf_dir)
    raw = V.features_pit(spark, sf_dir).join(last.select("date", "entity"), ["date", "entity"], "left_semi")
    parts = audit.entity_audit(V.holdings(spark, sf_dir), raw, last, last_model(spark, sf_dir), last_clusters(spark, sf_dir), FEATURES, PCS)
    return parts["contributions"].select("entity", "pc", "feature", r6("contribution"), "rank")


@query("diagnostics")
def diagnostics(spark, sf_dir):
    """Issues of every quarter's clustering, with its measured stability."""
    labels, stable = date_labels(spark, sf_dir), date_stability(spark, sf_dir)
    return audit.issues(cluster.balance(labels, ["date"]), cluster.silhouette(labels, PCS, ["date"]),
                        stable.where("pc <> 'ARI'").withColumnRenamed("value", "mean_cosine"),
                        stable.where("pc = 'ARI'").withColumnRenamed("value", "mean_ari"), ["date"])
