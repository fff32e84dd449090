"""k-means, cluster quality and cluster descriptions, for one or many groups of points at once.

Groups (date, iteration, configuration, k) are key columns.  Centroid tables are groups x starts x k rows; points are
only ever aggregated, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import DEFAULT_K, N_INIT, N_INIT_FINAL, RISK_DIRECTION, SILHOUETTE_TOLERANCE, STYLE_DEFAULT, STYLE_FAMILIES, STYLE_TRIGGER
from ..session import cut_lineage
from . import lloyd, pairwise
from .clean import to_long
from .gram import ONE, key_schema, keyed
from .pca import standardize
from .scoring import top_k
from .starts import oversampled

BROADCAST_BYTES = 64 << 20
MOST_PAIRWISE = 8_000_000       # some 120 blocks, whose sums still fit into a task


def _distance(pcs: Sequence[str], center: Column) -> Column:
    sq = sum(((F.col(p) - center[i]) * (F.col(p) - center[i]) for i, p in enumerate(pcs[1:], 1)),
             (F.col(pcs[0]) - center[0]) * (F.col(pcs[0]) - center[0]))
    return F.sqrt(sq)


def _center_sets(state: DataFrame, keys: Sequence[str], pcs: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """One row per group: every (k, start) with its centers in id order."""
    centers = state.groupBy(*keys, *extra).agg(
        F.array_sort(F.collect_list(F.struct("cluster", F.array(*pcs).alias("c")))).alias("centers"))
    return centers.groupBy(*keys).agg(F.collect_list(F.struct(*extra, "centers")).alias("_sets"))


def _with_sets(blocks: DataFrame, state: DataFrame, keys: Sequence[str], pcs: Sequence[str], extra: Sequence[str]) -> DataFrame:
    sets = _center_sets(state, keys, pcs, extra)
    size = state.count() * 8 * (len(pcs) + 4)
    if size <= BROADCAST_BYTES:                     # measured; larger center tables are joined by key
        sets = F.broadcast(sets)
    return blocks.join(sets, list(keys))


def kmeans(points: DataFrame, pcs: Sequence[str], ks: Sequence[int] = (DEFAULT_K,), by: Sequence[str] = (),
           n_init: int = N_INIT, max_iter: int = 300, tol: float = 1e-8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Best of ``n_init`` Lloyd runs per group and k (M5): (assignments with ``k``, centroids with ``inertia``).

    Every run of every group advances in the same job: blocks of points return sums per center (``lloyd``), and a group of one
    block comes to rest inside it.  Starts are oversampled (``starts.oversampled``).  A center that loses all points stays.
    Runs go on until no center moves; those that have come to rest are set aside.  More than ``max_iter`` rounds are an error.
    """
    rows, keys = keyed(points, by)
    rows = cut_lineage(rows.select(*keys, "entity", *pcs).dropna())
    blocks = lloyd.blocked(rows, keys, pcs)
    extra, names = ["k", "start"], key_schema(rows, keys)
    state = oversampled(rows, keys, pcs, ks, n_init, seed, BROADCAST_BYTES, blocks)
    state, resting = cut_lineage(state), None
    for i in range(max_iter):
        sums = (_with_sets(blocks, state, keys, pcs, extra)
                .mapInArrow(lloyd.steps(keys, len(pcs), max_iter, tol), f"{names}, k int, start int, cluster int, m long, x array<double>"))
        moved = sums.groupBy(*keys, *extra, "cluster").agg(
            *[(F.sum(F.get("x", F.lit(i))) / F.sum("m")).alias(f"_n{i}") for i in range(len(pcs))])
        new = state.join(moved, [*keys, *extra, "cluster"], "left").select(
            *keys, *extra, "cluster", *[F.coalesce(f"_n{i}", p).alias(p) for i, p in enumerate(pcs)],
            F.greatest(*[F.abs(F.coalesce(f"_n{i}", p) - F.col(p)) for i, p in enumerate(pcs)], F.lit(0.0)).alias("_shift"))
        new = cut_lineage(new.withColumn("_shift", F.max("_shift").over(W.partitionBy(*keys, *extra))))   # k rows each
        still = new.where(F.col("_shift") <= tol).drop("_shift")
        resting = still if resting is None else resting.unionByName(still)
        state = new.where(F.col("_shift") > tol).drop("_shift")
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"k-means still moves after {max_iter} rounds")
    state = cut_lineage(resting)
    parts = _with_sets(blocks, state, keys, pcs, extra).mapInArrow(lloyd.inertias(keys, len(pcs)), f"{names}, k int, start int, part double")
    inertia = parts.groupBy(*keys, *extra).agg(F.sum("part").alias("inertia"))
    win = inertia.groupBy(*keys, "k").agg(F.min_by(F.struct("start", "inertia"), F.struct("inertia", "start")).alias("w")) \
        .select(*keys, "k", "w.start", "w.inertia")
    best = cut_lineage(state.join(win, [*keys, *extra]))
    kind = rows.schema["entity"].dataType.simpleString()
    assigned = (_with_sets(blocks, best.drop("inertia"), keys, pcs, extra)
                .mapInArrow(lloyd.labels(keys, len(pcs)), f"{names}, k int, entity {kind}, cluster int"))
    drop = () if by else (ONE,)
    return cut_lineage(assigned).drop(*drop), best.drop("start", *drop)


def centroids_of(points: DataFrame, pcs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by, "cluster").agg(*[F.avg(p).alias(p) for p in pcs])


def gap(points: DataFrame, centroids: DataFrame, pcs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Nearest centroid (lowest id on ties), the runner-up, and the distance between the two decisions."""
    rows, keys = keyed(points.drop("cluster"), by)
    centers, _ = keyed(centroids, by)
    sets = centers.groupBy(*keys).agg(F.collect_list(F.struct("cluster", F.array(*pcs).alias("c"))).alias("centers"))
    sets = sets.select(*keys, F.struct("centers").alias("_s"))
    joined = rows.join(F.broadcast(sets) if not by else sets, keys)  # one model without keys
    order = F.array_sort(F.transform(F.col("_s.centers"), lambda c: F.struct(_distance(pcs, c["c"]).alias("d"), c["cluster"].alias("cluster"))))
    out = joined.withColumn("_o", order)
    drop = ["_s", "_o"] + ([] if by else [ONE])
    return (out.withColumn("cluster", F.get("_o", F.lit(0))["cluster"]).withColumn("distance", F.get("_o", F.lit(0))["d"])
            .withColumn("nearest_other", F.get("_o", F.lit(1))["cluster"])
            .withColumn("gap", F.get("_o", F.lit(1))["d"] - F.get("_o", F.lit(0))["d"]).drop(*drop))


def borderline(gaps: DataFrame, radius: float = 0.5) -> DataFrame:
    """Points close to a boundary."""
    return gaps.where(F.col("gap") < radius)


# ---- silhouettes ------------------------------------------------------------------------------

def silhouette_points(points: DataFrame, pcs: Sequence[str], by: Sequence[str] = (), tile: int = 2048, same: Sequence[str] = ()) -> DataFrame:
    """Exact Euclidean silhouette of every point (M6); a singleton cluster scores 0.

    A mean of distances is exact only pairwise.  Blocks of ``tile`` to ``pairwise.BLOCK_ROWS`` points meet once each; ``same`` names
    those of ``by`` over which a point keeps its coordinates (k), so that their distances are measured once.  Time grows with the
    square of a cross-section; one of more than MOST_PAIRWISE points is an error, and has ``squared_silhouette_points``.
    """
    rows, keys = keyed(points, [c for c in by if c not in same])
    rows = rows.select(*keys, *same, "entity", "cluster", *pcs)
    blocks, sizes = pairwise.blocked(rows, keys, pcs, same, tile)
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest > MOST_PAIRWISE:
        raise ValueError(f"a cross-section of {largest} points is too large for pairwise silhouettes; use squared_silhouette_points")
    return pairwise.silhouettes(blocks, rows, keys, same, len(pcs)).select(*by, "entity", "cluster", "silhouette")


def silhouette(points: DataFrame, pcs: Sequence[str], by: Sequence[str] = (), tile: int = 2048, same: Sequence[str] = ()) -> DataFrame:
    return silhouette_points(points, pcs, by, tile, same).groupBy(*by).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_of_ks(points: DataFrame, pcs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``silhouette`` of several ``k`` over the same points."""
    return silhouette(points, pcs, by, same=["k"])


def squared_silhouette_points(points: DataFrame, pcs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Silhouette by squared Euclidean distances of every point, in two passes over the points; a singleton cluster scores 0.

    The mean squared distance of x to a cluster is |x - mean|^2 plus the cluster's variance, so moments per cluster, which are
    mergeable, replace all pairs.  In its own cluster of m points x is left out: times m / (m - 1).
    """
    rows, keys = keyed(points, by)
    rows = rows.select(*keys, "entity", "cluster", *pcs)
    per = rows.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("m"), F.array(*[F.avg(p) for p in pcs]).alias("c"),
                                             sum((F.var_pop(p) for p in pcs[1:]), F.var_pop(pcs[0])).alias("v"))
    sets = cut_lineage(per.groupBy(*keys).agg(F.collect_list(F.struct(F.col("cluster").alias("other"), "m", "c", "v")).alias("_all")))
    size = (sets.agg(F.sum(F.size("_all"))).first()[0] or 0) * 8 * (len(pcs) + 4)
    joined = rows.join(F.broadcast(sets) if size <= BROADCAST_BYTES else sets, keys)        # measured
    mean = F.transform("_all", lambda o: F.struct(o["other"].alias("other"), o["m"].alias("m"), (_distance(pcs, o["c"]) ** 2 + o["v"]).alias("d")))
    own = F.get(F.filter(mean, lambda o: o["other"] == F.col("cluster")), F.lit(0))
    a = F.when(own["m"] > 1, own["d"] * own["m"] / (own["m"] - 1))
    b = F.array_min(F.transform(F.filter(mean, lambda o: o["other"] != F.col("cluster")), lambda o: o["d"]))
    s = F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))
    return joined.select(*by, "entity", "cluster", s.alias("silhouette"))


def squared_silhouette(points: DataFrame, pcs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return squared_silhouette_points(points, pcs, by).groupBy(*by).agg(F.avg("silhouette").alias("silhouette"))


def calinski(points: DataFrame, pcs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Between over within dispersion, and the inertia (M7)."""
    rows, keys = keyed(points, by)
    per = rows.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("m"), *[F.avg(p).alias(f"m_{p}") for p in pcs],
                                             *[(F.var_pop(p) * F.count(p)).alias(f"w_{p}") for p in pcs])
    whole = rows.groupBy(*keys).agg(*[F.avg(p).alias(f"g_{p}") for p in pcs])
    between = sum((F.col("m") * (F.col(f"m_{p}") - F.col(f"g_{p}")) ** 2 for p in pcs), F.lit(0.0))
    within = sum((F.col(f"w_{p}") for p in pcs), F.lit(0.0))
    agg = per.join(whole, keys).groupBy(*keys).agg(
        F.sum(between).alias("b"), F.sum(within).alias("inertia"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"))
    ch = F.when(F.col("inertia") > 0, F.try_divide(F.try_divide("b", F.col("k") - 1), F.try_divide("inertia", F.col("n") - F.col("k"))))
    out = agg.select(*keys, "n", "k", "inertia", ch.alias("calinski_harabasz"))
    return out if by else out.drop(ONE)


def select_k(table: DataFrame, default: int = DEFAULT_K, tol: float = SILHOUETTE_TOLERANCE, by: Sequence[str] = ()) -> DataFrame:
    """k with the best silhouette, but the default when it is within ``tol`` of it (M8)."""
    best = table.groupBy(*by).agg(F.max("silhouette").alias("_top"), F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("_k"),
                                  F.max(F.when(F.col("k") == default, F.col("silhouette"))).alias("_d"))
    return best.select(*by, F.when(F.col("_top") - F.col("_d") <= tol, F.lit(default)).otherwise(F.col("_k")).alias("k"))


def separation(points: DataFrame, pcs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean distance between centroids over mean distance to the own centroid (M14); below 1.5 is flagged.

    The centroid pairs come from one small array per group.
    """
    rows, keys = keyed(points, by)
    cents = rows.groupBy(*keys, "cluster").agg(*[F.avg(p).alias(f"c_{p}") for p in pcs])
    own = sum(((F.col(p) - F.col(f"c_{p}")) ** 2 for p in pcs), F.lit(0.0))
    inside = rows.join(cents, [*keys, "cluster"]).groupBy(*keys).agg(F.avg(F.sqrt(own)).alias("within"))
    arr = cents.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", F.array(*[f"c_{p}" for p in pcs]).alias("c")))).alias("cs"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    pairs = F.flatten(F.transform("cs", lambda a: F.transform(F.filter("cs", lambda b: b["cluster"] > a["cluster"]),
                                                               lambda b: apart(a["c"], b["c"]))))
    mean = F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v), F.size(pairs))
    out = (arr.select(*keys, mean.alias("between")).join(inside, keys)
           .withColumn("ratio", F.try_divide("between", "within")).withColumn("weak", F.col("ratio") < 1.5))
    return out if by else out.drop(ONE)


def adjusted_rand(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    rows, keys = keyed(df, by)
    cells = rows.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("m"))
    c2 = lambda c: c * (c - 1) / 2
    both = cells.groupBy(*keys).agg(F.sum(c2(F.col("m"))).alias("ij"), F.sum("m").alias("n"))
    side = lambda c, name: (cells.groupBy(*keys, c).agg(F.sum("m").alias("m")).groupBy(*keys).agg(F.sum(c2(F.col("m"))).alias(name)))
    j = both.join(side(a, "ai"), keys).join(side(b, "bj"), keys)
    expected = F.try_divide(F.col("ai") * F.col("bj"), c2(F.col("n")))
    top, bottom = F.col("ij") - expected, (F.col("ai") + F.col("bj")) / 2 - expected
    out = j.select(*keys, F.when(bottom.isNull() | (bottom == 0), F.lit(1.0)).otherwise(F.try_divide(top, bottom)).alias("ari"))
    return out if by else out.drop(ONE)


# ---- descriptions -----------------------------------------------------------------------------

def balance(assign: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sizes and shares with dominant and tiny flags (A21); one row per cluster."""
    per = assign.groupBy(*by, "cluster").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(*by))
    w = W.partitionBy(*by)
    return (per.withColumn("share", share).withColumn("dominant", F.col("share") > 0.5).withColumn("tiny", F.col("share") < 0.03)
            .withColumn("imbalance", F.max("n").over(w) / F.min("n").over(w)))


def characterize(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Size, mean and exact median of every feature per cluster, long (A3)."""
    from .order_stats import medians
    long = to_long(df, [*by, "cluster"], cols)
    keys = [*by, "cluster", "feature"]
    means = long.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return means.join(medians(long, keys, "x"), keys)


def risk_rank(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Clusters ranked by mean risk-flipped z-score, 0 safest."""
    z = standardize(df, cols, by)
    flipped = [(-F.col(c) if RISK_DIRECTION.get(c, 1) == -1 else F.col(c)) for c in cols]
    total = sum((F.coalesce(f, F.lit(0.0)) for f in flipped[1:]), F.coalesce(flipped[0], F.lit(0.0)))
    n = sum((f.isNotNull().cast("int") for f in flipped[1:]), flipped[0].isNotNull().cast("int"))
    risk = z.withColumn("_r", F.try_divide(total, n)).groupBy(*by, "cluster").agg(F.avg("_r").alias("risk"))
    w = W.partitionBy(*by).orderBy("risk", "cluster")              # one row per cluster
    return risk.withColumn("risk_rank", F.row_number().over(w) - 1)


def styles(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Style name per cluster from its family z-means (M9); repeated names get a number in cluster order."""
    z = standardize(df, cols, by)
    means = z.groupBy(*by, "cluster").agg(*[F.avg(c).alias(c) for c in cols])
    picks = []
    for i, (name, members, sign) in enumerate(STYLE_FAMILIES):
        here = [c for c in members if c in cols]
        if here:
            mag = sum((F.col(c) for c in here[1:]), F.col(here[0])) / len(here) * sign
            picks.append(F.struct(mag.alias("m"), F.lit(-i).alias("o"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*picks)) if picks else None
    name = F.when(best["m"] > STYLE_TRIGGER, best["name"]).otherwise(STYLE_DEFAULT) if picks else F.lit(STYLE_DEFAULT)
    named = means.select(*by, "cluster", name.alias("_name"))
    nth = F.row_number().over(W.partitionBy(*by, "_name").orderBy("cluster"))
    return named.withColumn("_n", nth).select(
        *by, "cluster", F.when(F.col("_n") == 1, F.col("_name"))
        .otherwise(F.concat("_name", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).alias("style"))


def sweep(points: DataFrame, pcs: Sequence[str], ks: Sequence[int], by: Sequence[str] = (), n_init: int = N_INIT,
          score=silhouette_of_ks) -> DataFrame:
    """k against silhouette, dispersion and balance.

    ``score``: ``silhouette_of_ks``, pairwise, or ``squared_silhouette``, for cross-sections of any size.
    """
    assigned, _ = kmeans(points, pcs, ks, by, n_init)
    rows = assigned.join(points.select(*by, "entity", *pcs), [*by, "entity"])
    keys = [*by, "k"]
    sizes = balance(assigned, keys).groupBy(*keys).agg(F.min("share").alias("smallest"), F.max("share").alias("largest"),
                                                       F.max("imbalance").alias("imbalance"))
    ch = calinski(rows.withColumn("k_", F.col("k")).drop("k"), pcs, [*by, "k_"]).drop("k").withColumnRenamed("k_", "k")
    return score(rows, pcs, keys).join(sizes, keys).join(ch, keys)


def cluster_cross_sections(df: DataFrame, cols: Sequence[str], by: Sequence[str], min_names: int = 20, k: int = DEFAULT_K,
                           n_pcs: int = 4, n_init: int = N_INIT_FINAL) -> DataFrame:
    """PCA, k-means and style of every cross-section with at least ``min_names`` names: ``by, entity, cluster, cluster_style``.

    All dates go through the same jobs; smaller cross-sections have no rows, so their names keep null clusters.
    """
    from . import pca
    big = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_names).select(*by)
    rows = df.join(big, list(by), "left_semi").na.fill(0.0, list(cols))
    points = pca.project(rows, cut_lineage(pca.fit(rows, cols, by, n_pcs)), cols, by, n_pcs)
    pcs = [f"PC{i + 1}" for i in range(n_pcs)]
    assigned, _ = kmeans(points, pcs, (k,), by, n_init)
    assigned = assigned.drop("k")
    named = styles(rows.join(assigned, [*by, "entity"]), cols, by)
    return (assigned.join(named, [*by, "cluster"])
            .select(*by, "entity", F.col("cluster").cast("int").alias("cluster"), F.col("style").alias("cluster_style")))
