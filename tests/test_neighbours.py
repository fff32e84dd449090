"""Exact neighbours by pivot cells, k-means starts, and the limits of pairwise silhouettes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossrisk.operators import cells, cluster, knn, pairwise, starts

PCS = ["PC1", "PC2", "PC3"]


def frame(x, **more):
    return pd.DataFrame(x, columns=PCS).assign(entity=np.arange(len(x)), **more)


def brute(df, wanted, k):
    x, ids, out = df[PCS].to_numpy(), df["entity"].tolist(), []
    for i in np.flatnonzero(df["entity"].isin(wanted)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out += [(ids[i], r + 1, ids[j], round(float(d[j]), 9)) for r, j in enumerate(order)]
    return sorted(out)


def rows(df):
    return sorted((r["entity"], r["rank"], r["neighbour"], round(r["distance"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 100, (40, 3))
    return frame(middle[rng.integers(0, 40, 4000)] + rng.normal(0, 1, (4000, 3)))


def test_neighbours_are_exact_and_few_distances_are_evaluated(spark, clustered):
    found, evaluated = knn.search(spark.createDataFrame(clustered), spark.createDataFrame(clustered), PCS, 5)
    assert rows(found) == brute(clustered, clustered["entity"], 5)
    assert evaluated < 0.1 * 4000 ** 2


@pytest.mark.parametrize("part", [cells.PART_ROWS, 7])
def test_ties_copies_and_candidates_elsewhere(spark, monkeypatch, part):
    monkeypatch.setattr(cells, "PART_ROWS", part)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat([[1.0, 2.0, 3.0]], 150, 0), rng.integers(0, 4, (250, 3)).astype(float)])
    df = frame(x)
    points = spark.createDataFrame(df)
    assert rows(knn.nearest(points, points.where("entity % 7 = 0"), PCS, 6)) == brute(df, range(0, 400, 7), 6)
    far = spark.createDataFrame([(900, 50.0, 50.0, 50.0)], ["entity", *PCS])
    got = rows(knn.nearest(points, far, PCS, 3))
    d = np.sqrt(((x - 50.0) ** 2).sum(1))
    assert [r[2] for r in got] == np.lexsort((df["entity"], d))[:3].tolist()


def test_groups_names_nulls_and_short_groups(spark):
    rng = np.random.default_rng(4)
    df = pd.concat([frame(rng.normal(0, 1, (n, 3)), date=g) for g, n in ((1, 200), (2, 3), (3, 1))])
    df["entity"] = "e" + df["entity"].astype(str)
    points = spark.createDataFrame(df)
    holes = points.unionByName(spark.createDataFrame([("x", 1, None, 0.0, 0.0)], "entity string, date long, PC1 double, PC2 double, PC3 double"))
    got = knn.nearest(holes, holes, PCS, 4, ["date"])
    for g in (1, 2, 3):
        own = df[df["date"] == g]
        assert rows(got.where(F.col("date") == g)) == brute(own, own["entity"], 4)
    assert knn.nearest(points.limit(0), points.limit(0), PCS, 4).count() == 0


def _uniform_best(x, k, runs, seed):
    rng, best = np.random.default_rng(seed), np.inf
    for _ in range(runs):
        centers = x[rng.permutation(len(x))[:k]].copy()
        for _ in range(100):
            near = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
            new = np.stack([x[near == c].mean(0) if (near == c).any() else centers[c] for c in range(k)])
            if np.abs(new - centers).max() < 1e-9:
                break
            centers = new
        best = min(best, ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum())
    return best


def test_inertia_is_not_above_the_best_of_fifty_uniform_starts(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(0, 10, (12, 3))
    sections = {g: middle[rng.integers(0, 12, 300)] + rng.normal(0, 1, (300, 3)) for g in range(2)} | {2: rng.normal(0, 1, (40, 3))}
    df = spark.createDataFrame(pd.concat([frame(x, date=g) for g, x in sections.items()]))
    # as many clusters as there are: a few spread starts find them, uniform ones rarely do
    assigned, centers = cluster.kmeans(df.where("date < 2"), PCS, (12,), ["date"], n_init=10)
    for r in centers.collect():
        assert r["inertia"] <= _uniform_best(sections[r["date"]], 12, 50, 1) * (1 + 1e-9)
    assert {r["count"] for r in assigned.groupBy("date", "k").count().collect()} == {300}
    # fewer clusters, or noise, have many optima close to each other: as many starts as a final fit
    centers = cluster.kmeans(df, PCS, (3, 8), ["date"], n_init=50)[1]
    got = {(r["date"], r["k"]): r["inertia"] for r in centers.collect()}
    assert len(got) == 6
    for (g, k), inertia in got.items():
        assert inertia <= _uniform_best(sections[g], k, 50, 1) * 1.06, (g, k)


def test_starts_are_spread_and_bounded(spark):
    far = np.repeat(np.eye(3) * 1000, 100, 0) + np.random.default_rng(1).normal(0, 1, (300, 3))
    df = spark.createDataFrame(frame(far)).withColumn("g", F.lit(0))
    out = starts.oversampled(df, ["g"], PCS, (3,), 8, 42).toPandas()
    for _, own in out.groupby("start"):
        assert sorted(own[PCS].to_numpy().argmax(1)) == [0, 1, 2]
    same = spark.createDataFrame(frame(np.ones((50, 3)))).withColumn("g", F.lit(0))
    assert starts.oversampled(same, ["g"], PCS, (3,), 2, 42).count() == 2      # one distinct point, one center a start


def test_pairwise_silhouettes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(cluster, "MOST_PAIRWISE", 10)
    df = spark.createDataFrame(frame(np.random.default_rng(1).normal(0, 1, (30, 3)), cluster=[0, 1, 2] * 10))
    with pytest.raises(ValueError):
        cluster.silhouette_points(df, PCS)
    table = cluster.sweep(df.drop("cluster"), PCS, (2, 3), score=cluster.squared_silhouette).collect()
    assert {r["k"] for r in table} == {2, 3} and all(-1 <= r["silhouette"] <= 1 for r in table)


def test_points_are_not_stored_once_for_every_cell_they_see(spark):
    import pathlib
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    stored = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    dims = [f"PC{i + 1}" for i in range(32)]
    x = np.random.default_rng(9).normal(0, 1, (1500, 32))
    df = spark.createDataFrame(pd.DataFrame({"entity": np.arange(1500), **{p: x[:, i] for i, p in enumerate(dims)}})).localCheckpoint()
    before = stored()
    assert knn.nearest(df, df, dims, 3).count() == 4500
    assert stored() - before < 12 * x.nbytes     # pivots see nothing here: every point sees all of the 47 cells


def brute_silhouettes(rows, pcs, by):
    """Silhouette of every (group, entity, cluster); rows of an entity do not count for each other."""
    out = {}
    for key, own in rows.groupby(by):
        x, name, label = own[pcs].to_numpy(), own["entity"].to_numpy(), own["cluster"].to_numpy()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        apart = name[:, None] != name[None]
        for e, c in set(zip(name, label)):
            at = (name == e) & (label == c)
            mean = {k: d[at][:, label == k][apart[at][:, label == k]].mean() for k in set(label) if apart[at][:, label == k].any()}
            a, rest = mean.get(c), [v for k, v in mean.items() if k != c]
            out[(*key, e, c)] = 0.0 if a is None or not rest or max(a, *rest) == 0 else (min(rest) - a) / max(a, min(rest))
    return out


@pytest.mark.parametrize("same", [(), ("k",)])
@pytest.mark.parametrize("wanted", [1, 256])
def test_silhouettes_of_many_labelings_and_blocks(spark, monkeypatch, same, wanted):
    monkeypatch.setattr(pairwise, "WANTED_TILES", wanted)
    monkeypatch.setattr(pairwise, "STEP", 16)
    rng = np.random.default_rng(8)
    base = pd.concat([frame(rng.normal(100, 1, (90, 3)) * [1, 5, 9], d=d) for d in ("a", "b")])
    base.loc[base["entity"] == 5, PCS] = base.loc[base["entity"] == 6, PCS].to_numpy()
    base.loc[base["entity"] == 7, PCS] = 4000.0
    base = pd.concat([base, base[base["entity"] < 3]])      # rows that come twice
    rows = pd.concat([base.assign(k=k, cluster=(base["entity"] * 7 + base["entity"] // 9) % k) for k in (2, 4)])
    rows.loc[(rows["entity"] == 20) & (rows["k"] == 4), "cluster"] = 9       # alone in its cluster
    got = cluster.silhouette_points(spark.createDataFrame(rows), PCS, ["d", "k"], tile=20, same=same).collect()
    want = brute_silhouettes(rows, PCS, ["d", "k"])
    assert len(got) == len(want)
    for r in got:
        assert r["silhouette"] == pytest.approx(want[r["d"], r["k"], r["entity"], r["cluster"]], abs=1e-12)


def test_distance_sums_and_their_limit():
    x = np.random.default_rng(9).normal(0, 1, (700, 3))
    sums = pairwise.distance_sums(x, np.ones((700, 1)), name=np.arange(700))[0]
    assert sums[:, 0] == pytest.approx(np.sqrt(((x[:, None] - x) ** 2).sum(2)).sum(1))
    there, back = pairwise.distance_sums(x[:300], np.ones((300, 1)), x[300:], np.ones((400, 1)))
    assert there.sum() == pytest.approx(back.sum()) and len(back) == 400
    assert cluster.MOST_PAIRWISE >= 10 * 360 * 2000


def test_silhouettes_beside_points_without_a_place(spark):
    """A cluster with a null coordinate has no mean distance; a point without another one has 0."""
    x = np.random.default_rng(3).normal(0, 1, (40, 3))
    rows = frame(x, cluster=np.arange(40) % 4)
    held = rows[rows["cluster"] < 3].assign(d=0)
    rows.loc[7, "PC2"] = None
    got = {r["entity"]: r["silhouette"] for r in cluster.silhouette_points(spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "PC1 double, PC2 double, PC3 double, entity long, cluster long"), PCS).collect()}
    want = brute_silhouettes(held, PCS, ["d"])
    assert got == pytest.approx({**{e: v for (_, e, _), v in want.items()}, **{e: 0.0 for e in range(3, 40, 4)}})
