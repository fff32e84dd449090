"""k-means on blocks: the same runs whether a group is one block or many, in a number of jobs that does not follow the rounds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossrisk.functions import kernels
from crossrisk.operators import cluster, lloyd, starts

PCS = ["PC1", "PC2", "PC3"]


@pytest.fixture
def noise(spark):
    x = np.random.default_rng(3).normal(0, 1, (600, 3))
    rows = pd.DataFrame({"date": np.arange(600) % 2, "entity": [f"e{i}" for i in range(600)], **{p: x[:, i] for i, p in enumerate(PCS)}})
    return spark.createDataFrame(pd.concat([rows, rows[:20]]))       # some rows come twice


def test_rounds_of_a_small_group_need_no_jobs(noise, monkeypatch):
    cuts = []
    for module in (cluster, starts, lloyd):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: (cuts.append(1), cut(df))[1])
    cluster.kmeans(noise, PCS, (3, 5), ["date"], n_init=4)
    assert len(cuts) <= 20


def test_blocks_of_a_group_add_up(noise, monkeypatch):
    def run():
        assigned, centers = cluster.kmeans(noise, PCS, (3, 5), ["date"], n_init=4)
        best = {(r["date"], r["k"]): r["inertia"] for r in centers.collect()}
        return best, sorted((r["date"], r["k"], r["entity"]) for r in assigned.collect())
    whole, names = run()
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 50)
    split, again = run()
    assert names == again and len(names) == 2 * 620
    assert {k: pytest.approx(v, rel=1e-9) for k, v in whole.items()} == split


def test_draws_are_those_of_the_hash_expression(spark):
    df = spark.range(-5, 50).select(F.xxhash64(F.col("id").cast("string")).alias("h"),
                                    F.xxhash64(F.col("id").cast("string"), F.lit(3), F.lit(-7)).alias("want")).toPandas()
    got = lloyd.rehash(lloyd.rehash(df["h"].to_numpy().view(np.uint64), 3), -7).view(np.int64)
    assert (got == df["want"].to_numpy()).all()


def test_distances_by_products_are_those_by_differences():
    rng = np.random.default_rng(5)
    x = rng.normal(1000, 1, (300, 64))
    x[1], x[2] = x[0], x[0] + 1e-7
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(kernels._distances(x, x), want, rtol=1e-9, atol=1e-12)
