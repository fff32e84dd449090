"""k-means starts by oversampling (Bahmani et al., 2012), for all groups and starts in the same jobs."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from . import lloyd
from .gram import key_schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 3
OVERSAMPLING = 2        # times the largest k, expected draws of a round
REFINING = 10           # weighted Lloyd rounds over the drawn points


def _sets(drawn: DataFrame, keys: Sequence[str], pcs: Sequence[str]) -> DataFrame:
    """One row per group: every start with its points in a fixed order."""
    own = drawn.groupBy(*keys, "start").agg(F.array_sort(F.collect_set(F.array(*pcs))).alias("centers"))
    return own.groupBy(*keys).agg(F.collect_list(F.struct("start", "centers")).alias("_sets"))


def _met(blocks: DataFrame, sets: DataFrame, keys: Sequence[str], pcs: Sequence[str], most_bytes: int) -> DataFrame:
    size = sets.agg(F.sum(F.aggregate("_sets", F.lit(0), lambda s, x: s + F.size(x["centers"])))).first()[0] or 0
    return blocks.join(F.broadcast(sets) if size * 8 * (len(pcs) + 4) <= most_bytes else sets, list(keys))      # measured


def weighted_starts(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to k centers of weighted points: D2-weighted draws, then weighted Lloyd rounds."""
    far = np.full(len(points), np.inf)
    chosen: list[int] = []
    while len(chosen) < k:
        mass = weights * (np.ones(len(points)) if not chosen else far)
        if mass.sum() <= 0:
            break
        chosen.append(int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), "right").clip(0, len(points) - 1)))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    centers = points[chosen].copy()
    for _ in range(REFINING):
        near = ((points[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        held = np.bincount(near, weights, len(centers))
        total = np.stack([np.bincount(near, weights * x, len(centers)) for x in points.T], 1)
        centers[held > 0] = total[held > 0] / held[held > 0, None]
    return centers


def oversampled(rows: DataFrame, keys: Sequence[str], pcs: Sequence[str], ks: Sequence[int], n_init: int, seed: int,
                most_bytes: int = 64 << 20, blocks: DataFrame | None = None) -> DataFrame:
    """``keys, k, start, cluster, pcs``: centers to start from; ``blocks`` of the rows, if the caller has them.

    A start draws one point, then in each round every point with a probability of its share of the squared distance left,
    times OVERSAMPLING * max(ks).  The drawn points, weighted by the rows nearest to them, are reduced to k in one task per group;
    their expected number does not depend on the group's size.  Draws are seeded hashes: a run gives the same starts again.
    A block knows its own distances only, so it names the points that its own sum would draw, which are those of the whole sum and
    a few more.
    """
    keys, n = list(keys), OVERSAMPLING * max(ks)
    names, blocks = key_schema(rows, keys), lloyd.blocked(rows, keys, pcs) if blocks is None else blocks
    point = [F.get("x", F.lit(i)).alias(p) for i, p in enumerate(pcs)]
    first = blocks.mapInArrow(lloyd.firsts(keys, len(pcs), n_init, seed), f"{names}, start int, h long, x array<double>")
    drawn = cut_lineage(first.groupBy(*keys, "start").agg(F.min_by("x", F.struct("h", "x")).alias("x")).select(*keys, "start", *point))
    for r in range(ROUNDS):
        met = _met(blocks, _sets(drawn, keys, pcs), keys, pcs, most_bytes)
        named = cut_lineage(met.mapInArrow(lloyd.draws(keys, len(pcs), n, r, seed),
                                           f"{names}, start int, phi double, chance double, d2 double, x array<double>"))
        left = named.groupBy(*keys, "start").agg(F.sum("phi").alias("_phi"))
        new = named.where("x is not null").join(left, [*keys, "start"]).where(F.col("chance") * F.col("_phi") < n * F.col("d2"))
        drawn = cut_lineage(drawn.unionByName(new.select(*keys, "start", *point)))
    sets = cut_lineage(_sets(drawn, keys, pcs))
    held = _met(blocks, sets, keys, pcs, most_bytes).mapInArrow(lloyd.weights(keys, len(pcs)), f"{names}, start int, at int, w long")
    weights = held.groupBy(*keys, "start", "at").agg(F.sum("w").alias("w"))
    weighted = (sets.select(*keys, F.explode("_sets").alias("s")).select(*keys, "s.start", F.posexplode("s.centers").alias("at", "c"))
                .join(weights, [*keys, "start", "at"]).select(*keys, "start", "at", "c", "w"))

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        out, group = [], tuple(pdf[keys].iloc[0])
        for start, own in pdf.sort_values("at").groupby("start"):
            x, w = np.array(own["c"].tolist(), float), own["w"].to_numpy(float)
            for k in ks:
                centers = weighted_starts(x, w, k, np.random.default_rng([seed, int(start), k]))
                out += [(*group, k, int(start), i, *c) for i, c in enumerate(centers)]
        return pd.DataFrame(out, columns=[*keys, "k", "start", "cluster", *pcs])
    return weighted.groupBy(*keys).applyInPandas(
        reduced, f"{key_schema(rows, keys)}, k int, start int, cluster int, {', '.join(f'`{p}` double' for p in pcs)}")
