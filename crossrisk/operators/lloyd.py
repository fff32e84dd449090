"""Blocks of points, and the k-means steps that run on them: a task sees blocks of bounded size and the centers of their groups.

A group of up to BLOCK_ROWS points is one block, and its runs go to rest in one task.  A larger one is several blocks; these return
sums per center, which Spark adds up for one round of all runs.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1 << 16
STEP_ROWS = 1 << 13     # rows compared with a center at once: their arrays stay in the processor's cache
MOST_PARTS = 1024

_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def rehash(h: np.ndarray, value: int) -> np.ndarray:
    """``F.xxhash64(..., value)`` of an int, given the hash of all before it: the seeded draws of a row need no column each."""
    with np.errstate(over="ignore"):
        h = (h + _P5 + np.uint64(4)) ^ (np.uint64(value & 0xFFFFFFFF) * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def blocked(rows: DataFrame, keys: Sequence[str], pcs: Sequence[str]) -> DataFrame:
    """``keys, blocks, h, x, entity``: the rows of a block as arrays; ``h`` is the hash of the entity, whose rows share a block."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    n = sizes.agg(F.sum("blocks")).first()[0] or 1
    parts = min(4 * n, max(128, n // 2), MOST_PARTS)        # a few blocks are spread over more partitions, as they are dealt by hash
    one = F.struct(F.xxhash64("entity").alias("h"), F.array(*[F.col(p).cast("double") for p in pcs]).alias("x"), "entity")
    own = (rows.join(sizes, list(keys)).withColumn("_block", F.pmod(F.xxhash64("entity"), "blocks").cast("int"))
           .repartition(parts, *keys, "_block").groupBy(*keys, "_block", "blocks").agg(F.collect_list(one).alias("_rows")))
    return cut_lineage(own.select(*keys, "blocks", F.col("_rows.h").alias("h"), F.flatten("_rows.x").alias("x"), F.col("_rows.entity").alias("entity")))


def _tables(keys: Sequence[str], run):
    """A function over Arrow batches from one over a block, which gives its columns after the keys as arrays."""
    def mapped(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                for columns in run(one):
                    n = len(next(iter(columns.values())))
                    own = {k: pa.array([one.column(k)[0].as_py()] * n, one.schema.field(k).type) for k in keys}
                    yield pa.RecordBatch.from_pydict(own | columns)
    return mapped


def _points(one: pa.RecordBatch, dims: int) -> np.ndarray:
    """Coordinates by columns, each contiguous."""
    return np.ascontiguousarray(one.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).T)


def _hashes(one: pa.RecordBatch) -> np.ndarray:
    return one.column("h").flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _listed(x: np.ndarray) -> pa.Array:
    """Rows as an array column."""
    return pa.array(list(np.ascontiguousarray(x)), pa.list_(pa.float64()))


def nearest(x: np.ndarray, centers: np.ndarray, root: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each point, the first of its nearest centers and the distance, or its square."""
    n = x.shape[1]
    at, best = np.zeros(n, np.int64), np.empty(n)
    for lo in range(0, n, STEP_ROWS):
        part = x[:, lo:lo + STEP_ROWS]
        d = np.empty((len(centers), part.shape[1]))
        for c, center in enumerate(centers):
            diff = part[0] - center[0]
            own = np.multiply(diff, diff, out=d[c])
            for p in range(1, len(x)):
                diff = part[p] - center[p]
                own += diff * diff
        if root:
            np.sqrt(d, out=d)
        where = d.argmin(0)
        at[lo:lo + STEP_ROWS] = where
        best[lo:lo + STEP_ROWS] = np.take_along_axis(d, where[None], 0)[0]
    return at, best


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(at, minlength=k), np.stack([np.bincount(at, p, k) for p in x], 1)


def firsts(keys: Sequence[str], dims: int, n_init: int, seed: int):
    """The first point of every start: the one with the smallest seeded hash."""
    def run(one):
        x, h = _points(one, dims), _hashes(one)
        drawn = [rehash(rehash(h, start), seed).view(np.int64) for start in range(n_init)]
        at = [int(d.argmin()) for d in drawn]
        yield {"start": pa.array(range(n_init), pa.int32()), "h": pa.array([int(d[a]) for d, a in zip(drawn, at)], pa.int64()),
               "x": _listed(x[:, at].T)}
    return _tables(keys, run)


def draws(keys: Sequence[str], dims: int, n: int, number: int, seed: int):
    """The block's sum of squared distances of every start, and the points that may be drawn with it.

    All rows of an entity are drawn with one of them.
    """
    def run(one):
        x, h = _points(one, dims), _hashes(one)
        kind, place = np.unique(h, return_inverse=True)
        for s in one.column("_sets")[0].as_py():
            d2 = nearest(x, np.array(s["centers"]), False)[1]
            phi = float(d2.sum())
            chance = (rehash(rehash(rehash(h, s["start"]), number), seed) >> np.uint64(11)).astype(float) / float(1 << 53)
            if len(kind) < len(h):
                most = np.zeros(len(kind))
                np.maximum.at(most, place, d2)
                d2 = most[place]
            at = np.flatnonzero((chance * phi * (1 - 1e-9) < n * d2) & (d2 > 0))
            yield {"start": pa.array([s["start"]] * (len(at) + 1), pa.int32()), "phi": pa.array([phi] + [0.0] * len(at)),
                   "chance": pa.array([None, *chance[at]], pa.float64()), "d2": pa.array([None, *d2[at]], pa.float64()),
                   "x": pa.array([None, *x[:, at].T], pa.list_(pa.float64()))}
    return _tables(keys, run)


def weights(keys: Sequence[str], dims: int):
    """How many of the block's points are nearest to each drawn one."""
    def run(one):
        x = _points(one, dims)
        for s in one.column("_sets")[0].as_py():
            w = np.bincount(nearest(x, np.array(s["centers"]), False)[0], minlength=len(s["centers"]))
            at = np.flatnonzero(w)
            yield {"start": pa.array([s["start"]] * len(at), pa.int32()), "at": pa.array(at, pa.int32()), "w": pa.array(w[at], pa.int64())}
    return _tables(keys, run)


def _to_rest(x: np.ndarray, centers: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    for _ in range(max_iter):
        held, total = _sums(x, nearest(x, centers, True)[0], len(centers))
        new = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centers)
        shift = np.abs(new - centers).max()
        centers = new
        if shift <= tol:
            break
    return centers


def steps(keys: Sequence[str], dims: int, max_iter: int, tol: float):
    """Number and sums of the block's points at every center of every run; a run of a single block starts from where it rests."""
    def run(one):
        x, alone = _points(one, dims), one.column("blocks")[0].as_py() == 1
        for s in one.column("_sets")[0].as_py():
            ids, centers = [c["cluster"] for c in s["centers"]], np.array([c["c"] for c in s["centers"]])
            moved = _to_rest(x, centers, max_iter, tol) if alone else centers
            held, total = _sums(x, nearest(x, moved, True)[0], len(ids))
            at = np.flatnonzero((held > 0) | (moved != centers).any(1))
            total = np.where(held[:, None] > 0, total, moved)           # a center without points stays where it is
            yield {"k": pa.array([s["k"]] * len(at), pa.int32()), "start": pa.array([s["start"]] * len(at), pa.int32()),
                   "cluster": pa.array([ids[a] for a in at], pa.int32()), "m": pa.array(np.maximum(held, 1)[at], pa.int64()), "x": _listed(total[at])}
    return _tables(keys, run)


def inertias(keys: Sequence[str], dims: int):
    """The block's part of the inertia of every run."""
    def run(one):
        x, sets = _points(one, dims), one.column("_sets")[0].as_py()
        parts = []
        for s in sets:
            d = nearest(x, np.array([c["c"] for c in s["centers"]]), True)[1]
            parts.append(float((d * d).sum()))
        yield {"k": pa.array([s["k"] for s in sets], pa.int32()), "start": pa.array([s["start"] for s in sets], pa.int32()), "part": pa.array(parts)}
    return _tables(keys, run)


def labels(keys: Sequence[str], dims: int):
    """The nearest center of every point, in every run that is given."""
    def run(one):
        x, entity = _points(one, dims), one.column("entity").flatten()
        for s in one.column("_sets")[0].as_py():
            ids = np.array([c["cluster"] for c in s["centers"]])
            at = nearest(x, np.array([c["c"] for c in s["centers"]]), True)[0]
            yield {"k": pa.array([s["k"]] * len(at), pa.int32()), "entity": entity, "cluster": pa.array(ids[at], pa.int32())}
    return _tables(keys, run)
