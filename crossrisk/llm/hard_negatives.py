"""Hard negatives by an inverted multi-index.

Components are whole numbers (``floor(scale * x)``) and a row's score is its inner product with the anchor.  An anchor's
positives are its best rows of the same label; for each positive, its negatives are the best rows of other labels whose score
lies in a window given by the positive's score.

1. *Codebooks.*  Each half of the dimensions has its own k-means codebook, fitted on at most ``SAMPLE`` rows.  Every row is
   placed in the cell of its two nearest codewords; a codeword keeps its radius, the greatest distance of its rows.
2. *Parts.*  The rows of a cell are packed in parts of about ``PART_ROWS``, so that a cell with many rows is many parts.
3. *Cells by bound.*  A half of the anchor scores at most ``q.c + |q| r`` against the rows of a codeword.  A heap over pairs of
   codewords, each half sorted by that bound, hands out cells by falling sum (multi-sequence algorithm).
4. *Rounds.*  In a round every open anchor asks for its next cells, as many as hold ``FIRST * GROW ** round`` rows; requests meet parts by
   (cell, part) and return their best rows only.  An anchor is closed when the bound of its next cell is below what each of
   its lists still needs: its k-th best score, or the window's lower end while the list is short.  Lists are therefore exact.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.  A shorter vector counts as
filled up with zeros.  Rows that share an id are rows of their own, but none is a positive of another with its id.  Ties go to
the smaller id.  Negative positive scores have empty windows.  An empty table gives an empty result; other columns are ignored.
Components whose inner products pass 2**63 are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

SCALE = 256
SAMPLE = 16_384
CELL_ROWS = 256
MOST_CODES = 256
LLOYD = 8
PART_ROWS = 2048
GROUP_ANCHORS = 128
FIRST, GROW = 4096, 8
SLACK = 1e-3


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, with whole components."""
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
        F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((codes * codes).sum(1) - 2 * x @ codes.T).argmin(1)


def codebook(x: np.ndarray, k: int, rounds: int = LLOYD) -> np.ndarray:
    """Up to ``k`` codewords by Lloyd rounds from distinct sampled rows; a codeword without rows stays."""
    own = np.unique(x, axis=0)
    codes = own[np.random.default_rng(13).permutation(len(own))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, codes)
        count = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes[count > 0] = total[count > 0] / count[count > 0, None]
    return codes


class Index:
    """Codewords, radii and cell sizes: all that the heap needs, at most ``MOST_CODES`` squared numbers."""

    def __init__(self, halves: list[np.ndarray], dims: int, kind: str):
        self.halves, self.dims, self.kind = halves, dims, kind
        self.cut = halves[0].shape[1]
        self.shape = len(halves[0]), len(halves[1])
        self.radii = [np.zeros(k) for k in self.shape]
        self.rows = np.zeros(self.shape, np.int64)

    def split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, :self.cut], x[:, self.cut:]

    def parts(self) -> np.ndarray:
        return -(-self.rows // PART_ROWS)

    def cells(self, q: np.ndarray) -> Iterator[tuple[int, float, float]]:
        """Number, greatest and smallest possible score of every cell, by falling greatest score."""
        up, down, order = [], [], []
        for half, codes, radius in zip((q[:self.cut], q[self.cut:]), self.halves, self.radii):
            middle, reach = codes @ half, np.sqrt((half * half).sum()) * radius
            own = np.argsort(-(middle + reach), kind="stable")
            order.append(own.tolist())
            up.append((middle + reach)[own].tolist())
            down.append((middle - reach)[own].tolist())
        heap = [(-(up[0][0] + up[1][0]), 0, 0)]
        width = self.shape[1]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield order[0][i] * width + order[1][j], -bound, down[0][i] + down[1][j]
            if j + 1 < width:
                heapq.heappush(heap, (-(up[0][i] + up[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < self.shape[0]:
                heapq.heappush(heap, (-(up[0][i + 1] + up[1][0]), i + 1, 0))


def _fitted(rows: DataFrame) -> Index | None:
    n, dims, low, high = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if not n:
        return None
    dims, most = max(dims, 2), max(abs(low or 0), abs(high or 0))
    if most * most * dims >= 1 << 63:
        raise ValueError("components are too large for 64-bit scores")
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < SAMPLE).select("v").limit(2 * SAMPLE).toArrow()
    x = _matrix(sample.column("v"), dims).astype(np.float64) if sample.num_rows else np.zeros((1, dims))
    k = int(min(MOST_CODES, max(1, (n / CELL_ROWS) ** 0.5)))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return Index([codebook(x[:, :dims // 2], k), codebook(x[:, dims // 2:], k)], dims, kind)


def _placed(rows: DataFrame, index: Index) -> DataFrame:
    """Rows with cell and packed vector; fills in the radii and cell sizes of the index."""
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), index.dims)
            codes, far = [], []
            for half, book in zip(index.split(x), index.halves):
                near = _nearest(half.astype(np.float64), book)
                codes.append(near)
                far.append(np.sqrt(((half - book[near]) ** 2).sum(1)))
            packed = [r.tobytes() for r in x.astype(index.kind)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary()), pa.array(codes[0], pa.int32()),
                 pa.array(codes[1], pa.int32()), pa.array(far[0]), pa.array(far[1])],
                names=["vec_id", "label", "v", "i", "j", "far_i", "far_j"])
    placed = written(rows.mapInArrow(run, "vec_id long, label int, v binary, i int, j int, far_i double, far_j double"))
    for r in placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("far_i").alias("p"), F.max("far_j").alias("q")).collect():
        index.rows[r["i"], r["j"]] = r["n"]
        index.radii[0][r["i"]] = max(index.radii[0][r["i"]], r["p"])
        index.radii[1][r["j"]] = max(index.radii[1][r["j"]], r["q"])
    return placed


def _packed(placed: DataFrame, index: Index) -> DataFrame:
    """One row per part of a cell: ``cell, part, rows``."""
    spark, width = placed.sparkSession, index.shape[1]
    sizes = spark.createDataFrame([(int(c), int(p)) for c, p in enumerate(index.parts().ravel()) if p], "cell int, parts int")
    rows = placed.select((F.col("i") * width + F.col("j")).alias("cell"), F.struct("vec_id", "label", "v").alias("row"),
                         F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("deal"))
    return written(rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod("deal", "parts").cast("int"))
                   .groupBy("cell", "part").agg(F.collect_list("row").alias("rows")))


WANTED = "anchor long, anchor_id long, label int, v binary, at int, low array<long>, high array<long>, need array<long>"


def _asked(state: DataFrame, index: Index, budget: int) -> DataFrame:
    """Every open anchor with the cells it has to see next and the place ``at`` after them."""
    sizes, parts = index.rows.ravel(), index.parts().ravel()

    def next_cells(q: np.ndarray, at: int, low: list, high: list, need: list):
        cells, seen = [], 0
        least = [max(a, b) for a, b in zip(low, need)]
        if not least:
            return at, cells
        floor = min(least)
        for place, (cell, upper, lower) in enumerate(index.cells(q)):
            if place < at:
                continue
            if upper + SLACK < floor or seen >= budget:
                break
            at = place + 1
            if sizes[cell] and any(upper + SLACK >= a and lower - SLACK <= b for a, b in zip(least, high)):
                cells.append({"cell": cell, "parts": int(parts[cell])})
                seen += int(sizes[cell])
        return at, cells

    def run(batches):
        for batch in batches:
            out = [next_cells(np.frombuffer(v, index.kind).astype(np.float64), at, low, high, need) for v, at, low, high, need in zip(
                *(batch.column(c).to_pylist() for c in ("v", "at", "low", "high", "need")))]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["at"] = pa.array([o[0] for o in out], pa.int32())
            columns["cells"] = pa.array([o[1] for o in out], pa.list_(pa.struct([("cell", pa.int32()), ("parts", pa.int32())])))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return written(state.mapInArrow(run, WANTED + ", cells array<struct<cell: int, parts: int>>"))


def _found(asked: DataFrame, parts: DataFrame, index: Index, groups: int, same: bool, most: int) -> DataFrame:
    """``anchor, list, score, id``: from every asked part, the best rows of each list of each anchor."""
    def best(scores, ids, hits):
        at = np.flatnonzero(hits)
        if len(at) > most:
            edge = np.partition(scores[at], len(at) - most)[len(at) - most]
            at = at[scores[at] >= edge]
        return at[np.lexsort((ids[at], -scores[at]))[:most]]

    def run(batches):
        exact = np.float64 if index.kind == "<i2" and index.dims < 1 << 22 else np.int64
        for batch in batches:
            out = []
            for rows, anchors in zip(batch.column("rows"), batch.column("anchors")):
                rows, anchors = rows.values, anchors.values
                x = np.frombuffer(b"".join(rows.field("v").to_pylist()), index.kind).reshape(-1, index.dims)
                q = np.frombuffer(b"".join(anchors.field("v").to_pylist()), index.kind).reshape(-1, index.dims)
                ids, labels = rows.field("vec_id").to_numpy(), rows.field("label").to_numpy()
                score = (q.astype(exact) @ x.astype(exact).T).astype(np.int64)
                own, label = anchors.field("anchor_id").to_numpy(), anchors.field("label").to_numpy()
                able = (label[:, None] == labels) & (own[:, None] != ids) if same else label[:, None] != labels
                lists = [anchors.field(c).to_pylist() for c in ("low", "high", "need")]
                for k in range(max(map(len, lists[0]))):
                    inside = [len(low) > k for low in lists[0]]
                    low = np.array([max(a[k], b[k]) if i else 0 for a, b, i in zip(lists[0], lists[2], inside)])
                    high = np.array([b[k] if i else -1 for b, i in zip(lists[1], inside)])
                    hits = able & (score >= low[:, None]) & (score <= high[:, None]) & np.array(inside)[:, None]
                    for a in np.flatnonzero(hits.any(1)).tolist():
                        at = best(score[a], ids, hits[a])
                        out.append((np.full(len(at), anchors.field("anchor")[a].as_py()), np.full(len(at), k, np.int32), score[a][at], ids[at]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "list", "score", "id"])
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("group")
    requests = (asked.select(group, F.struct("anchor", "anchor_id", "label", "v", "low", "high", "need").alias("one"), F.explode("cells").alias("c"))
                .groupBy("c.cell", "c.parts", "group").agg(F.collect_list("one").alias("anchors"))
                .select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "anchors"))
    return requests.join(parts, ["cell", "part"]).select("rows", "anchors").mapInArrow(run, "anchor long, list int, score long, id long")


def _searched(state: DataFrame, parts: DataFrame, index: Index, groups: int, same: bool, most: int) -> DataFrame:
    """The ``most`` best rows of every list of every anchor, in rounds until the lists of all anchors are certified."""
    best, budget = None, FIRST
    place = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id")
    while True:
        asked = _asked(state, index, budget)
        if asked.where(F.size("cells") > 0).isEmpty():
            break
        found = _found(asked.where(F.size("cells") > 0), parts, index, groups, same, most)
        found = found.unionByName(best.drop("place")) if best is not None else found
        best = written(found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most))
        full = (best.where(F.col("place") == most).groupBy("anchor")
                .agg(F.map_from_entries(F.collect_list(F.struct("list", "score"))).alias("full")))
        # from now on a list needs more than what it holds: a tie with its last score can still win by its id
        state = asked.drop("cells").join(full, "anchor", "left").withColumn("need", F.transform(
            "low", lambda x, k: F.coalesce(F.try_element_at("full", k), x))).drop("full").select(*state.columns)
        budget *= GROW
    return best if best is not None else state.sparkSession.createDataFrame([], "anchor long, list int, score long, id long, place int")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``vec_id, label, v`` of whole numbers.

    ``is_anchor`` picks the anchors by ``vec_id`` or ``label``; ``low`` and ``high`` bound a negative's score in hundredths of the
    positive's.
    """
    spark = rows.sparkSession
    rows = written(rows.select("vec_id", "label", "v"))
    index = _fitted(rows)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    placed = _placed(rows, index)
    parts = _packed(placed, index)
    anchors = written(placed.where(is_anchor).select(
        F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v"))
    groups = max(1, -(-anchors.count() // GROUP_ANCHORS))
    least, most = F.lit(-(1 << 62)), F.lit(1 << 62)
    state = anchors.select("*", F.lit(0).alias("at"), F.array(least).alias("low"), F.array(most).alias("high"), F.array(least).alias("need"))
    first = _searched(state, parts, index, groups, True, positives).select(
        "anchor", F.col("place").alias("list"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    # whole-number ends of the window: low * p <= 100 * score <= high * p
    windows = written(first.where("positive_score >= 0").select(
        "*", F.expr(f"({low} * positive_score + 99) div 100").alias("l"), F.expr(f"({high} * positive_score) div 100").alias("h"),
        (F.row_number().over(Window.partitionBy("anchor").orderBy("list")) - 1).alias("k")))
    ends = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("k", "l", "h"))).alias("w"))
    state = anchors.join(ends, "anchor").select(
        "anchor", "anchor_id", "label", "v", F.lit(0).alias("at"), F.col("w.l").alias("low"), F.col("w.h").alias("high"), F.col("w.l").alias("need"))
    second = _searched(written(state), parts, index, groups, False, negatives)
    return (second.join(windows.withColumnRenamed("list", "nth").withColumnRenamed("k", "list"), ["anchor", "list"])
            .join(anchors.select("anchor", "anchor_id"), "anchor")
            .select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
