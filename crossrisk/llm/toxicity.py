"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of code points of a text (A-Z in lower case), hashed into 2**20 buckets.  From labelled
rows Spark counts, for each bucket, the texts of either class that hold it; their log ratio scales the feature.  The
buckets whose rates differ most become the features of a logistic regression with an L2 penalty, whose weights times the
ratios are the scorer's table.

Bounds: at most about ``SAMPLE`` labelled rows of a class are fitted on, chosen by a hash of the id and weighted back to
their share; ``FEATURES`` buckets have a weight.  Both are parameters.  Every row is scored on its whole text.

A null or empty text has no n-gram and gets the score of the intercept.  Labels that are null are left out; an id with
several labels counts as toxic if one says so.  Without a toxic row to learn from every score is 0.  Repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import crc_rest, groups, raw, texts, tidy

SIZES = (4, 5)
BITS = 20
SAMPLE = 10_000
FEATURES = 2048
PENALTY = 2.0
ROUNDS = 150
STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(data: memoryview, offsets: np.ndarray, sizes=SIZES):
    """For each group of rows: first row, rows, the row of every n-gram and its bucket, one array for each size."""
    for lo, hi in groups(offsets):
        block = bytes(data[offsets[lo]:offsets[hi]]).lower()  # bytes: only A-Z change
        points = np.frombuffer(block.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        lead = np.cumsum(np.append(0, np.frombuffer(block, np.int8) >= -64))
        edges = lead[offsets[lo:hi + 1] - offsets[lo]]
        parts = []
        for n in sizes:
            count = np.maximum(np.diff(edges) - n + 1, 0)
            m = len(points) - n + 1
            if m <= 0:
                continue
            code = points[:m].copy()
            for j in range(1, n):
                code *= STEP
                code += points[j:j + m]
            code ^= code >> np.uint64(32)
            code *= STEP
            code >>= np.uint64(64 - BITS)
            parts.append((edges[:-1], count, code.astype(np.int64)))
        yield lo, hi, parts


def _inside(starts: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending positions, those that begin an n-gram inside a row, and their rows."""
    row = np.searchsorted(starts, at, "right") - 1
    ok = at - starts[row] < counts[row]
    return at[ok], row[ok]


def distinct(parts, wanted: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the distinct wanted n-grams; ``wanted``: a flag for each bucket."""
    keys = []
    for starts, counts, code in parts:
        at, row = _inside(starts, counts, np.flatnonzero(wanted[code]))
        keys.append(row << BITS | code[at])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    """Weight of each bucket (log ratio times coefficient) and the intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, data: memoryview, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.intercept)
        wanted = self.weights != 0
        for lo, hi, parts in grams(data, offsets):
            row, code = distinct(parts, wanted, hi - lo)
            out[lo:hi] += np.bincount(row, self.weights[code], hi - lo)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-out))


def _sample(docs: DataFrame, labels: DataFrame, learn: bool) -> tuple[DataFrame, dict[int, float]]:
    """Labelled texts for fitting, and what share of each class they are."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    if learn:
        known = known.where(crc_rest("doc_id", 5) != 0)
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, SAMPLE / n) for k, n in counts.items()}
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.when(
        F.col("toxic") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0))) * 1_000_000)
    return texts(docs).join(F.broadcast(few), "doc_id").select("toxic", "text"), share


def _fit(rows: list, features: list, share: dict[int, float]) -> Model:
    """Logistic regression on the log ratios, by gradient steps with one step size for each feature.

    The intercept stays at the log odds of the classes, which is the score of a text without n-grams.
    """
    codes = np.array([f["code"] for f in features], np.int64)
    ratio = np.array([f["ratio"] for f in features])
    target = np.array([r["toxic"] for r in rows], float)
    weight = np.array([1 / share[r["toxic"]] for r in rows])
    place = np.concatenate([np.frombuffer(r["codes"], "<u2") for r in rows]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r["codes"]) // 2 for r in rows])
    value = ratio[place]
    coef, intercept = np.zeros(len(codes)), float(np.log((weight * target).sum() / (weight * (1 - target)).sum()))
    seen = np.full(len(codes), 1e-8)
    scale = weight / weight.mean()
    for _ in range(ROUNDS):
        z = intercept + np.bincount(row, value * coef[place], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * scale
        slope = np.bincount(place, value * error[row], len(codes)) + PENALTY * coef
        seen = seen + slope ** 2
        coef -= 0.1 * slope / np.sqrt(seen)
    weights = np.zeros(1 << BITS, np.float32)
    weights[codes] = ratio * coef
    return Model(weights, intercept)


def train(docs: DataFrame, labels: DataFrame, learn: bool = True) -> Model:
    """``learn``: leave out the ids that are held out (CRC-32 of the id, remainder 0 by 5)."""
    sample, share = _sample(docs, labels, learn)
    if not share.get(1) or not share.get(0):
        return Model(np.zeros(1 << BITS, np.float32), np.inf if share.get(1) else -np.inf)

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        every = np.ones(1 << BITS, bool)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi, parts in grams(*raw(batch.column("text"))):
                row, code = distinct(parts, every, hi - lo)
                for k in (0, 1):
                    sums[k] += np.bincount(code[toxic[lo:hi][row] == k], minlength=1 << BITS)
        at = np.flatnonzero(sums.any(0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["code", "q", "p"])

    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Model(np.zeros(1 << BITS, np.float32), np.inf if totals.get(1) else -np.inf)
    n1, n0 = totals[1], totals[0]
    counts = (sample.mapInArrow(tidy(count), "code long, q long, p long").groupBy("code").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
              .withColumns({"a": (F.col("p") + 1) / (n1 + 2), "b": (F.col("q") + 1) / (n0 + 2)}))
    apart = F.abs(F.col("a") - F.col("b")) / F.sqrt(F.col("a") * (1 - F.col("a")) / n1 + F.col("b") * (1 - F.col("b")) / n0)
    features = (counts.select("code", F.log(F.col("a") / F.col("b")).alias("ratio"), apart.alias("apart"))
                .orderBy(F.desc("apart"), "code").limit(FEATURES).collect())
    order = np.full(1 << BITS, -1, np.int32)
    order[[f["code"] for f in features]] = np.arange(len(features))

    def active(batches):
        for batch in batches:
            found = []
            for lo, hi, parts in grams(*raw(batch.column("text"))):
                row, code = distinct(parts, order >= 0, hi - lo)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                place = order[code].astype("<u2")
                found += [place[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.binary())], names=["toxic", "codes"])
    return _fit(sample.mapInArrow(tidy(active), "toxic int, codes binary").collect(), features, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    def run(batches):
        for batch in batches:
            found = model.scores(*raw(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])
    return texts(docs).mapInArrow(tidy(run), "doc_id long, score double")


def keep(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows that score lower, with their own columns."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            text = batch.column(at)
            yield batch.filter(pa.array(model.scores(*raw(text.fill_null(""))) < below))
    return docs.mapInArrow(tidy(run), schema)
