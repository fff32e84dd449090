"""Language-model scores by a hidden Markov model over word classes.

A text is the sequence of its words and one end token.  A word's class comes from its spelling alone (a short word itself,
otherwise its last three bytes; hashed into ``CLASSES``).  A latent state emits a class, a class emits a word by add-one
counts over the corpus, with one place for words never seen.  Baum-Welch runs over all training texts: every task sums its
expected counts, Spark sums those of the tasks, and the bounded tables of transitions and emissions come back as the next
model.  Training cuts texts into segments of ``SEGMENT`` tokens; scoring does not: each segment becomes the matrix
that takes any state before it to the states after it, and the scaled product of a text's matrices is its exact likelihood.

Word counts grow with the corpus, so they stay in Spark.  Texts are encoded in chunks with a vocabulary of their own; the
distinct words of the chunks are counted, joined back, and each chunk gets the counts of its own words.

A null or empty text is the end token alone.  Rows without an id are learned from.  Repeated rows count, and are scored,
each for itself.  An empty table gives an empty result; without training rows every count is 0 and the emissions are
uniform.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .arrow import crc_rest, raw, texts, tidy

STATES = 6
CLASSES = 4096
ROUNDS = 6
SEGMENT = 128
CHUNK_BYTES = 12 << 20
BATCH = 2048
END = b" "  # no word holds a space
SMOOTH = 0.1
CHUNK = ("chunk long, docs array<long>, held array<boolean>, lengths array<int>, seq binary, classes binary, "
         "words array<binary>, counts array<long>, class_of array<int>")


def word_class(word: bytes) -> int:
    """0 is the end token's own class."""
    if word == END:
        return 0
    return 1 + zlib.crc32(word if len(word) <= 4 else b" " + word[-3:]) % (CLASSES - 1)


def encoded(docs: DataFrame) -> DataFrame:
    """Texts in chunks: ids in the chunk's own vocabulary, and that vocabulary with its counts in training texts."""
    rows = texts(docs).select("doc_id", "text", F.coalesce(crc_rest("doc_id", 7) == 2, F.lit(False)).alias("held"))

    def run(batches):
        part = TaskContext.get().partitionId()

        class Chunk:
            def __init__(self):
                self.vocabulary = defaultdict()
                self.vocabulary.default_factory = self.vocabulary.__len__
                self.docs, self.held, self.lengths, self.ids, self.size = [], [], [], [], 0

            def row(self, number):
                seq = np.concatenate(self.ids)
                learn = np.repeat(~np.array(self.held), self.lengths)
                words = list(self.vocabulary)
                counts = np.bincount(seq[learn], minlength=len(words))
                classes = np.fromiter(map(word_class, words), "<u2", len(words))
                cells = [(part << 32) + number, self.docs, self.held, self.lengths, seq.tobytes(), classes.tobytes(), words,
                         counts, classes.astype(np.int32)]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(),
                         pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)],
                                                  names=[c.split()[0] for c in CHUNK.split(", ")])
        chunk, number = Chunk(), 0
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            docs, held = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            for i in range(len(docs)):
                text = bytes(data[offsets[i]:offsets[i + 1]])
                words = text.lower().split()  # of bytes: A-Z only; the six ASCII white characters
                words.append(END)
                ids = np.fromiter(map(chunk.vocabulary.__getitem__, words), "<u4", len(words))
                chunk.docs.append(docs[i])
                chunk.held.append(held[i])
                chunk.lengths.append(len(words))
                chunk.ids.append(ids)
                chunk.size += len(text)
                if chunk.size >= CHUNK_BYTES:
                    yield chunk.row(number)
                    chunk, number = Chunk(), number + 1
        if chunk.docs:
            yield chunk.row(number)
    return rows.mapInArrow(tidy(run), CHUNK)


@dataclass
class Model:
    """Start, later-start and transition probabilities of states; emissions by class and state."""

    start: np.ndarray
    later: np.ndarray
    moves: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(share: np.ndarray, states: int) -> Model:
        """All states near the corpus distribution of classes, drawn apart by fixed random factors."""
        emit = share[:, None] * (0.5 + np.random.default_rng(0).random((len(share), states)))
        moves = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
        even = np.full(states, 1 / states)
        return Model(even, even, moves, emit / emit.sum(0))


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each segment begins in the flat sequence, its length, and whether it opens a text."""
    count = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(lengths) - lengths, count) + within * SEGMENT
    return begin, np.minimum(SEGMENT, lengths[text] - within * SEGMENT), within == 0


def expected(model: Model, classes: np.ndarray, lengths: np.ndarray) -> tuple:
    """Expected starts, later starts, moves and emissions, and the log likelihood of the segments."""
    k = len(model.start)
    start, later, moves = np.zeros(k), np.zeros(k), np.zeros((k, k))
    emit, total = np.zeros(model.emit.shape), 0.0
    begins, sizes, opens = _segments(lengths)
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), BATCH):
        own = order[lo:lo + BATCH]
        begin, size, first = begins[own], sizes[own], opens[own]
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(steps), "left")  # segments longer than t come first
        alpha = np.zeros((steps, len(own), k))
        seen = np.zeros((steps, len(own)), np.int64)
        scale = np.ones((steps, len(own)))
        a = np.where(first[:, None], model.start, model.later)
        for t in range(steps):
            n = live[t]
            seen[t, :n] = classes[begin[:n] + t]
            a = (a[:n] if t == 0 else a[:n] @ model.moves) * model.emit[seen[t, :n]]
            scale[t, :n] = a.sum(1)
            a = a / scale[t, :n, None]
            alpha[t, :n] = a
        total += np.log(scale).sum()
        beta = np.ones((len(own), k))
        for t in range(steps - 1, -1, -1):
            n = live[t]
            weighted = model.emit[seen[t, :n]] * beta[:n] / scale[t, :n, None]
            before = alpha[t - 1, :n] if t else np.where(first[:, None], model.start, model.later)[:n]
            alpha[t, :n] *= beta[:n]
            if t:
                moves += before.T @ weighted
                beta[:n] = weighted @ model.moves.T
        gone = alpha[0] / np.maximum(alpha[0].sum(1, keepdims=True), 1e-300)
        start += gone[first].sum(0)
        later += gone[~first].sum(0)
        mask = np.arange(steps)[:, None] < size
        flat = seen[mask]
        for s in range(k):
            emit[:, s] += np.bincount(flat, alpha[:, :, s][mask], len(emit))
    return start, later, moves * model.moves, emit, total


def likelihood(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact natural-log likelihood of every whole sequence: scaled forward recursion over segment matrices."""
    k = len(model.start)
    begins, sizes, opens = _segments(lengths)
    order = np.argsort(-sizes, kind="stable")
    matrix, logs = np.zeros((len(order), k, k)), np.zeros(len(order))
    for lo in range(0, len(order), BATCH):
        own = order[lo:lo + BATCH]
        begin, size = begins[own], sizes[own]
        live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        now = np.where(opens[own][:, None, None], np.eye(k), model.moves) * model.emit[classes[begin]][:, None, :]
        log = np.zeros(len(own))
        for t in range(1, int(size[0])):
            n = live[t]
            now[:n] = (now[:n].reshape(-1, k) @ model.moves).reshape(n, k, k) * model.emit[classes[begin[:n] + t]][:, None, :]
            if t % 16 == 0:
                top = now[:n].max((1, 2))
                now[:n] /= top[:, None, None]
                log[:n] += np.log(top)
        matrix[own], logs[own] = now, log
    count = -(-lengths // SEGMENT)
    at = np.cumsum(count) - count
    vector = np.tile(model.start, (len(lengths), 1))
    out = np.zeros(len(lengths))
    for j in range(int(count.max(initial=0))):
        texts_left = np.flatnonzero(count > j)
        own = at[texts_left] + j
        step = np.einsum("ni,nij->nj", vector[texts_left], matrix[own])
        size = step.sum(1)
        vector[texts_left] = step / size[:, None]
        out[texts_left] += np.log(size) + logs[own]
    return out


def baum_welch(chunks: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Expected counts of all tasks, summed by Spark, give the next model; ``share``: corpus share of each class."""
    model = Model.first((share + SMOOTH / len(share)) / (share.sum() + SMOOTH), states)
    k, m = states, len(share)
    for _ in range(rounds):
        def run(batches, model=model):
            sums = np.zeros(2 * k + k * k + m * k)
            for batch in batches:
                for row in batch.to_pylist():
                    lengths, held = np.array(row["lengths"], np.int64), np.array(row["held"], bool)
                    if held.all():
                        continue
                    learn = np.repeat(~held, lengths)
                    classes = np.frombuffer(row["classes"], "<u2")[np.frombuffer(row["seq"], "<u4")[learn]].astype(np.int64)
                    parts = expected(model, classes, lengths[~held])
                    sums += np.concatenate([p.ravel() for p in parts[:4]])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["cell", "value"])
        cells = (chunks.select("lengths", "held", "seq", "classes").mapInArrow(tidy(run), "cell long, value double")
                 .groupBy("cell").agg(F.sum("value").alias("value")).collect())  # at most one row for each cell of the model
        sums = np.zeros(2 * k + k * k + m * k)
        for c in cells:
            sums[c["cell"]] = c["value"]
        even = lambda x: (x + SMOOTH) / (x + SMOOTH).sum(-1, keepdims=True)
        emit = sums[2 * k + k * k:].reshape(m, k) + SMOOTH * model.emit
        model = Model(even(sums[:k]), even(sums[k:2 * k]), even(sums[2 * k:2 * k + k * k].reshape(k, k)), emit / emit.sum(0))
    return model


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Counts, the add-one unigram score, and the model's log10 probability of every text."""
    chunks = written(encoded(docs))
    vocabulary = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts", "class_of")).alias("place", "w")).select(
        "chunk", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.col("w.class_of").alias("class"))
    counts = written(vocabulary.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"), F.first("class").alias("class")))
    of_class = counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n_class, v_class = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in of_class:
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    tokens, kinds = int(n_class.sum()), int(v_class.sum())
    model = baum_welch(chunks, n_class.astype(float) / max(tokens, 1), states, rounds)
    back = (vocabulary.select("chunk", "place", "word").join(counts.select("word", "c"), "word", "left")
            .groupBy("chunk").agg(F.collect_list(F.struct("place", F.coalesce("c", F.lit(0)).alias("c"))).alias("known"))
            .select("chunk", F.transform("known", lambda x: x["place"]).alias("places"), F.transform("known", lambda x: x["c"]).alias("c")))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i]  # noqa: E731, B023
                seq = np.frombuffer(cell("seq").as_py(), "<u4")
                lengths = cell("lengths").values.to_numpy().astype(np.int64)
                of_word = np.frombuffer(cell("classes").as_py(), "<u2")
                c = np.zeros(len(of_word), np.int64)
                c[cell("places").values.to_numpy()] = cell("c").values.to_numpy()
                base = np.log10((c + 1) / (tokens + kinds + 1))
                given = np.log10((c + 1) / (n_class[of_word] + v_class[of_word] + 1))
                given[of_word == 0] = 0.0
                ends = np.cumsum(lengths)
                starts = ends - lengths
                summed = lambda x: np.add.reduceat(x[seq], starts)  # noqa: E731, B023
                latent = likelihood(model, of_word[seq].astype(np.int64), lengths) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [cell("docs").values, cell("held").values, pa.array(lengths), pa.array(summed((c > 0).astype(np.int64))),
                     pa.array(np.full(len(lengths), tokens, np.int64)), pa.array(summed(base)), pa.array(latent + summed(given))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return (chunks.select("chunk", "docs", "held", "lengths", "seq", "classes").join(back, "chunk").drop("chunk")
            .mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
