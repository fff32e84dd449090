"""Alignment of two tokenizations of the same text, with corpus-wide counts of linked tokens.

Tokenizer A is byte-level BPE over a space and the text; B is a sentence-piece model, which adds the space itself.  Both
tokenizations cover the same bytes, so tokens that overlap are linked, and offsets at which tokens of both end cut the
links into groups.

1. *Whole texts are tokenised* by both.  A's ids are those of the text's own bytes; B's joined bytes are as many, and are compared
   with A's window by window.
2. *Anchors.*  An end shared by both, where the next token of both begins with a space, is an anchor.  Anchors cut a document
   into windows of token ids; a window's bytes, groups and links depend on nothing but its two id tuples.
3. *Memo.*  Groups, links and their digest text are computed once per pair of id tuples (up to ``LONGEST`` tokens) and looked up after
   that.  Windows of a chunk that are not in the memo are aligned together: every end of either side closes one link.
4. *Counts.*  A chunk of ``CHUNK_BYTES`` of text numbers its distinct id pairs and says how many of its documents hold each; the sum over chunks
   is a pair's count, its greatest over an A id is that id's best.
5. *Answers.*  Chunks get the counts of their pairs back: pairs of very many chunks (at most ``2 ** HOT_BITS``, as their rows add up) by
   broadcast, all others by a shuffle in which none is hot.

A null or empty text, or one whose joined bytes differ (white space that a tokenizer changes, pieces it does not know), has no
tokens: zeros and an empty digest.  Repeated rows are documents of their own.  Null ids stay null.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written
from .arrow import raw, texts, tidy
from .byte_bpe import RANK_FILE, codec

PIECE_FILE = "piece_bpe_32k.model"
CHUNK_BYTES = 2 << 20
LONGEST = 64
MEMO_ITEMS = 800_000
GROUP_TOKENS = 1 << 16     # of documents whose windows are cut together
HOT_BITS = 14
A_MARK = np.uint32(1 << 31)

CHUNK = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
    ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("groups_sha256", pa.list_(pa.string())),
    ("doc", pa.binary()), ("place", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("df", pa.list_(pa.int32()))])
CHUNK_DDL = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
             "groups_sha256 array<string>, doc binary, place binary, times binary, pairs array<long>, df array<int>")
DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _ranges(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())


def _merged(doc: np.ndarray, place: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (doc, place) once, with the sum of their weights."""
    if not len(doc):
        return doc, place, weight
    bits = int(weight.max()).bit_length()
    below = int(place.max()).bit_length() + bits
    if int(doc.max()).bit_length() + below < 64:        # one number sorts faster than an order of three
        packed = np.sort(doc << below | place << bits | weight)
        code, weight = packed >> bits, packed & (1 << bits) - 1
    else:
        order = np.lexsort((place, doc))
        below = 32 + bits
        code, weight = (doc << 32 | place)[order], weight[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    code, weight = code[first], np.add.reduceat(weight, first)
    return code >> below - bits, code & (1 << below - bits) - 1, weight


def _woven(group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of two sides' tokens when the groups follow each other, each with its tokens of A, then those of B."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    return (np.arange(len(group_a)) + (np.cumsum(count_b) - count_b)[group_a], np.arange(len(group_b)) + np.cumsum(count_a)[group_b])


class Aligner:
    """Both tokenizers and the memo of window alignments.

    A window's entry is its number of groups and of links, its digest text, and its pairs ``A id << 32 | B id`` with their
    occurrences, which stand in one pool from ``starts`` on.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a = codec(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.a.tokens
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([len(t) for t in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.spaced_a, self.spaced_b = (np.array([t[:1] == b" " for t in own]) for own in (self.bytes_a, self.bytes_b))
        # an id as digest text: inside a group or at the end of its side
        self.written = [b"%d%c" % (i, sign) for own, signs in ((self.bytes_a, b",|"), (self.bytes_b, b",;")) for i in range(len(own)) for sign in signs]
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.n_groups: list[int] = []
        self.n_links: list[int] = []
        self.digest: list[bytes] = []
        self.pairs, self.times, self.starts = array("q"), array("q"), array("q", [0])

    def tokens(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers for each row of a string column, or None where the lengths of their bytes differ."""
        listed = column.to_pylist()
        data, offsets = raw(pa.array([" " + s for s in listed], pa.large_string()))
        for n, a, b in zip(np.diff(offsets).tolist(), self.a.encode(data, offsets), self.b.encode(listed, num_threads=1)):
            b = np.array(b, np.uint32)
            yield (a.astype(np.uint32), b) if n > 1 and self.size_a[a].sum() == self.size_b[b].sum() == n else None

    def align(self, a: np.ndarray, b: np.ndarray, width_a: np.ndarray, width_b: np.ndarray) -> list[int]:
        """Align windows of ``width_a`` and ``width_b`` tokens, each equally long in bytes on both sides.

        Gives the number of each window's entry, or -1 where the bytes differ.
        """
        n, cut_a, cut_b = len(width_a), np.cumsum(width_a), np.cumsum(width_b)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != b"".join(map(self.bytes_b.__getitem__, b.tolist())):
            if n == 1:
                return [-1]
            return [self.align(a[q - w:q], b[s - v:s], np.array([w]), np.array([v]))[0] for q, s, w, v in zip(cut_a, cut_b, width_a, width_b)]
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
        i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        window = np.searchsorted(cut_a, i, "right")
        link = np.sort((window * len(self.bytes_a) + a[i]) * len(self.bytes_b) + b[j])
        first = np.flatnonzero(np.append(True, link[1:] != link[:-1]))
        of, link_b = np.divmod(link[first], len(self.bytes_b))
        of, link_a = np.divmod(of, len(self.bytes_a))
        last_a, last_b = end_b[np.searchsorted(end_b, end_a)] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        # digest text: in each group the ids of A, then those of B
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        codes = np.empty(len(a) + len(b), np.int64)
        place_a, place_b = _woven(group_a, group_b)
        codes[place_a] = 2 * a.astype(np.int64) + last_a
        codes[place_b] = 2 * (b.astype(np.int64) + len(self.bytes_a)) + last_b
        pieces = list(map(self.written.__getitem__, codes.tolist()))
        ends = (cut_a + cut_b).tolist()
        number = len(self.n_groups)
        self.digest += [b"".join(pieces[x:y])[:-1] for x, y in zip([0, *ends], ends)]
        self.n_groups += np.add.reduceat(last_a.astype(np.int64), cut_a - width_a).tolist()
        self.n_links += np.bincount(window, minlength=n).tolist()
        self.starts.extend((len(self.pairs) + np.cumsum(np.bincount(of, minlength=n))).tolist())
        self.pairs.extend((link_a << 32 | link_b).tolist())
        self.times.extend(np.diff(first, append=len(link)).tolist())
        return list(range(number, number + n))

    def windows(self, ids: list[tuple[np.ndarray, np.ndarray] | None]) -> list[list[int] | None]:
        """The entries of each document's windows; None for a document without ids or where the bytes of both differ somewhere."""
        out: list = [None] * len(ids)
        there, size = [], 0
        for d, pair in enumerate(ids):
            if pair is not None:
                there.append(d)
                size += len(pair[0]) + len(pair[1])
            if there and (size >= GROUP_TOKENS or d == len(ids) - 1):
                for e, own in zip(there, self._joined([ids[e][0] for e in there], [ids[e][1] for e in there])):
                    out[e] = None if -1 in own else own
                there, size = [], 0
        return out

    def _joined(self, of_a: list[np.ndarray], of_b: list[np.ndarray]) -> list[list[int]]:
        """The entries of the windows of documents, which are cut as one text with a cut at the end of each document."""
        a, b = np.concatenate(of_a), np.concatenate(of_b)
        stop_a, stop_b = np.cumsum([len(x) for x in of_a]), np.cumsum([len(x) for x in of_b])
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        spaced = np.flatnonzero(self.spaced_a[a[1:]])
        at = np.searchsorted(end_b, end_a[spaced])  # below the last place, as the last ends are equal
        anchor = (end_b[at] == end_a[spaced]) & self.spaced_b[b[np.minimum(at + 1, len(b) - 1)]]
        cut_a = np.union1d(spaced[anchor] + 1, stop_a)
        cut_b = np.searchsorted(end_b, end_a[cut_a - 1]) + 1
        stops = np.searchsorted(cut_a, stop_a)
        cut_b[stops] = stop_b
        wide_a, wide_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        number = np.arange(len(wide_a))
        place_a, place_b = _woven(np.repeat(number, wide_a), np.repeat(number, wide_b))
        both = np.empty(len(a) + len(b), np.uint32)
        both[place_a], both[place_b] = a | A_MARK, b
        whole, ends = both.tobytes(), (4 * (cut_a + cut_b)).tolist()
        keys = [whole[x:y] for x, y in zip([0, *ends], ends)]
        entries = list(map(self.memo.get, keys))
        if None in entries:
            missed = [k for k, entry in enumerate(entries) if entry is None]
            new: dict[bytes, int] = {}
            for k in missed:
                new.setdefault(keys[k], k)
            own = np.fromiter(new.values(), np.int64, len(new))
            found = dict(zip(new, self.align(a[_ranges((cut_a - wide_a)[own], wide_a[own])], b[_ranges((cut_b - wide_b)[own], wide_b[own])],
                                             wide_a[own], wide_b[own])))
            for k in missed:
                entries[k] = found[keys[k]]
            self.memo.update((key, entry) for key, entry in found.items() if len(key) <= 4 * LONGEST)
        stops = (stops + 1).tolist()
        return [entries[x:y] for x, y in zip([0, *stops], stops)]


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or public_tokenizers.path(RANK_FILE), path_b or public_tokenizers.path(PIECE_FILE)


class _Chunk:
    """Documents of one chunk: first their ids, then their windows."""

    def __init__(self):
        self.docs: list = []
        self.ids: list = []
        self.size = 0

    def add(self, doc, text_bytes: int, ids) -> None:
        self.size += text_bytes + 64
        self.docs.append(doc)
        self.ids.append(ids)

    def _align(self, own: Aligner) -> None:
        self.rows, self.entries = [], []
        windows = own.windows(self.ids)
        n_groups, n_links = np.array(own.n_groups, np.int64), np.array(own.n_links, np.int64)
        for doc, ids, entries in zip(self.docs, self.ids, windows):
            if entries is None:
                self.rows.append((doc, 0, 0, 0, 0, ""))
                self.entries.append(np.zeros(0, np.int64))
                continue
            digest = hashlib.sha256(b";".join(map(own.digest.__getitem__, entries))).hexdigest()
            entries = np.array(entries, np.int64)
            self.rows.append((doc, len(ids[0]), len(ids[1]), int(n_groups[entries].sum()), int(n_links[entries].sum()), digest))
            self.entries.append(entries)

    def batch(self, own: Aligner, number: int) -> pa.RecordBatch:
        """Every (document, pair) once, with its occurrences; pairs are numbered inside the chunk."""
        self._align(own)
        doc = np.repeat(np.arange(len(self.entries)), [len(e) for e in self.entries])
        code, times = np.unique(doc << 32 | np.concatenate(self.entries), return_counts=True)
        doc, entry = code >> 32, code & 0xFFFFFFFF
        starts, flat, counts = (np.array(x, np.int64) for x in (own.starts, own.pairs, own.times))
        mark = np.zeros(len(starts) - 1, bool)
        mark[entry] = True
        used = np.flatnonzero(mark)
        entry = (np.cumsum(mark) - 1)[entry]
        width = np.diff(starts)[used]
        at = _ranges(starts[used], width)
        pairs, place = np.unique(flat[at], return_inverse=True)
        counts, first = counts[at], np.cumsum(width) - width
        at = _ranges(first[entry], width[entry])
        doc, place = np.repeat(doc, width[entry]), place[at]
        doc, place, weight = _merged(doc, place, np.repeat(times, width[entry]) * counts[at])
        df = np.bincount(place, minlength=len(pairs))
        values = [number, *map(list, zip(*self.rows)), doc.astype("<u4").tobytes(), place.astype("<u4").tobytes(),
                  weight.astype("<u4").tobytes(), pairs, df.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, CHUNK)], schema=CHUNK)


def chunks(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per chunk of aligned documents; a chunk's number comes from its task, so the table is to be written before use."""
    paths = _paths(path_a, path_b)

    def run(batches):
        own, part, number, chunk = aligner(*paths), TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            step = max(1, min(len(batch), (1 << 20) * len(batch) // max(batch.nbytes, 1)))
            for lo in range(0, len(batch), step):
                rows = batch.slice(lo, step)
                sizes = np.diff(raw(rows.column("text"))[1])
                for doc, size, ids in zip(rows.column("doc_id").to_pylist(), sizes.tolist(), own.tokens(rows.column("text"))):
                    chunk.add(doc, size, ids)
                    if chunk.size >= CHUNK_BYTES:
                        yield chunk.batch(own, (part << 32) + number)
                        number, chunk = number + 1, _Chunk()
                        if len(own.n_groups) > MEMO_ITEMS:
                            own.forget()
        if chunk.docs:
            yield chunk.batch(own, (part << 32) + number)
    return texts(docs).mapInArrow(tidy(run), CHUNK_DDL)


def pair_counts(table: DataFrame) -> DataFrame:
    """``pair, a_id, b_id, count, best, n_chunks`` of every linked pair of ids; ``best`` marks the highest count of an A id."""
    pairs = table.select(F.explode(F.arrays_zip("pairs", "df")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(
        F.sum("x.df").alias("count"), F.count("*").alias("n_chunks"))
    a = F.shiftright("pair", 32)
    return pairs.select("pair", a.alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "count",
                        (F.col("count") == F.max("count").over(Window.partitionBy(a))).alias("best"), "n_chunks")


def _answered(table: DataFrame, known: DataFrame) -> DataFrame:
    """``chunk, answers``: place, count and best of every pair of the chunk."""
    rows = known.agg(F.sum("n_chunks")).first()[0] or 0
    many = F.col("n_chunks") > max(64, rows >> HOT_BITS)
    hot, cold = known.where(many).select("pair", "count", "best"), known.where(~many).select("pair", "count", "best")
    asked = table.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    met = asked.join(F.broadcast(hot), "pair", "left")
    columns = ["chunk", "at", "count", "best"]
    answers = met.where("count is not null").select(*columns).unionByName(
        met.where("count is null").select("chunk", "at", "pair").join(cold, "pair").select(*columns))
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("at", "count", "best")).alias("answers"))


def digests(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: tokens of both, groups, links, how many links are the best of their A id, and the sum of their counts."""
    table = written(chunks(docs, path_a, path_b))
    known = written(pair_counts(table))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                n, pairs = len(row["doc_id"]), len(row["pairs"])
                count, best = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
                if row["answers"].is_valid:
                    at, known, top = (row["answers"].values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "count", "best"))
                    count[at], best[at] = known, top
                doc, place, times = (np.frombuffer(row[c].as_buffer(), "<u4") for c in ("doc", "place", "times"))
                first = np.flatnonzero(np.diff(doc, prepend=n))     # documents stand in order
                sums = np.zeros((2, n), np.int64)
                if len(first):
                    for total, value in zip(sums, (best, count)):
                        total[doc[first]] = np.add.reduceat(value[place] * times, first)
                yield pa.RecordBatch.from_arrays(
                    [row[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(s) for s in sums]
                    + [row["groups_sha256"].values], names=[c.split()[0] for c in DOCUMENT.split(", ")])
    whole = table.drop("df").join(_answered(table, known), "chunk", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "doc", "place", "times", "pairs", "answers")
    return whole.mapInArrow(tidy(run), DOCUMENT)


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """``doc_id, a, b, groups``: the ids of both tokenizers and the groups as ``a1,a2|b1;a3|b2,b3``."""
    paths = _paths(path_a, path_b)

    def run(batches):
        own = aligner(*paths)
        for batch in batches:
            ids, groups = [], []
            tokens = list(own.tokens(batch.column("text")))
            for x, entries in zip(tokens, own.windows(tokens)):
                ids.append((np.zeros(0, np.uint32),) * 2 if entries is None else x)
                groups.append(b";".join(map(own.digest.__getitem__, entries or [])).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([x[k].astype(np.int32) for x in ids], pa.list_(pa.int32())) for k in (0, 1)],
                 pa.array(groups, pa.string())], names=["doc_id", "a", "b", "groups"])
            if len(own.n_groups) > MEMO_ITEMS:
                own.forget()
    return texts(docs).mapInArrow(tidy(run), "doc_id long, a array<int>, b array<int>, groups string")
