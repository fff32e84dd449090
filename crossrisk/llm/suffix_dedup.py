"""Suffix-array dedup: remove every byte covered by a 200-byte string that also starts anywhere else.

The strings that can repeat are found first, without loss.  Of every 200-byte string the 32-byte piece with the least hash (the
last of equal ones) is its anchor.  Equal strings have equal anchors at equal distances, so a string whose anchor's hash is
unique among all anchors cannot repeat.  Spark counts the anchors, and the texts meet those that occur twice or more.

What remains are segments: an anchor with the stretch of all strings that it stands for.  Segments meet by anchor; equal ones
are collapsed, with a list of where they stand, first inside a batch of texts, then in the shard.  The distinct segments
of a shard are one text for the external induced suffix sort (``induced``), whose common prefixes tell which strings start
at two places.  Strings of collapsed segments repeat anyway.

A shard's segments arrive sorted and go to a file, and the sort keeps its queues on disk beyond a limit.  An anchor all of whose
segments stand at several places needs no sort.  Places come back as ranges of starts, and the texts are cut by them.

A null or empty text has no byte.  Repeated rows repeat each other's strings.  Rows with one id are treated together when
anchors are chosen and apart when bytes are removed; each row of an id loses the same places as in its own text only, because
ranges carry the text's digest.  Texts below 200 bytes lose nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .arrow import raw, texts, tidy
from .induced import Disk, repeated
from .shingles import PRIME, _powers, mix

SIZE = 200
ANCHOR = 32
PIECE = 1 << 19
SHARD_BYTES = 1 << 20  # sorted at once, except for an anchor that has more
HELD_BYTES = 4 << 20  # segments collapsed before they are sent
MOST_BROADCAST = 1_000_000  # spans of 24 bytes
SEGMENT = "hash long, segment binary, doc_ids array<long>, digests array<long>, starts array<long>"


def _windows(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32-byte pieces of a block, and for each 200-byte window the place of its anchor."""
    n, k = len(block), ANCHOR
    up, down = _powers(1 << max(PIECE + SIZE, n).bit_length())
    numbers = np.random.default_rng(11).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(numbers[block] * up[:n], dtype=np.uint64))
    code = mix((sums[k:] - sums[:-k]) * down[:n - k + 1])
    place = np.arange(len(code), dtype=np.uint64)
    least = code >> np.uint64(24) << np.uint64(24) | (np.uint64((1 << 24) - 1) - place)  # of equal ones the last
    width, want = 1, SIZE - k + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[:len(least) - (want - width)], least[want - width:])
    at = (np.uint64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1))).astype(np.int64)
    return code, at


def _pieces(offsets: np.ndarray):
    """Blocks of whole rows of about ``PIECE`` bytes; a longer row comes in blocks that overlap by 199 bytes.

    First row, rows, first byte and end.
    """
    lo, n = 0, len(offsets) - 1
    while lo < n:
        if offsets[lo + 1] - offsets[lo] > PIECE:
            for a in range(int(offsets[lo]), int(offsets[lo + 1]) - SIZE + 1, PIECE):
                yield lo, 1, a, min(a + PIECE + SIZE - 1, int(offsets[lo + 1]))
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        yield lo, hi - lo, int(offsets[lo]), int(offsets[hi])
        lo = hi


def ranges(data: memoryview, offsets: np.ndarray):
    """Ranges of windows with one anchor: row, anchor hash, first and last start (bytes from the row's begin), block by block."""
    for lo, rows, a, b in _pieces(offsets):
        if b - a < SIZE:
            continue
        code, at = _windows(np.frombuffer(data[a:b], np.uint8))
        # rows of the windows: those that would leave their row are no windows
        sizes = np.minimum(offsets[lo + 1:lo + rows + 1], b) - np.maximum(offsets[lo:lo + rows], a)
        row = np.repeat(np.arange(lo, lo + rows), sizes)[:len(at)]
        ok = np.ones(len(at), bool)
        for end in (np.cumsum(sizes)[:-1]).tolist():
            ok[max(end - SIZE + 1, 0):end] = False
        start = np.flatnonzero(ok)
        if not len(start):
            continue
        row, at = row[start], at[start]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
        last = np.append(first[1:], len(start)) - 1
        base = offsets[row[first]] - a
        yield row[first], code[at[first]].view(np.int64), start[first] - base, start[last] - base


def _anchors(rows: DataFrame) -> DataFrame:
    """Anchor hashes of each row, with how often each occurs in it."""
    def run(batches):
        for batch in batches:
            row, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r, c, _, _ in ranges(*raw(batch.column("text"))):
                row.append(r)
                code.append(c)
            row, code = np.concatenate(row), np.concatenate(code)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.zeros(0, np.int64)
            count = np.diff(at, append=len(row))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row[at])), pa.array(code[at]), pa.array(count)],
                                             names=["key", "hash", "n"])
    return rows.mapInArrow(tidy(run), "key long, hash long, n long")


def _digest(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _segments(met: DataFrame) -> DataFrame:
    """The segments of repeated anchors; equal ones of some texts are one row."""
    def sent(found: dict) -> pa.RecordBatch:
        owners = list(found.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.binary()),
             *(pa.array([[o[j] for o in own] for own in owners], pa.list_(pa.int64())) for j in range(3))],
            names=["hash", "segment", "doc_ids", "digests", "starts"])

    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            keys = batch.column("key").to_pylist()
            lists = batch.column("hashes")
            flat = lists.values.to_numpy()
            bounds = lists.offsets.to_numpy()
            wanted_row = np.repeat(np.arange(len(keys)), np.diff(bounds))
            order = np.lexsort((flat[bounds[0]:bounds[-1]], wanted_row))
            flat, wanted_row = flat[bounds[0]:bounds[-1]][order], wanted_row[order]
            cut = np.searchsorted(wanted_row, np.arange(len(keys) + 1))
            digests: dict[int, int] = {}
            found: dict[tuple[int, bytes], list] = {}
            held = 0
            for row, code, first, last in ranges(data, offsets):
                for r in np.unique(row).tolist():
                    own = np.arange(*np.searchsorted(row, [r, r + 1]))
                    known = flat[cut[r]:cut[r + 1]]
                    at = np.minimum(np.searchsorted(known, code[own]), len(known) - 1)
                    own = own[known[at] == code[own]]
                    if not len(own):
                        continue
                    begin = int(offsets[r])
                    if r not in digests:
                        digests[r] = _digest(data[begin:offsets[r + 1]])
                    for c, x, y in zip(code[own].tolist(), first[own].tolist(), last[own].tolist()):
                        found.setdefault((c, bytes(data[begin + x:begin + y + SIZE])), []).append((keys[r], digests[r], x))
                        held += y - x + SIZE
                if held >= HELD_BYTES:
                    yield sent(found)
                    found, held = {}, 0
            yield sent(found)
    return met.mapInArrow(tidy(run), SEGMENT)


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true flags."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Shard:
    """Distinct segments of some anchors in a file, suffix-sorted when enough have come; gives back ranges of starts.

    An anchor needs the sort only if a segment of it stands at one place and has other segments to be compared with.
    """

    def __init__(self):
        self.disk = Disk()
        self.text = open(self.disk.path(), "w+b")
        self.owner = open(self.disk.path(), "w+b")
        self.size, self.ends, self.counts = 0, [], []
        self.begin = (0, 0, 0)  # of the open anchor: segments, bytes and owners before it
        self.out, self.held = [[], [], [], []], 0

    def add(self, code: int, segment: bytes, owners: np.ndarray, new: bool):
        """``owners``: rows of key, digest and start; ``new``: not the segment of the call before."""
        if new:
            self.text.write(segment)
            self.text.write(b"\0")
            self.size += len(segment) + 1
            self.ends.append(self.size)
            self.counts.append(0)
        self.counts[-1] += len(owners)
        self.owner.write(owners.tobytes())

    def _give(self, own: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Owners with the first and the end of their repeated starts in the segment."""
        for column, values in zip(self.out, (own[:, 0], own[:, 1], own[:, 2] + x, own[:, 2] + y - 1 + SIZE)):
            column.append(values)
        self.held += len(own)

    def _owners(self, first: int) -> np.ndarray:
        """All owners from ``first`` on."""
        self.owner.flush()
        self.owner.seek(first * 24)
        rows = np.frombuffer(self.owner.read(), np.int64).reshape(-1, 3)
        self.owner.seek(0, 2)
        return rows

    def _lengths(self, lo: int) -> np.ndarray:
        return np.diff(np.array([self.ends[lo - 1] if lo else 0, *self.ends[lo:]])) - 1

    def close_group(self) -> None:
        """At the end of an anchor: what stands at several places repeats; drop the anchor's text if that is all."""
        lo, size, owners = self.begin
        counts = self.counts[lo:]
        if len(counts) == 1 or min(counts, default=2) > 1:
            if min(counts, default=0) > 1:
                self._give(self._owners(owners), np.int64(0), np.repeat(self._lengths(lo) - SIZE + 1, counts))
            del self.ends[lo:], self.counts[lo:]
            self.size = size
            for file, end in ((self.text, size), (self.owner, owners * 24)):
                file.flush()
                file.seek(end)
                file.truncate()
        self.begin = (len(self.ends), self.size, self.owner.tell() // 24)

    def sort(self) -> None:
        """Suffix-sort what has come."""
        if not self.ends:
            return
        self.text.flush()
        work = Disk()
        try:
            letters = work.array(self.size + 1, np.int16)  # 0 ends the shard, 1 ends a segment, bytes follow
            source = np.memmap(self.text.name, np.uint8, "r", shape=(self.size,))
            for a in range(0, self.size, PIECE):
                letters[a:min(a + PIECE, self.size)] = source[a:a + PIECE].astype(np.int16) + 2
            ends = np.array(self.ends)
            letters[ends - 1] = 1
            flags = repeated(letters, SIZE, work)
            counts, lengths = np.array(self.counts), self._lengths(0)
            begins, starts = ends - 1 - lengths, lengths - SIZE + 1  # a segment's windows
            change = np.zeros(len(flags) + 1, np.int32)  # +2 inside windows, +3 if the segment stands at several places
            np.add.at(change, begins, np.where(counts > 1, 3, 2))
            np.add.at(change, begins + starts, -np.where(counts > 1, 3, 2))
            inside = np.cumsum(change)[:len(flags)]
            first, end = _spans((inside == 3) | (inside == 2) & flags)
            segment = np.searchsorted(begins, first, "right") - 1
            times = counts[segment]
            at = np.cumsum(counts) - counts
            row = np.repeat(at[segment] - np.cumsum(times) + times, times) + np.arange(times.sum())
            if len(row):
                self._give(self._owners(0)[row], np.repeat(first - begins[segment], times), np.repeat(end - begins[segment], times))
        finally:
            work.close()
        self.ends, self.counts, self.size, self.begin = [], [], 0, (0, 0, 0)
        for file in (self.text, self.owner):
            file.seek(0)
            file.truncate()

    def taken(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in self.out], names=["key", "digest", "begin", "end"])
        self.out, self.held = [[], [], [], []], 0
        return batch

    def close(self) -> None:
        self.text.close()
        self.owner.close()
        self.disk.close()


def _sorted_shard(segments: DataFrame) -> DataFrame:
    """Ranges of repeated starts wherever a segment stands."""
    def run(batches):
        shard, last = Shard(), None
        try:
            for batch in batches:
                for code, segment, ids, digests, starts in zip(*[c.to_pylist() for c in batch.columns]):
                    if last is not None and code != last[0]:
                        shard.close_group()
                        if shard.size >= SHARD_BYTES:
                            shard.sort()
                        if shard.held > 100_000:
                            yield shard.taken()
                    shard.add(code, segment, np.array([ids, digests, starts], np.int64).T, (code, segment) != last)
                    last = (code, segment)
            shard.close_group()
            shard.sort()
            if shard.held:
                yield shard.taken()
        finally:
            shard.close()
    ordered = segments.repartition("hash").sortWithinPartitions("hash", "segment")
    return ordered.mapInArrow(tidy(run), "key long, digest long, begin long, end long")


def found(rows: DataFrame) -> DataFrame:
    """``key`` and ``spans``: for each text (id and digest) the byte ranges covered by repeated strings."""
    anchors = written(_anchors(rows.select("key", "text")))
    often = anchors.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    lists = anchors.join(often, "hash").groupBy("key").agg(F.collect_set("hash").alias("hashes"))
    met = rows.select("key", "text").join(lists, "key")
    ranges_found = _sorted_shard(_segments(met))
    gathered = ranges_found.groupBy("key").agg(F.collect_list(F.struct("digest", "begin", "end")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                own = []
                for digest in {x["digest"] for x in spans}:
                    own += [{"digest": digest, "begin": x, "end": y} for x, y in _union(spans, digest).tolist()]
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, batch.schema.field("spans").type)], names=["key", "spans"])
    return written(gathered.mapInArrow(tidy(run), gathered.schema))


def _union(spans, digest: int) -> np.ndarray:
    """Disjoint ascending ranges of the text with this digest."""
    pairs = np.array(sorted({(s["begin"], s["end"]) for s in spans if s["digest"] == digest}), np.int64).reshape(-1, 2)
    if not len(pairs):
        return pairs
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.append(True, pairs[1:, 0] > reach[:-1])  # touching ranges are one run
    first = np.flatnonzero(new)
    return np.stack([pairs[first, 0], reach[np.append(first[1:], len(pairs)) - 1]], 1)


def _with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of their id as a last column; rows without an id share the key of the least number."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    spans = found(rows)
    size = spans.agg(F.sum(F.size("spans")).alias("n")).first()["n"] or 0
    side = F.broadcast(spans) if size <= MOST_BROADCAST else spans
    free = "_" * (1 + max(len(c) for c in docs.columns))  # longer than any name there is
    own, other, found_spans = free, free + "k", free + "s"
    renamed = side.select(F.col("key").alias(other), F.col("spans").alias(found_spans))
    return docs.withColumn(own, key).join(renamed, F.col(own) == F.col(other), "left").select(*docs.columns, found_spans)


def digests(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what stays, of every text."""
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                cut = _union(spans or [], _digest(data))
                kept = b"".join(data[a:b] for a, b in zip([0, *cut[:, 1].tolist()], [*cut[:, 0].tolist(), len(data)]))
                for c, v in zip(out, (len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(
                out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return _with_spans(texts(docs)).mapInArrow(
        tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings cut out of their texts; other columns as they are, null texts stay null.

    A cut inside a character drops the whole character, so that texts stay valid.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches):
        at = names.index("text")
        for batch in batches:
            texts_out = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if spans and text:
                    data = text.encode()
                    cut = _union(spans, _digest(data))
                    text = b"".join(data[a:b] for a, b in zip([0, *cut[:, 1].tolist()], [*cut[:, 0].tolist(), len(data)])).decode(errors="ignore")
                texts_out.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts_out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return _with_spans(docs).mapInArrow(tidy(run), schema)
