"""Byte-level BPE: encode and decode.

Pre-tokenisation runs without a regular expression.  Every code point has a class; a class (with at most two characters
of look-ahead) is a transition function on eight states, and function composition is associative.  Blocks of 64
characters are composed side by side, block functions are combined by doubling, and a replay from the known start states
marks the boundaries.  The slices between boundaries go through a cache of merged pieces.

Letters and numbers are those of Unicode 16.0, the version of the tokenizer libraries.  Null and empty texts give no ids; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import groups, raw, texts, tidy

RANK_FILE = "byte_bpe_50k.tiktoken"
NEVER = 1 << 40
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX_LOW, MIX_HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# fixed values: the Unicode property White_Space
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
# fixed values: letters and numbers that Unicode 16.0 added to 15.1, first and last code point
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
KNOWN_UNICODE = ("15.1.0", "16.0.0")

# symbols: a letter, a number, another character, an apostrophe before a one- or two-letter ending, a space or another
# white character before a visible one, a white character before white or the end
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, LINE, WHITES = range(8)
# states: nothing open, letters, numbers, others, white run, prefix space, one or two letters of an ending to come
DONE, LETTERS, NUMBERS, OTHERS, RUN, PREFIX, ONE, TWO = range(8)
WIDTH = 64


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point by Unicode 16.0, whatever of the known versions this Python has."""
    if unicodedata.unidata_version not in KNOWN_UNICODE:
        raise RuntimeError(f"character classes are known for Unicode {KNOWN_UNICODE}, not {unicodedata.unidata_version}")
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for low, high in ranges:
            table[low:high + 1] = kind
    table[WHITE] = LINE
    table[32] = SPACE
    return table


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary flag by 8 * symbol + state; symbols from 8 on open a document and forget the state."""
    def step(symbol: int, state: int) -> tuple[int, bool]:
        if symbol == LETTER:
            if state in (ONE, TWO):
                return (DONE if state == ONE else ONE), False
            return LETTERS, state not in (LETTERS, PREFIX)
        if symbol == NUMBER:
            return NUMBERS, state not in (NUMBERS, PREFIX)
        if symbol in (OTHER, SHORT, LONG):
            joined = state in (OTHERS, PREFIX)
            return (OTHERS if joined or symbol == OTHER else ONE if symbol == SHORT else TWO), not joined
        if symbol == WHITES:
            return RUN, state != RUN
        return (PREFIX if symbol == SPACE else DONE), True
    steps = [step(k, s) for k in range(8) for s in range(8)] + [step(k, DONE) for k in range(8) for _ in range(8)]
    return np.array([x[0] for x in steps], np.uint8), np.array([x[1] for x in steps])


def _symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``first``: indices at which a document begins."""
    symbol = _classes()[points]
    last = np.zeros(len(points) + 2, bool)
    last[first[first > 0] - 1] = True
    last[len(points) - 1:] = True
    white = symbol >= SPACE
    follows = np.append(white[1:], True) | last[:len(points)]
    symbol[white & follows] = WHITES
    at = np.flatnonzero(points == 39)
    at = at[~last[at]]
    if len(at):
        padded = np.append(points, [0, 0]).astype(np.uint32)
        one = padded[at + 1]
        two = np.where(last[at + 1], 0, padded[at + 2])
        symbol[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[at[pair]] = LONG
    symbol[first] += 8
    return symbol


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the code points at which a piece begins."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    following, opens = _automaton()
    rows = -(-n // WIDTH)
    symbol = np.full(rows * WIDTH, WHITES, np.int64)
    symbol[:n] = _symbols(points, first)
    columns = np.ascontiguousarray(symbol.reshape(rows, WIDTH).T) * 8
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(WIDTH):
        function = following.take(columns[j][:, None] + function)
    reach = 1
    while reach < rows:  # after each round a row holds the composition of twice as many blocks
        function[reach:] = np.take_along_axis(function[reach:], function[:-reach].astype(np.int64), 1)
        reach *= 2
    state = np.concatenate([[DONE], function[:-1, DONE]]).astype(np.uint8)
    marks = np.empty((WIDTH, rows), bool)
    for j in range(WIDTH):
        at = columns[j] + state
        marks[j] = opens.take(at)
        state = following.take(at)
    return np.flatnonzero(marks.T.reshape(-1)[:n])


class Codec:
    """Ranks of one vocabulary with bounded caches of merged pieces.

    Pieces of up to 15 bytes are two 64-bit words; a direct-mapped table takes these words to the place of their ids in a
    pool.  What the table does not hold is merged, all new pieces of one length together, and takes its slot.
    """

    SLOT_BITS = 19
    MOST_POOLED = 2 << 20

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.digits = [b"%d" % i for i in range(len(self.tokens))]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self._forget()

    def _forget(self) -> None:
        n = 1 << self.SLOT_BITS
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.place = np.zeros(n, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Append ids to the pool; where they begin."""
        at = self.filled
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[at:at + len(ids)] = ids
        self.filled = at + len(ids)
        return at

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def merge_equal(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many pieces of one length, given as a matrix of bytes: flat ids in row order, and ids per row."""
        ids = self.single[rows]
        count = np.zeros(len(rows), np.int64)
        out = np.zeros(rows.shape, np.int64)
        live = np.arange(len(rows))
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while True:
            width = ids.shape[1]
            if width > 1:
                j = rank.argmin(1)
                least = rank[np.arange(len(rank)), j]
                ended = least == NEVER
            else:
                ended = np.ones(len(ids), bool)
            out[live[ended], :width] = ids[ended]
            count[live[ended]] = width
            if ended.all():
                break
            live, ids, rank, j, least = live[~ended], ids[~ended], rank[~ended], j[~ended], least[~ended]
            at = np.arange(len(live))
            ids[at, j] = least
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > j[:, None]), 1)
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= j[:, None]), 1)
            for k in (j - 1, j):
                touched = (k >= 0) & (k < width - 2)
                r, c = at[touched], k[touched]
                rank[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        return out[np.arange(rows.shape[1]) < count[:, None]], count

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one piece of any length: a heap of pairs over a linked list."""
        ranks, parts = self.ranks, [piece[i:i + 1] for i in range(len(piece))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([ranks[p] for p in parts if p], np.uint32)

    def _places(self, block: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the ids of each piece are in the pool, times 2**24, plus their number."""
        if self.filled > self.MOST_POOLED:
            self._forget()
        padded = np.frombuffer(block + bytes(16), np.uint8)
        words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(block) + 8,), (1,))
        low = words[starts] & LOW_BYTES[np.minimum(sizes, 8)]
        high = words[np.minimum(starts + 8, len(block))] & LOW_BYTES[np.clip(sizes - 8, 0, 7)] \
            | (np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56))
        slot = ((low ^ (high * MIX_HIGH)) * MIX_LOW >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        place = self.place[slot]
        missed = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high) | (sizes > 15))
        if not len(missed):
            return place
        order = missed[np.lexsort((low[missed], high[missed]))]  # the length is the top byte of ``high``
        new = np.ones(len(order), bool)
        new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]) | (sizes[order[1:]] > 15)
        one = order[new]
        found = np.zeros(len(one), np.int64)
        length = sizes[one]
        cuts = np.flatnonzero(np.diff(length, prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            n = int(length[a])
            if n <= 15:
                flat, count = self.merge_equal(padded[starts[one[a:b], None] + np.arange(n)])
                found[a:b] = (self._keep(flat) + np.cumsum(count) - count << 24) + count
        for i in np.flatnonzero(length > 15).tolist():
            at = int(starts[one[i]])
            ids = self.merge_long(block[at:at + int(length[i])])
            found[i] = (self._keep(ids) << 24) + len(ids)
        place[order] = found[np.cumsum(new) - 1]
        short = one[length <= 15]
        self.low[slot[short]], self.high[slot[short]], self.place[slot[short]] = low[short], high[short], place[short]
        return place

    def encode(self, data: memoryview, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each row."""
        for lo, hi in groups(offsets):
            block = bytes(data[offsets[lo]:offsets[hi]])
            edges = offsets[lo:hi + 1] - offsets[lo]
            lead = np.flatnonzero(np.frombuffer(block, np.int8) >= -64)
            points = np.frombuffer(block.decode("utf-8").encode("utf-32-le"), np.uint32)
            first = np.searchsorted(lead, edges)
            starts = lead[boundaries(points, np.unique(first[:-1][edges[:-1] < edges[1:]]))]
            if not len(starts):
                yield from (np.zeros(0, np.uint32) for _ in range(lo, hi))
                continue
            place = self._places(block, starts, np.diff(starts, append=len(block)))
            count = place & 0xFFFFFF
            ends = np.cumsum(count)
            ids = self.pool[np.arange(ends[-1]) + np.repeat((place >> 24) - ends + count, count)]
            cut = np.append(0, ends)[np.searchsorted(starts, edges)].tolist()
            for a, b in zip(cut, cut[1:]):
                yield ids[a:b]

    def sizes(self) -> np.ndarray:
        return np.array([len(t) for t in self.tokens], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``ends``: the ids of each whole text and the byte offset at which each token ends."""
    path = path or public_tokenizers.path(RANK_FILE)

    def run(batches):
        own = codec(path)
        sizes = own.sizes()
        for batch in batches:
            ids = list(own.encode(*raw(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([np.cumsum(sizes[x]) for x in ids], pa.list_(pa.int64()))], names=["doc_id", "ids", "ends"])
    return texts(docs).mapInArrow(tidy(run), "doc_id long, ids array<int>, ends array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the decoded ``bytes`` of the column ``ids``."""
    path = path or public_tokenizers.path(RANK_FILE)

    def run(batches):
        own = codec(path)
        for batch in batches:
            out = [own.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both."""
    path = path or public_tokenizers.path(RANK_FILE)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        own = codec(path)
        for batch in batches:
            counts, written, decoded = [], [], []
            for ids in own.encode(*raw(batch.column("text"))):
                listed = ids.tolist()
                counts.append(len(listed))
                written.append(sha(b" ".join(map(own.digits.__getitem__, listed))))
                decoded.append(sha(own.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(written, pa.string()),
                 pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return texts(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
