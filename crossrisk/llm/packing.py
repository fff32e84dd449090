"""Best-fit packing with a swap-based local search.

Whole texts become token ids and an end id; only longer documents are cut, into full pieces after a shorter first one.  A
full piece is a sequence of its own.  Ids are those of the tokenizer file: its added tokens are cut out of a text first, and
what stands between two of them is encoded like a text of its own.  The other pieces are dealt at random into shards of some ten thousand, so no key is
hot; a shard is packed by best fit decreasing and improved by local search; pieces of bins that stay loose are dealt anew into
shards of the same size and packed again, until a round saves less than a thousandth of their sequences.

The local search takes the bins from the emptiest on and moves their documents, or exchanges one of them for a smaller one, or
two of them for a smaller one, with bins at least as full, until no bin has such a step.  Every step shifts tokens from an emptier to a fuller bin, so the sum of squared
fills grows; a bin that has become empty disappears.

Null and empty texts are the end id alone.  Repeated rows are packed once each.  Equal lengths are taken in any order.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .arrow import raw, texts, tidy
from .byte_bpe import RANK_FILE, Codec, codec

CAPACITY = 1024
END = 2
TOKENIZER_FILE = "byte_bpe_50k.json"
SHARD_ITEMS = 20_000
LOOSE = 16
SAVED = 1000
ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"


def added_tokens(path: str) -> dict[bytes, int]:
    """Ids of the tokens that a tokenizer file declares besides its vocabulary."""
    with open(path, encoding="utf-8") as file:
        listed = json.load(file).get("added_tokens") or []
    for token in listed:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r}: only exact matches are supported")
    return {token["content"].encode(): token["id"] for token in listed}


def encode_with(own: Codec, added: dict[bytes, int], data: memoryview, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of each row; added tokens, leftmost and then longest first, stand for themselves."""
    if not added:
        yield from own.encode(data, offsets)
        return
    find = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))).finditer
    edges, marks, parts = [int(offsets[0])], [], []  # parts of all rows, the id of each or None, and how many a row has
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        before = len(marks)
        for match in find(data, a, b):
            edges += match.span()
            marks += [None, added[match.group()]]
        edges.append(b)
        marks.append(None)
        parts.append(len(marks) - before)
    encoded = zip(own.encode(data, np.array(edges, np.int64)), marks)
    for n in parts:
        ids = [ids if mark is None else np.array([mark], np.uint32) for ids, mark in islice(encoded, n)]
        yield ids[0] if n == 1 else np.concatenate(ids)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """One row per piece, with the CRC-32 of its ids as little-endian 32-bit numbers."""
    path = path or public_tokenizers.path(RANK_FILE)
    added = added_tokens(public_tokenizers.path(TOKENIZER_FILE))

    def run(batches):
        own, last = codec(path), np.array([end], np.uint32)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode_with(own, added, *raw(batch.column("text")))):
                ids = np.concatenate([ids, last])
                start, piece = 0, 0
                while start < len(ids):
                    size = (len(ids) - start) % capacity or capacity
                    rows.append((doc, piece, start, size, zlib.crc32(ids[start:start + size].tobytes())))
                    start, piece = start + size, piece + 1
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return texts(docs).mapInArrow(tidy(run), ITEM)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, into the bin whose space it fills best."""
    by_space: dict[int, list[int]] = defaultdict(list)
    spaces, bins = 0, []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            own = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, own = capacity, len(bins)
            bins.append([])
        bins[own].append(item)
        if space > size:
            by_space[space - size].append(own)
            spaces |= 1 << space - size
    return bins


class Search:
    """Bins with, for each size of piece, the bins that hold it and have space left; and the open bins by space."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.by_fill: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.holds: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # size -> space -> bins
        for k in range(len(bins)):
            self._list(k)

    def _list(self, k: int) -> None:
        if 0 < self.fill[k] < self.capacity:
            self.by_fill[self.fill[k]].add(k)
            for i in self.bins[k]:
                self.holds[self.sizes[i]][self.capacity - self.fill[k]].add(k)

    def _unlist(self, k: int) -> None:
        if 0 < self.fill[k] < self.capacity:
            self.by_fill[self.fill[k]].discard(k)
            space = self.capacity - self.fill[k]
            for size in {self.sizes[i] for i in self.bins[k]}:
                own = self.holds[size]
                own[space].discard(k)
                if not own[space]:
                    del own[space]
                    if not own:
                        del self.holds[size]

    def _change(self, k: int, out: list[int], into: list[int]) -> None:
        self._unlist(k)
        self.bins[k] = [i for i in self.bins[k] if i not in out] + into
        self.fill[k] += sum(self.sizes[i] for i in into) - sum(self.sizes[i] for i in out)
        self._list(k)

    def _holder(self, low: int, size: int) -> tuple[int, int] | None:
        """For ``size`` tokens out of bin ``low``: the largest smaller piece of another bin, at least as full, with the space for the difference; and that bin."""
        for back in range(size - 1, 0, -1):
            own = self.holds.get(back)
            if own is None:
                continue
            for space, bins in own.items():
                if size - back <= space <= self.capacity - self.fill[low]:
                    for k in bins:
                        if k != low:
                            return back, k
        return None

    def _step(self, low: int) -> bool:
        """One move or exchange out of bin ``low`` into a bin at least as full."""
        items = sorted(self.bins[low], key=lambda i: -self.sizes[i])
        for i in {self.sizes[i]: i for i in items}.values():
            for fill in range(self.capacity - self.sizes[i], self.fill[low] - 1, -1):
                k = next((k for k in self.by_fill[fill] if k != low), None)
                if k is not None:
                    self._change(low, [i], [])
                    self._change(k, [], [i])
                    return True
        one = {self.sizes[i]: [i] for i in items}
        two = {self.sizes[i] + self.sizes[j]: [i, j] for n, i in enumerate(items) for j in items[n + 1:]}
        for groups in (one, two):
            for size in sorted(groups, reverse=True):
                found = self._holder(low, size)
                if found:
                    given, (size_back, k) = groups[size], found
                    back = next(i for i in self.bins[k] if self.sizes[i] == size_back)
                    self._change(low, given, [back])
                    self._change(k, [back], given)
                    return True
        return False

    def run(self) -> list[list[int]]:
        """Rounds over the open bins, the emptiest first, each giving away what it can; the last round finds no step at all."""
        need = -(-sum(self.fill) // self.capacity)
        used = sum(1 for b in self.bins if b)
        moved = True
        while moved and used > need:
            moved = False
            for low in [k for own in self.by_fill for k in sorted(own)]:
                while used > need and 0 < self.fill[low] < self.capacity and self._step(low):
                    moved = True
                    used -= not self.bins[low]
        return [b for b in self.bins if b]


def pack_list(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers after best fit and local search."""
    return Search(best_fit(sizes, capacity), sizes, capacity).run()


def _packed(items: DataFrame, shards: int, capacity: int, level: int) -> DataFrame:
    """Items in ``shards`` groups, each packed; sequence ids are unique over groups and levels."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["length"].tolist()
        shard = int(pdf["shard"].iloc[0])
        order, sequence, offset, space = [], [], [], []
        for n, members in enumerate(pack_list(sizes, capacity)):
            at = 0
            fill = sum(sizes[i] for i in members)
            for i in members:
                order.append(i)
                sequence.append((level << 56) + (shard << 24) + n)
                offset.append(at)
                space.append(capacity - fill)
                at += sizes[i]
        out = pdf.iloc[order][["doc_id", "piece", "start", "length", "ids_crc32"]]
        return out.assign(sequence_id=sequence, offset=offset, space=space)
    key = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(shards)).alias("shard")
    return (items.select(*[c.split()[0] for c in ITEM.split(", ")], key).groupBy("shard")
            .applyInPandas(run, f"{ITEM}, sequence_id long, offset long, space long"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: the place of every piece."""
    cut = cut_lineage(pieces(docs, capacity, end, path))
    own = F.lit(-1) - F.monotonically_increasing_id()
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": own, "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < capacity)
    shards, level = max(1, -(-rest.count() // SHARD_ITEMS)), 1
    done, loose, before = [full], rest, None
    while True:
        now = cut_lineage(_packed(loose, shards, capacity, level))
        done.append(now.where(F.col("space") < LOOSE).drop("space"))
        loose = now.where(F.col("space") >= LOOSE)
        items, sequences = loose.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        saved = None if before is None else before - now.where("offset = 0").count()
        if shards == 1 or not items or saved is not None and saved * SAVED < before:
            return reduce(DataFrame.unionByName, [*done, loose.drop("space")])
        shards, level, before = -(-items // SHARD_ITEMS), level + 1, sequences
