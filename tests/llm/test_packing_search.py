"""Packing: no step is left, large shards end soon; character classes as in the tokenizer libraries."""

import random
import time
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crossrisk.llm import byte_bpe, packing
from crossrisk.llm.arrow import raw


def steps_left(bins, sizes, capacity):
    """A move or exchange from a bin into one at least as full, by trying all."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    for a, low in enumerate(bins):
        for b, high in enumerate(bins):
            if a == b or fill[b] < fill[a] or fill[b] == capacity or fill[a] == capacity:
                continue
            given = [sizes[i] for i in low] + [sizes[i] + sizes[j] for n, i in enumerate(low) for j in low[n + 1:]]
            if any(sizes[i] <= capacity - fill[b] for i in low) or any(0 < g - sizes[k] <= capacity - fill[b] for g in given for k in high):
                return a, b
    return None


def test_no_step_is_left():
    rng = random.Random(4)
    for _ in range(300):
        low, high = rng.choice([(1, 1000), (100, 500), (250, 600), (300, 360), (2, 40)])
        sizes = [rng.randrange(low, high) for _ in range(rng.randrange(30, 151))]
        bins = packing.pack_list(sizes, 1024)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 1024))
        assert len(bins) == -(-sum(sizes) // 1024) or steps_left(bins, sizes, 1024) is None


def test_a_shard_of_pieces_that_never_pair_ends_soon():
    rng = random.Random(1)
    began = time.time()
    assert len(packing.pack_list([rng.randrange(513, 901) for _ in range(packing.SHARD_ITEMS)])) == packing.SHARD_ITEMS
    assert time.time() - began < 20


def test_loose_pieces_are_dealt_in_shards_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)
    seen = []
    plain = packing._packed
    monkeypatch.setattr(packing, "_packed", lambda items, shards, capacity, level: seen.append((items.count(), shards)) or plain(items, shards, capacity, level))
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(["word"] * rng.randrange(1, 120))) for i in range(400)], "doc_id long, text string")
    got = packing.pack(docs, capacity=128).collect()
    assert len(got) == 400 and all(items <= 40 * shards for items, shards in seen) and len(seen) > 1
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= 128


@pytest.mark.parametrize("lead", ["a", "1", "!", " "])
def test_classes_of_all_code_points_are_those_of_the_library(lead):
    """After a letter, a number, a sign and a space: one piece or two, shown by tokens that join ``lead`` with a first byte."""
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {lead.encode() + bytes([b]): 256 + n for n, b in enumerate(range(0xC2, 0xF5))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = np.array([c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    together = np.array([len(library.encode_ordinary(lead + chr(c))) == len(chr(c).encode()) for c in points.tolist()])
    both = np.column_stack([np.full(len(points), ord(lead), np.uint32), points]).ravel()
    begins = byte_bpe.boundaries(both, np.arange(0, len(both), 2))
    assert ((np.bincount(begins // 2, minlength=len(points)) == 1) == together).all()


def test_ids_of_new_letters_are_those_of_both_libraries():
    listed = ["Ɤ's", "xᲉ're ok", "a\U00013460'll", " \U00016d70\U00016d711 \U0001e5f0x", "éꟚꟜ 1\U00010d40"]
    column = pa.array(listed, pa.string())
    own = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANK_FILE))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER_FILE))
    ranks = own.ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [x.tolist() for x in own.encode(*raw(column))]
    assert got == [library.encode_ordinary(s) for s in listed] == [tokenizer.encode(s, add_special_tokens=False).ids for s in listed]


def test_an_unknown_unicode_version_is_an_error(monkeypatch):
    monkeypatch.setattr(unicodedata, "unidata_version", "13.0.0")
    with pytest.raises(RuntimeError):
        byte_bpe._classes.__wrapped__()
