"""Every operator on awkward rows, and against brute force on a small table."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crossrisk.llm import (byte_bpe, chat, graph, hmm, induced, jaccard, licenses, order_minhash, packing, quality, queries,
                           suffix_dedup, toxicity)

SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, score double, key string, part int, copy int, next string, component string, "
          "__own long, quality string, row long, `first` int")


def rows_of():
    long_text = "word and the " * 40_000
    passage = " ".join(f"passage{i} of the text" for i in range(30))
    base = " ".join(f"token{i}" for i in range(120))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "mit license"), (5, "mit license"), (6, long_text),
        (7, base + " the and"), (8, base.replace("token50", "other") + " the and"), (9, base + " the and"),
        (10, "first part " + passage + " end of it"), (11, "another begin " + passage + " and a tail"),
        (12, "é" * 500), (13, "a" * 700), (14, "x\x00y \x85   don't we'LL 'tis's  \n\n 12é34"), (None, "no id here"),
        (None, None), (15, "You idiot fool of the " * 20), (16, "#$%& " * 80 + "the and"), (17, "line of the\n" * 60),
    ]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, empty, blank, very long, repeated and tied rows, and columns with names that operators use."""
    data = [(i, t, "en", 1.0, "k", 3, 1, "n", "c", 5, "q", 9, 2) for i, t in rows_of()]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(15, 0, 1), (7, 1, 0), (9, 1, 0), (8, 1, 0), (8, 1, None), (None, 1, 1), (99, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def texts_of():
    return [(i, t or "") for i, t in rows_of()]


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_bpe_round_trip_on_awkward_rows(awkward):
    got = collected(byte_bpe.digests(awkward), "doc_id", "decoded_sha256")
    assert got == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts_of()), key=str)
    back = byte_bpe.decode(byte_bpe.encode(awkward))
    assert sorted((bytes(r["bytes"]) for r in back.collect())) == sorted(t.encode() for _, t in texts_of())


def test_bpe_equals_the_tokenizer_library():
    import base64

    import pyarrow as pa
    import public_tokenizers
    import tiktoken
    from crossrisk.llm.arrow import raw
    path = public_tokenizers.path(byte_bpe.RANK_FILE)
    own = byte_bpe.Codec(path)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    letters = list("ab'strevlmd  \n\t1²é!?.…　\xa0中𝒳\x1c\x85​'''")
    cases = ["".join(random.choices(letters, k=random.randint(0, 90))) for _ in range(1500)]
    cases += ["".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 64)]
    cases += ["", "a" * 3000, " " * 70, "\n'", *(t for _, t in texts_of())]
    for case, ids in zip(cases, own.encode(*raw(pa.array(cases)))):
        assert ids.tolist() == other.encode_ordinary(case)


def test_pieces_and_packing(awkward, empty):
    got = packing.pack(awkward).collect()
    whole = defaultdict(list)
    for r in got:
        whole[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in whole.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    tokens = {r["doc_id"]: r["n_tokens"] for r in byte_bpe.digests(awkward).collect() if r["doc_id"] not in (None, 5)}
    sums = Counter()
    for r in got:
        sums[r["doc_id"]] += r["length"]
    assert all(sums[i] == n + 1 for i, n in tokens.items())
    assert len(whole) <= math.ceil(sum(r["length"] for r in got) / packing.CAPACITY) + 1
    assert packing.pack(empty).count() == 0


def test_local_search_improves_best_fit():
    sizes = [6, 6, 5, 5, 4, 4, 3, 3, 2, 2]
    random.seed(1)
    for _ in range(200):
        sizes = [random.randint(1, 10) for _ in range(30)]
        first, last = packing.best_fit(sizes, 10), packing.pack_list(sizes, 10)
        assert sorted(i for b in last for i in b) == list(range(30))
        assert all(sum(sizes[i] for i in b) <= 10 for b in last)
        assert math.ceil(sum(sizes) / 10) <= len(last) <= len(first)


def test_packing_uses_the_ids_of_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = defaultdict(list)
    for r in packing.pieces(docs).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for doc in docs.select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(got[doc["doc_id"]])):
            assert (piece, start) == (k, at) and (k == 0 or length == 1024)
            assert crc == zlib.crc32(ids[at:at + length].tobytes())
            at += length
        assert at == len(ids)


def test_packing_keeps_the_added_tokens_of_the_tokenizer_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    cases = [f"a{mark}b", mark, mark * 3, f"{mark} a  ", f"a  {mark}  b", f"don{mark}'t é{mark}", "<|endof", "text|>", "<|endoftext|", "", None,
             f"<{mark}>", mark.upper(), f"word and the {mark}\n" * 700, "plain"]
    random.seed(4)
    cases += ["".join(random.choices([mark, mark, *mark, "ab", " ", "\n", "中", "'s"], k=random.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").coalesce(2)
    got = defaultdict(list)
    for r in packing.pieces(docs).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for doc, text in enumerate(cases):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(got[doc])):
            assert (piece, start) == (k, at) and (k == 0 or length == 1024)
            assert crc == zlib.crc32(ids[at:at + length].tobytes()), text
            at += length
        assert at == len(ids)


def test_quality_on_awkward_rows(awkward, empty):
    got = quality.measured(awkward).select("doc_id", "text", "score", "quality.*").collect()
    for r in got:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", r["text"] or "") if w]
        windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert r["measures"]["n_words"] == len(words) and r["measures"]["n_repeat_words"] == len(covered)
        assert r["measures"]["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["kept"] == (not r["failed"]) and r["score"] == 1.0
    assert quality.keep(awkward).columns == awkward.columns
    assert quality.measured(empty).count() == 0 and quality.keep(empty).count() == 0


def test_licenses_on_awkward_rows(awkward, empty):
    got = {r["doc_id"]: r for r in licenses.scan(awkward).collect()}
    assert licenses.scan(awkward).count() == len(rows_of()) and licenses.scan(empty).count() == 0
    assert got[5]["n_base"] == 1 and got[5]["base_labels"] == "mit" and got[5]["score"] == 1.0
    assert got[1]["n_words"] == 0 and got[1]["labels"] == "" and got[1]["first_word"] is None


def test_license_notice_with_an_inserted_word(spark):
    text = "zz permission is hereby now granted free of charge to any person obtaining a copy of this software and associated documentation files"
    docs = spark.createDataFrame([(1, text), (2, "general public license general public license"), (3, "permission is granted")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert got[1]["labels"] == "mit-notice" and got[1]["n_base"] == 0 and got[1]["score"] >= licenses.COVER
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 3)
    assert got[3]["labels"] == ""


def _chain(words, notice):
    """Longest common forward chain of word pairs, by dynamic programming over all pairs of places."""
    pairs = list(zip(notice, notice[1:]))
    said = list(zip(words, words[1:]))
    best = [[0] * (len(pairs) + 1) for _ in range(len(said) + 1)]
    for i, a in enumerate(said):
        for j, b in enumerate(pairs):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + 1 if a == b else 0)
    return best[-1][-1] / len(pairs)


def test_license_spans_are_verified(spark):
    notice = "licensed under the gnu general public license version 3"
    long = " ".join(f"w{i}" for i in range(70))                              # a template of more than 63 pairs
    cases = {
        1: "licensed under the gnu affero general public license version 3",
        2: "licensed under cc 4 0 licensed under cc 4 0",
        3: notice, 4: "it is licensed under the gnu general public license version 3 now",
        5: "licensed under the gnu lesser general public license version 3",
        6: "licensed also under the gnu general public license version 3",
        7: "version 3 license public general gnu the under licensed",
        8: "licensed under cc by nc 4 0", 9: long, 10: long.replace("w40 ", ""), 11: " ".join(["licensed under the"] * 50),
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, notices=[*licenses.NOTICES, (long, "long")]).collect()}
    found = {i: set(filter(None, r["labels"].split(","))) for i, r in got.items()}
    assert found[1] == {"gpl"} and found[2] == set() and found[5] == {"gpl"} and found[7] == set() and found[11] == set()
    assert found[3] == found[4] == found[6] == {"gpl", "gpl-3.0"} and found[8] == {"cc-by-nc"}
    assert found[9] == {"long"} and got[9]["score"] == 1.0 and found[10] == {"long"}
    # the score is that of the chain where only one notice is near
    words = notice.split()
    only = {r["doc_id"]: r for r in licenses.scan(docs, phrases=[], notices=[(notice, "g")], cover=0.5).collect()}
    for i in (1, 3, 4, 5, 6):
        assert only[i]["score"] == pytest.approx(_chain(cases[i].split(), words)), i


def test_toxicity_on_awkward_rows(awkward, empty, labels):
    model = toxicity.train(awkward, labels, learn=False)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(awkward, model).collect()}
    assert got[15] > 0.5 and got[1] == got[2] < 0.5 and all(0 <= v <= 1 for v in got.values())
    kept = toxicity.keep(awkward, model)
    assert kept.columns == awkward.columns and kept.where("doc_id = 15").count() == 0 and kept.where("doc_id = 1").count() == 1
    nothing = toxicity.train(awkward, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(awkward, nothing).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES["op2_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    held = [(r["predicted"], r["toxic"]) for r in got.where("held_out").collect()]
    assert sum(p == t for p, t in held) >= 0.93 * len(held)
    assert sum(p for p, t in held if not t) <= 0.03 * len(held)


def test_fingerprints_on_awkward_rows(awkward, empty):
    got = order_minhash.fingerprints(awkward).collect()
    assert len(got) == len(rows_of()) and order_minhash.fingerprints(empty).count() == 0
    order = sorted(texts_of(), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        half, after = len(t) // 2, order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by_text = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            by_text[dict(texts_of())[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_sees_the_order_of_the_text(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    docs = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(words[:399] + ["end"]))], "a string, b string, c string")
    near = docs.select(order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b"))).alias("moved"),
                       order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("c"))).alias("edited")).first()
    assert near["edited"] > 0.9 > near["moved"]


def test_hmm_likelihood_is_exact():
    rng = np.random.default_rng(1)
    states, classes = 3, 7
    model = hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states),
                      rng.dirichlet(np.ones(classes), states).T)
    lengths = np.array([1, 5, 127, 128, 129, 700, 300])
    seen = rng.integers(0, classes, lengths.sum())
    at = 0
    for n, got in zip(lengths, hmm.likelihood(model, seen, lengths)):
        a, total = model.start * model.emit[seen[at]], 0.0
        for t in range(1, n):
            total, a = total + math.log(a.sum()), (a / a.sum()) @ model.moves * model.emit[seen[at + t]]
        assert abs(total + math.log(a.sum()) - got) < 1e-8
        at += n


def test_baum_welch_rounds_raise_the_likelihood():
    rng = np.random.default_rng(2)
    lengths = np.full(200, 50)
    seen = np.concatenate([rng.integers(0, 5, 50) + 5 * (i % 2) for i in range(200)])
    model, before = hmm.Model.first(np.full(10, 0.1), 2), -np.inf
    for _ in range(8):
        start, later, moves, emit, total = hmm.expected(model, seen, lengths)
        assert total >= before - 1e-6
        before = total
        even = lambda x: (x + 1e-9) / (x + 1e-9).sum(-1, keepdims=True)
        model = hmm.Model(even(start), model.later, even(moves), emit / emit.sum(0))


def test_hmm_scores_on_awkward_rows(awkward, empty):
    got = hmm.score(awkward, rounds=1).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = [(i, t.encode().lower().split() + [b" "]) for i, t in texts_of()]
    counts = Counter(w for i, ws in words if not held(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = [(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), total,
             round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws), 4)) for i, ws in words]
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got),
                  key=str) == sorted(want, key=str)
    assert all(r["score"] < 0 for r in got) and hmm.score(empty, rounds=1).count() == 0


def test_hmm_beats_the_unigram_on_held_out_texts(spark):
    got = queries.QUERIES["op5_hmm_score"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_chat_escapes_are_reversible():
    random.seed(5)
    for _ in range(500):
        turns = [("".join(random.choices("us[]\\", k=3)), "".join(random.choices("ab[]\\</s>\n", k=12))) for _ in range(4)]
        text = "".join(f"[{chat.escape(r)}]{chat.escape(t)}{chat.END}" for r, t in turns)
        assert [x[:2] for x in chat.parse(text)] == turns


def test_chat_windows(spark):
    rows = [(1, 0, "system", "be good"), *((1, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * 90) for k in range(1, 40)),
            (2, 0, "assistant", None), (2, 1, None, "</s>[INST]"), (2, 1, None, "</s>[INST]"), (3, 0, "user", "long " * 5000), (None, None, "user", "x")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, tokens string")
    made = chat.windows(table)
    for w in made.where("conv_id = 1").collect():
        assert w["tokens"] <= chat.BUDGET and w["text"].startswith("[system]be good</s>")
        assert w["window"] == 0 or w["repeated"] > 1
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    said = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] or 0, v[1] or 0)):
        said[c].append((r or "", x or ""))
    for c, turns in said.items():
        targets = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(targets))
        assert got[c]["loss_sha256"] == hashlib.sha256(targets.encode()).hexdigest()
    assert chat.digests(chat.windows(table.limit(0))).count() == 0


def test_chat_query_reads_back_every_conversation(spark):
    got = queries.QUERIES["op6_chat_windows"](spark, SMALL)
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert got.count() == table.select("conv_id").distinct().count() + 1
    assert got.agg(F.sum("n_turns")).first()[0] == table.count() + 2
    odd = got.where("conv_id = -7").first()
    assert odd["loss_chars"] == len("</s>[INST] ok [/INST]")


def brute_repeats(rows, size=suffix_dedup.SIZE):
    seen = Counter(t.encode()[p:p + size] for _, t in rows for p in range(len(t.encode()) - size + 1))
    out = []
    for i, t in rows:
        data = t.encode()
        covered, reach = bytearray(len(data)), 0
        for p in range(len(data) - size + 1):
            if seen[data[p:p + size]] > 1:
                for q in range(max(p, reach), p + size):
                    covered[q] = 1
                reach = p + size
        kept = bytes(c for c, f in zip(data, covered) if not f)
        runs = sum(1 for k in range(len(data)) if covered[k] and not (k and covered[k - 1]))
        out.append((i, len(data), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_induced_sort_finds_repeated_strings(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(150):
        size = int(rng.integers(2, 12))
        n, letters = max(int(rng.integers(1, 300)), size), int(rng.integers(1, 5))
        text = np.append(rng.integers(1, letters + 1, n), 0)
        if trial % 3 == 0 and n > 20:
            text[n // 2:n // 2 + n // 4] = text[:n // 4]
        monkeypatch.setattr(induced, "BLOCK", int(rng.integers(1, 50)))
        monkeypatch.setattr(induced, "DIRECT", int(rng.integers(4, 100)))
        disk = induced.Disk(int(rng.integers(1, 1000)))  # nearly everything goes through files
        try:
            flags = np.array(induced.repeated(text.astype(np.int16), size, disk))
        finally:
            disk.close()
        words = [tuple(text[i:i + size]) for i in range(len(text) - size + 1)]
        seen = Counter(words)
        assert flags[:len(words)].tolist() == [seen[w] > 1 for w in words]


def test_suffix_dedup_on_awkward_rows(awkward, empty):
    got = collected(suffix_dedup.digests(awkward), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_repeats(texts_of())
    kept = suffix_dedup.keep(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(rows_of())
    assert kept.where("doc_id = 13").first()["text"] == "" and kept.where("doc_id = 1").first()["text"] is None
    assert suffix_dedup.digests(empty).count() == 0 and suffix_dedup.keep(empty).count() == 0


def test_suffix_dedup_query(spark):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.QUERIES["op7_suffix_array_dedup"](spark, SMALL)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def brute_components(rows):
    sets = defaultdict(list)
    for i, t in rows:
        words = t.encode().lower().split()
        sets[i].append(frozenset(tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1 if words else 0))))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def test_jaccard_on_awkward_rows(awkward, empty):
    got = jaccard.join(awkward).collect()
    known = [(i, t) for i, t in texts_of() if i is not None]
    components, sets = brute_components(known)
    assert len(got) == len(rows_of())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == components[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]][0])
    kept = jaccard.keep(awkward)
    assert kept.columns == awkward.columns
    assert collected(kept.where("doc_id is not null"), "doc_id") == sorted(((c,) for c in set(components.values())), key=str)
    assert jaccard.join(empty).count() == 0 and jaccard.keep(empty).count() == 0


@pytest.mark.parametrize("few", [jaccard.FEW, 1])
def test_jaccard_query(spark, monkeypatch, few):
    """Also with every token taken for one with many documents, so that candidates come from combinations."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    components, sets = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op10_ngram_jaccard"](spark, SMALL).collect()}
    assert got == {i: (len(sets[i][0]), c) for i, c in components.items()}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 90, 90: 90}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.written(stage(spark, before, SMALL))
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
            want = {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.5").collect()}
            assert {r["doc_id"] for r in after.collect()} == want
        elif name == "quality_rules":
            want = {r["doc_id"] for r in quality.measured(before).where("quality.kept").collect()}
            assert {r["doc_id"] for r in after.collect()} == want
        elif name == "ngram_jaccard":
            components, _ = brute_components([(r["doc_id"], r["text"] or "") for r in before.collect()])
            assert {r["doc_id"] for r in after.collect()} == set(components.values())
        elif name == "suffix_array_dedup":
            want = {x[0]: x[4] for x in brute_repeats([(r["doc_id"], r["text"] or "") for r in before.collect()])}
            got = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in after.collect()}
            assert set(got) == set(want) and sum(got[i] == want[i] for i in want) >= 0.9 * len(want)
        else:
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
        if k + 1 < len(corpus_pipeline.STAGES):
            assert after.columns == names
        before = after


ORACLES = sorted(queries.ORACLES)


@pytest.mark.parametrize("name", ORACLES)
def test_matches_oracle(spark, name):
    import duckdb
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    assert collected(df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]), *cols) == sorted(
        (tuple(clean(r[i]) for i in at) for r in rel.fetchall()), key=str)
