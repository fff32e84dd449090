"""Secrets in texts: fixed patterns, and strings that a character Markov model of random strings explains best.

Everything is a Spark SQL expression; no Python runs on the data.

1. *Patterns.*  ``assign`` (a password-like name, a sign, a value), ``access`` (access keys) and ``hex`` (long hexadecimal
   runs).  Splitting a text at a pattern gives what stands between its matches, hence their places in code points.
2. *Labelled samples.*  Every distinct string that a pattern finds (the value of ``assign``) is a random string; every other
   distinct word of ``WORD`` is an ordinary identifier.  Copies count once.
3. *Models.*  Both classes are first-order Markov chains over characters with one added to each count.  The table of log-likelihood
   ratios, in thousandths, has 128 x 128 entries, whatever the corpus.  Steps to or from a sign count nothing, as signs join the
   words of paths and names as well as random strings.
4. *Random spans.*  A run of ``CANDIDATE`` that meets no pattern span is a ``random`` span if its ratio is ``LEAST`` or more, in
   all and ``LEAST_EACH`` a character.

A null text is the empty text and has no span.  Repeated rows are scanned each; a null id stays null.  Long texts are one
row's work, linear in their length.  Without samples both models are uniform and nothing is added.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .arrow import texts

# fixed values: kind, pattern, group that is measured, its least length; kinds in the order in which equal starts are listed
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
RANDOM = "random"
WORD = r"[A-Za-z0-9]{8,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
CODES = 128
LETTERS = [c for c in range(CODES) if chr(c).isalnum()]
LEAST = 12_000
LEAST_EACH = 1000
SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"


def _places(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Start, kind, end and measured group of the matches whose group is long enough."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    matches = F.arrays_zip(between.alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(state, m):
        start = state["at"] + m["gap"]
        end = start + F.length(m["whole"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["value"].alias("value"))
        found = F.when(F.length(m["value"]) >= least, F.concat(state["found"], F.array(one))).otherwise(state["found"])
        return F.struct(F.coalesce(end, start).alias("at"), found.alias("found"))
    none = F.array().cast(SPAN)
    walked = F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])
    return F.when(text.rlike(pattern), walked).otherwise(none)


def based(docs: DataFrame) -> DataFrame:
    """``doc_id, text, base``: the spans of the fixed patterns by start, then kind."""
    found = [_places(F.col("text"), pattern, k, group, least) for k, (_, pattern, group, least) in enumerate(KINDS)]
    return texts(docs).select("doc_id", "text", F.array_sort(F.concat(*found)).alias("base"))


def samples(docs: DataFrame) -> DataFrame:
    """``value, random``: every distinct labelled string."""
    own = based(docs)
    values = own.select(F.explode("base.value").alias("value"), F.lit(True).alias("random"))
    words = own.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value"), F.lit(False).alias("random"))
    return values.unionByName(words).groupBy("value").agg(F.max("random").alias("random"))


def ratios(labelled: DataFrame) -> list[int]:
    """Log-likelihood ratio of each step between characters, in thousandths: place ``CODES * before + after``."""
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    steps = labelled.select("random", F.explode(F.zip_with(
        F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))),
        lambda a, b: F.ascii(a) * CODES + F.ascii(b))).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    table = [0] * (CODES * CODES)
    for a in LETTERS:
        seen = [[counts.get((k, CODES * a + b), 0) + 1 for b in LETTERS] for k in (False, True)]
        for b, ordinary, drawn in zip(LETTERS, *seen):
            table[CODES * a + b] = math.floor(1000 * (math.log(drawn / sum(seen[1])) - math.log(ordinary / sum(seen[0]))) + 0.5)
    return table


def scan(docs: DataFrame, table: list[int] | None = None) -> DataFrame:
    """``doc_id``, the ``base`` spans and all ``spans``, each with start, kind (place in ``KINDS``, then random), end and string."""
    table = table or ratios(samples(docs))
    model = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")

    def ratio(value: Column) -> Column:
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        steps = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1),
                           lambda a, b: F.get(model, F.ascii(a) * CODES + F.ascii(b)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def added(c: Column) -> Column:
        alone = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
        return alone & (ratio(c["value"]) >= F.greatest(F.lit(LEAST), LEAST_EACH * F.length(c["value"])))
    runs = _places(F.col("text"), CANDIDATE, len(KINDS), 0, 1)
    return based(docs).select("doc_id", "base", F.array_sort(F.concat("base", F.filter(runs, added))).alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as ``kind:start:end``."""
    found = scan(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
