"""Document fingerprints by order MinHash, in Spark expressions only.

Tokens are runs of characters between white space.  Every pair of consecutive tokens is a k-mer (k = 2); equal k-mers of a
text are numbered in text order, and the hash of k-mer and number is its rank.  The ranks fall into ``SLOTS`` slots by their
leading bits, which replaces that many hash functions by one (one permutation, split); in each slot the two minimal ranks
are selected, put back into text order and hashed as a tuple.  Two texts agree in a slot if they hold the same minimal
k-mers in the same order, so that moving text around, which leaves a set of k-mers alone, still changes the fingerprint.

A text of one token is one k-mer (more than 2**26 tokens are not supported); a null, empty or blank text has none and the fingerprint ''.  Two fingerprints without slots
have likeness 1.  Documents follow each other by descending id, then text; the row after the last is the first; a row alone
follows itself.  Null ids come last.  Repeated rows repeat.

One shuffle: rows go to ranges of ids, and the first row of each range is sent to the range before it as well, so that a
window inside a range finds every next row.  There are three ranges for each shuffle partition, and only their bounds
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrow import texts
from .quality import let

SLOT_BITS = 6
RANK_BITS = 31
PLACE_BITS = 26
LEN = 2


def _count(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _kmers(tokens: Column) -> Column:
    """Packed slot, rank and place of every occurrence-numbered k-mer, not sorted."""
    top = (1 << SLOT_BITS + RANK_BITS) - 1
    place = (1 << PLACE_BITS) - 1
    n = F.when(F.size(tokens) > place, F.raise_error(F.lit("a text has too many tokens for a place in a fingerprint")).cast("int")).when(
        F.size(tokens) > 1, F.size(tokens) - 1).otherwise(F.size(tokens))
    pairs = F.transform(_count(n), lambda i: F.shiftleft(
        F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1)).bitwiseAND(top), PLACE_BITS).bitwiseOR(i.cast("long")))

    def numbered(s):
        code = lambda j: F.shiftright(F.get(s, j), PLACE_BITS)
        heads = F.filter(_count(F.size(s)), lambda j: (j == 0) | (code(j) != code(j - 1)))

        def run(heads):
            return F.transform(heads, lambda j, q: let(F.coalesce(F.get(heads, q + 1), F.size(s)), lambda end: F.when(
                end == j + 1, F.array(ranked(F.get(s, j), F.lit(0)))).otherwise(F.transform(
                    F.sequence(j, end - 1), lambda o: ranked(F.get(s, o), o - j)))))
        return F.flatten(let(heads, run))

    def ranked(value, number):
        return F.shiftleft(F.xxhash64(F.shiftright(value, PLACE_BITS), number).bitwiseAND(top), PLACE_BITS).bitwiseOR(
            value.bitwiseAND(place))
    return let(F.sort_array(pairs), numbered)


def fingerprint(text: Column) -> Column:
    """Array of slot hashes; the slot is in the upper bits, so equal entries mean equal slots with equal tuples."""
    slot = lambda v: F.shiftright(v, RANK_BITS + PLACE_BITS)
    rank = lambda v: F.shiftright(v, PLACE_BITS)
    place = lambda v: v.bitwiseAND((1 << PLACE_BITS) - 1)

    def tuples(s):  # the least two of each slot, ascending
        def entry(j):
            a, b = F.get(s, j), F.get(s, j + 1)
            both = F.coalesce(slot(a) == slot(b), F.lit(False))
            hashed = F.when(~both, F.xxhash64(rank(a))).when(place(a) < place(b), F.xxhash64(rank(a), rank(b))).otherwise(
                F.xxhash64(rank(b), rank(a)))
            return F.shiftleft(slot(a), 64 - SLOT_BITS).bitwiseOR(F.shiftrightunsigned(hashed, SLOT_BITS))
        heads = F.filter(_count(F.size(s)), lambda j: (j == 0) | (slot(F.get(s, j)) != slot(F.get(s, j - 1))))
        return F.transform(heads, entry)

    tokens = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    ranks = let(tokens, lambda w: F.sort_array(_kmers(w)))
    least = let(ranks, lambda s: F.filter(s, lambda v, j: (j < LEN) | (slot(F.get(s, j - LEN)) != slot(v))))
    return let(least, tuples)


def written(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda v: F.hex(v)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots used by either fingerprint that agree."""
    slots = lambda x: F.transform(x, lambda v: F.shiftrightunsigned(v, 64 - SLOT_BITS))
    used = F.size(F.array_union(slots(a), slots(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def with_next(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` (``doc_id``, ``text``, others) with a struct ``next`` of ``columns`` of the following row."""
    spark = rows.sparkSession
    ranges = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id")
    low = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(low))
    bounds = ids.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] if ranges > 1 else [0.5], 10000).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    # 0 is the range with the largest ids; at most ``ranges`` bounds
    part = F.lit(len(bounds)) - F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < key)) if bounds else F.lit(0)
    here = rows.withColumn("part", part.cast("int"))
    heads = {r["part"]: r["top"] for r in here.groupBy("part").agg(F.max(key).alias("top")).collect()}
    if not heads:
        return here.withColumn("next", F.struct(*columns)).drop("part")
    order = sorted(heads)
    before = {heads[p]: order[i - 1] for i, p in enumerate(order)}
    # the copies: rows with the largest id of a range; if several rows share it, the window takes the first of them
    copies = here.where(key.isin(list(before))).withColumn("part", F.element_at(F.create_map(
        *[F.lit(x) for kv in before.items() for x in kv]), key)).withColumn("copy", F.lit(1))
    every = here.withColumn("copy", F.lit(0)).unionByName(copies)
    by = Window.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return every.withColumn("next", F.lead(F.struct(*columns)).over(by)).where("copy = 0").drop("part", "copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document."""
    rows = texts(docs).select("doc_id", "text", fingerprint(F.col("text")).alias("own"))
    paired = with_next(rows, F.col("text").alias("text"), F.col("own").alias("own"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    made = paired.select("doc_id", n.cast("long").alias("n_chars"), "own", F.col("next.own").alias("after"), edited.alias("edited"))
    both = made.select("doc_id", "n_chars", "own", "after", let(F.col("edited"), lambda e: F.struct(
        F.sha2(e.cast("binary"), 256).alias("sha"), fingerprint(e).alias("print"))).alias("e"))
    return both.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), written(F.col("own")).alias("fingerprint"),
                       written(F.col("e.print")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("e.print")).alias("near_edited"),
                       likeness(F.col("own"), F.col("after")).alias("near_next"))
