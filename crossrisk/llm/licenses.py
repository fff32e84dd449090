"""License scans by diagonal voting.

Templates are license phrases and notices.  Every rolling pair of words of every text is hashed and joined to the positions
of the pairs in the templates; equal ``text position - template position`` is a diagonal, and each verified pair is a vote
for it.  A phrase stands where all its pairs vote for one diagonal.  For notices, diagonals that lie within ``SHIFT`` words
of each other are merged, so that an inserted or missing word does not split a notice.  A merged span is verified: the longest
chain of votes that goes forward in the text and in the template must hold ``COVER`` of the template's pairs, and the words that
tell the notice from others (its core) must stand consecutively.  A pair that is said twice counts once.

The template table is a few hundred rows fixed by the parameter, so it is broadcast.  One shuffle of votes follows, already
counted for each text and diagonal.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, compared in lower case.  A null or empty
text has no words, no labels and score 0.  Repeated rows repeat.  Equal spans are one span.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrow import texts

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# fixed values: phrases and labels
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# fixed values: opening words of well-known notices, a label, and the core
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "mit-notice", "software and associated documentation files"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
     "apache-notice", "apache license version 2 0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     "gpl-notice", "gnu general public license"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "bsd-notice", "source and binary forms"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("this work is licensed under a creative commons attribution", "cc-by", "creative commons attribution"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0", "gnu general public license version 3"),
    ("released under the mit license", "mit-release", "mit license"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla public license"),
]
SHIFT = 3
COVER = 0.75


MASK = 63                               # template positions in one column of marks


def _words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """Pairs of all templates: template, label, is it a phrase, pairs in it, place and pairs of its core, position, the two words.

    A notice is (text, label) or (text, label, core); a phrase has no core, as it has to stand whole.
    """
    rows = []
    for t, (text, label, *core) in enumerate([*phrases, *notices]):
        words, kept = _words(text), _words(core[0]) if core else []
        if len(words) < 2:
            raise ValueError(f"a template needs two words: {text!r}")
        first = next((i for i in range(len(words) - len(kept) + 1) if words[i:i + len(kept)] == kept), None)
        if first is None or len(kept) == 1:
            raise ValueError(f"the core {core[0]!r} must be two or more consecutive words of {text!r}")
        rows += [(t, label, t < len(phrases), len(words) - 1, first, max(len(kept) - 1, 0), p, words[p], words[p + 1])
                 for p in range(len(words) - 1)]
    return rows


def _chain(votes: Column, pairs: Column) -> Column:
    """Length of the longest chain of (text place, - template position) that goes forward in both; ``votes`` are sorted.

    ``best[a]`` is the longest chain that ends at template position a; votes of one text place come with falling positions.
    """
    def step(best, vote):
        at = -vote["back"]
        longer = F.coalesce(F.array_max(F.slice(best, 1, at)), F.lit(0)) + 1
        return F.transform(best, lambda x, j: F.when(j == at, F.greatest(x, longer)).otherwise(x))
    return F.array_max(F.aggregate(votes, F.array_repeat(F.lit(0), pairs), step))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, shift: int = SHIFT, cover: float = COVER) -> DataFrame:
    """One row per text: counts, first and last place of the phrases, labels, and the best share of a template found."""
    spark = docs.sparkSession
    # row 0 of every text is a marker that joins the template -1, so that texts without any hit keep their row
    rows = templates(phrases, notices)
    marks = [f"m{i}" for i in range(max(r[3] for r in rows) // MASK + 1)]
    # a position is one bit of one of the marks
    bits = lambda at: [1 << at % MASK if at // MASK == i else 0 for i in range(len(marks))]
    table = spark.createDataFrame(
        [(-1, "", False, 1, 0, 0, -1, "", "", *bits(0)), *[(*r, *bits(r[6])) for r in rows]],
        "t int, label string, phrase boolean, pairs int, core int, core_pairs int, at int, a string, b string, "
        + ", ".join(f"{m} long" for m in marks))
    table = table.withColumn("hash", F.when(F.col("t") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("a", "b")))
    # lower() changes more than A-Z, but no word boundary and no word of ASCII letters that a template could hold
    words = F.filter(F.split(F.lower("text"), GAP), lambda w: w != "")
    places = F.when(F.size("w") > 1, F.sequence(F.lit(0), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    hashes = F.concat(F.array(F.lit(0).cast("long")), F.transform(places, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1))))
    rolled = (texts(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("w"))
              .select("doc_id", "row", "w", hashes.alias("h"))
              .select("doc_id", "row", "w", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("h").alias("p", "hash")))
    same = (F.col("t") < 0) & (F.col("p") == 0) | (F.col("t") >= 0) & (F.get("w", F.col("p") - 1) == F.col("a")) & (
        F.get("w", F.col("p")) == F.col("b"))
    key = ["row", "doc_id", "n_words", "t", "label", "phrase", "pairs", "core", "core_pairs"]
    votes = (rolled.join(F.broadcast(table), "hash").where(same)
             .groupBy(*key, (F.col("p") - 1 - F.col("at")).cast("long").alias("diagonal"))
             .agg(F.count("*").alias("votes"), *[F.bit_or(m).alias(m) for m in marks]))
    by = Window.partitionBy("row", "t").orderBy("diagonal")
    apart = (F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > shift, F.lit(True))).cast("int")
    votes = (votes.withColumn("span", apart).withColumn("span", F.sum("span").over(by))
             .withColumn("enough", F.sum("votes").over(Window.partitionBy("row", "t", "span")) >= F.col("pairs") * cover))
    voted = lambda at: F.getbit(F.get(F.array(*marks), F.floor(at / MASK).cast("int")), at % MASK) == 1
    here = F.filter(F.sequence(F.lit(0), F.col("pairs") - 1), voted)
    cored = (F.col("core_pairs") == 0) | F.forall(F.sequence("core", F.col("core") + F.greatest("core_pairs", F.lit(1)) - 1), voted)
    notice = ~F.col("phrase") & F.col("enough") & (F.col("t") >= 0)
    places = F.when(notice, F.transform(here, lambda at: F.struct((F.col("diagonal") + at).alias("p"), (-at).alias("back"))))
    spans = (votes.select(*key, "span", "diagonal", "votes", F.when(notice, cored).alias("cored"), places.alias("places"))
             .groupBy(*key, "span").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("start"), F.max("cored").alias("cored"),
                                        F.collect_list("places").alias("places")))
    chain = F.when(F.size("places") > 0, _chain(F.array_sort(F.flatten("places")), F.col("pairs"))).otherwise(F.lit(0))
    spans = spans.withColumn("covered", F.when(F.col("phrase"), F.col("votes")).otherwise(chain) / F.col("pairs"))
    base = F.col("phrase") & (F.col("votes") == F.col("pairs"))
    found = (F.col("t") >= 0) & F.when(F.col("phrase"), base).otherwise(F.col("cored") & (F.col("covered") >= cover))
    found, covered = F.coalesce(found, F.lit(False)), F.col("covered")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (spans.groupBy("row", "doc_id", "n_words")
            .agg(F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
                 F.max(F.when(base, F.col("start"))).alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
                 joined(F.when(found, F.col("label"))).alias("labels"),
                 F.coalesce(F.max(F.when(found, covered)), F.lit(0.0)).alias("score"))
            .drop("row"))
