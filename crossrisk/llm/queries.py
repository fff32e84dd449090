"""The registered queries of this folder with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (alignment, byte_bpe, chat, hard_negatives, hmm, jaccard, licenses, order_minhash, packing, quality, secret_scan,
               suffix_dedup, toxicity)
from .arrow import crc_rest, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


@query("op3_quality_rules", rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)),
twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop
  FROM w LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR n_repeat_words > 0.5 * n_words OR word_chars < 1.5 * n_words OR word_chars > 30 * n_words
            OR n_symbols > 0.25 * n_words OR n_stop < 0.005 * n_words OR n_dup_lines > 0.5 * n_lines) AS kept
FROM m""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.measured(documents(spark, sf_dir).select("doc_id", "text"))
    m = F.col("quality.measures")
    return q.select("doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    F.arrays_overlap("quality.failed", F.array(*[F.lit(r) for r in quality.BASE_RULES])).alias("base_failed"),
                    F.col("quality.kept").alias("kept"))


@query("op4_order_minhash")
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(documents(spark, sf_dir))


@query("op5_hmm_score")
def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


@query("op6_chat_windows")
def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(table.unionByName(own)))


@query("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir))


_PAIRS = ", ".join(str(r).replace("True", "true").replace("False", "false") for r in licenses.templates())


@query("op1_license_scan", rf"""
WITH tpl(t, label, phrase, n_pairs, core, core_pairs, pos, a, b) AS (VALUES {_PAIRS}),
w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
pairs AS (
  SELECT doc_id, p - 1 AS p, ws[p] AS a, ws[p + 1] AS b
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS p FROM w WHERE len(ws) > 1)),
votes AS (
  SELECT doc_id, t, label, phrase, n_pairs, p - pos AS diagonal, count(*) AS votes, list(pos) AS places,
         count(*) FILTER (pos BETWEEN core AND core + core_pairs - 1) = any_value(core_pairs) AS cored
  FROM pairs JOIN tpl USING (a, b) GROUP BY doc_id, t, label, phrase, n_pairs, p - pos),
marked AS (
  SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER o > {licenses.SHIFT}, true) THEN 1 ELSE 0 END AS apart
  FROM votes WINDOW o AS (PARTITION BY doc_id, t ORDER BY diagonal)),
numbered AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM marked),
spans AS (
  SELECT doc_id, t, label, phrase, n_pairs, span, sum(votes) AS votes, min(diagonal) AS start, bool_or(cored) AS cored,
         list_sort(flatten(list(list_transform(places, lambda x: [diagonal + x, -x])))) AS ordered
  FROM numbered GROUP BY doc_id, t, label, phrase, n_pairs, span),
chained AS (
  SELECT *, CASE WHEN phrase OR votes < {licenses.COVER} * n_pairs THEN votes ELSE list_max(list_reduce(
           ordered, lambda best, v: list_transform(best, lambda x, j: CASE WHEN j = 1 - v[2] THEN
             greatest(x, coalesce(list_max(best[1:-v[2]]), 0) + 1) ELSE x END),
           list_transform(range(n_pairs), lambda x: 0::BIGINT))) END AS chain FROM spans),
judged AS (
  SELECT doc_id, label, start, phrase AND votes = n_pairs AS base, chain / n_pairs AS covered, phrase, cored FROM chained),
found AS (
  SELECT *, CASE WHEN phrase THEN base ELSE cored AND covered >= {licenses.COVER} END AS hit FROM judged),
per_doc AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (hit)), ',') AS labels,
         max(covered) FILTER (hit) AS score
  FROM found GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN per_doc USING (doc_id)""")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id", (crc_rest("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_ngram_jaccard")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(documents(spark, sf_dir))


def _places_sql(kind: int, pattern: str, group: int, least: int) -> str:
    """Rows ``r, kind, start, stop, value`` of one pattern; letters in either case are spelled out, as folding differs by engine."""
    if pattern.startswith("(?i)"):
        name, rest = pattern[4:].split(")", 1)
        pattern = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) + ")" + rest
    p = "'" + pattern.replace("'", "''") + "'"
    return rf"""
  SELECT r, {kind} AS kind, stop - length(whole) AS start, stop, value FROM (
    SELECT *, sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY r ORDER BY n) AS stop FROM (
      SELECT r, unnest(string_split_regex(text, {p})) AS gap, unnest(regexp_extract_all(text, {p}, 0)) AS whole,
             unnest(regexp_extract_all(text, {p}, {group})) AS value, unnest(range(len(string_split_regex(text, {p})))) AS n
      FROM t WHERE regexp_matches(text, {p})))
  WHERE length(value) >= {least}"""


_KINDS = secret_scan.KINDS
_KIND_NAMES = ", ".join(f"'{k}'" for k in [*(k for k, *_ in _KINDS), secret_scan.RANDOM])


@query("op12_secret_scan", rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_places_sql(k, p, g, least) for k, (_, p, g, least) in enumerate(_KINDS))}),
samples AS (
  SELECT value, max(random) AS random FROM (
    SELECT value, 1 AS random FROM base UNION ALL
    SELECT unnest(regexp_extract_all(text, '{secret_scan.WORD}', 0)), 0 FROM t) GROUP BY value),
letters AS (SELECT unnest(range(128)) AS c),
chars AS (SELECT c FROM letters WHERE regexp_matches(chr(c::INT), '^[A-Za-z0-9]$')),
steps AS (
  SELECT random, ascii(value[p]) AS a, ascii(value[p + 1]) AS b, count(*) AS n
  FROM (SELECT value, random, unnest(range(1, length(value))) AS p FROM samples) GROUP BY ALL),
grid AS (
  SELECT k.random, x.c AS a, y.c AS b, coalesce(n, 0) + 1 AS n
  FROM (SELECT unnest([0, 1]) AS random) k CROSS JOIN chars x CROSS JOIN chars y
  LEFT JOIN steps s ON s.random = k.random AND s.a = x.c AND s.b = y.c),
share AS (SELECT random, a, b, n::DOUBLE / (sum(n) OVER (PARTITION BY random, a))::DOUBLE AS p FROM grid),
model AS (
  SELECT a, b, floor(1000 * (ln(max(p) FILTER (random = 1)) - ln(max(p) FILTER (random = 0))) + 0.5)::BIGINT AS w FROM share GROUP BY a, b),
runs AS ({_places_sql(len(_KINDS), secret_scan.CANDIDATE, 0, 1)}),
alone AS (
  SELECT * FROM runs c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.start < c.stop AND b.stop > c.start)),
judged AS (
  SELECT r, kind, start, stop, value, sum(coalesce(w, 0)) AS ratio
  FROM (SELECT *, unnest(range(1, length(value))) AS p FROM alone) x
  LEFT JOIN model ON a = ascii(value[p]) AND b = ascii(value[p + 1]) GROUP BY ALL),
spans AS (
  SELECT r, kind, start, stop FROM base UNION ALL
  SELECT r, kind, start, stop FROM judged WHERE ratio >= greatest({secret_scan.LEAST}, {secret_scan.LEAST_EACH} * length(value))),
listed AS (SELECT r, kind, start, ([{_KIND_NAMES}])[kind + 1] || ':' || start || ':' || stop AS s FROM spans),
per_doc AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {len(_KINDS)}), '') AS base, string_agg(s, ',' ORDER BY start, kind) AS spans
  FROM listed GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per_doc USING (r)""")
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(documents(spark, sf_dir))


@query("op13_hard_negatives", r"""
WITH q AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, q.vec_id AS other, a.label = q.label AS same, list_dot_product(a.v, q.v)::BIGINT AS score
  FROM q a, q WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, other) AS k FROM s WHERE same AND other <> anchor_id QUALIFY k <= 5)
SELECT p.anchor_id, p.other AS positive_id, (row_number() OVER (PARTITION BY p.r, p.k ORDER BY n.score DESC, n.other))::INT AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN s n ON n.r = p.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved.cast("int")), F.col("vec_id") % 100 == 0)
