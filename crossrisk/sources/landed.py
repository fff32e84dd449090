"""Landed vendor files: constituents, prices, statements, filings, factor series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..config import HEADER_WORDS, MIN_FRESH_COVERAGE, MIN_UNIVERSE_ROWS, STALE_DAYS
from ..functions.expr import normalize_key
from .schema import to_number


# ---- keys and universe ------------------------------------------------------------------------

def _canonical_header(name: str) -> str | None:
    """The column that a header stands for: the first entry of the table whose words fit."""
    def fits(words: tuple[str, ...]) -> bool:
        return any(w in name.lower() for w in words)
    return next((column for column, some, none in HEADER_WORDS if fits(some) and not fits(none)), None)


def load_universe(spark: SparkSession, path: str, min_rows: int = MIN_UNIVERSE_ROWS) -> DataFrame:
    """Constituents CSV with sniffed headers, first row per key, row-count gate."""
    raw = spark.read.csv(path, header=True)
    taken: dict[str, str] = {}
    for c in raw.columns:
        target = _canonical_header(c)
        if target and target not in taken:
            taken[target] = c
    if "entity" not in taken:
        raise ValueError(f"no key column in {raw.columns}")
    cols = [(F.col(f"`{taken[t]}`") if t in taken else F.lit(None).cast("string")).alias(t)
            for t in ("entity", "name", "sector", "industry")]
    # position in the files: the reader numbers the rows of a split in order, and splits begin at their block's offset
    seq = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = raw.select(*cols, seq.alias("_seq")).withColumn("entity", normalize_key("entity"))
    first = F.min_by(F.struct("name", "sector", "industry"), "_seq").alias("r")
    out = rows.where(F.col("entity").isNotNull()).groupBy("entity").agg(first).select("entity", "r.*")
    n = out.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n < min_rows:
        raise ValueError(f"only {n} constituents, expected at least {min_rows}")
    return out


def pad_universe(universe: DataFrame, holdings: DataFrame) -> DataFrame:
    """Append holdings that the universe lacks, with name = key and unknown sector and industry."""
    extra = holdings.select("entity").distinct().join(universe, "entity", "left_anti")
    return universe.unionByName(extra.select(
        "entity", F.col("entity").alias("name"), F.lit("Unknown").alias("sector"), F.lit("Unknown").alias("industry")),
        allowMissingColumns=True)


def batch_keys(spark: SparkSession, path: str) -> DataFrame:
    """One key per line; blanks and # comments dropped."""
    line = F.upper(F.trim("value"))
    return (spark.read.text(path).select(line.alias("entity"))
            .where((F.col("entity") != "") & ~F.startswith("entity", F.lit("#"))))


def missing_keys(requested: DataFrame, have: DataFrame, key: str = "entity") -> DataFrame:
    """Requested keys without data."""
    return requested.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def union_keys(a: DataFrame, b: DataFrame, key: str = "entity") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def intersect_keys(a: DataFrame, b: DataFrame, key: str = "entity") -> DataFrame:
    return a.select(key).intersect(b.select(key))


# ---- prices -----------------------------------------------------------------------------------

def unpivot_prices(wide: DataFrame, date: str = "date") -> DataFrame:
    """Columns ``"KEY|Close"`` / ``"KEY|Volume"`` to ``entity, date, adj_close, volume``.

    Rows without any value are dropped.  The unpivot runs before any shuffle.
    """
    cols = [c for c in wide.columns if c != date]
    long = (wide.unpivot(date, [F.col(f"`{c}`").cast("double").alias(c) for c in cols], "_name", "_v")
            .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    parts = F.split("_name", r"\|", 2)
    long = long.select(F.col(date).alias("date"), parts[0].alias("entity"), parts[1].alias("field"), "_v")
    pick = lambda f: F.max(F.when(F.lower("field") == f, F.col("_v")))
    return long.groupBy("entity", "date").agg(pick("close").alias("adj_close"), pick("volume").alias("volume"))


def unpivot_closes(wide: DataFrame, date: str = "date") -> DataFrame:
    """Wide close matrix (one column per entity) to long, nulls dropped."""
    cols = [c for c in wide.columns if c != date]
    return (wide.unpivot(date, [F.col(f"`{c}`").cast("double").alias(c) for c in cols], "entity", "adj_close")
            .where(F.col("adj_close").isNotNull() & ~F.isnan("adj_close")))


def merge_refresh(prior: DataFrame, new: DataFrame, key: str = "entity") -> DataFrame:
    """New rows replace all rows of the entities they cover; an empty refresh is an error."""
    if new.limit(1).count() == 0:
        raise ValueError("price refresh returned no rows")
    return prior.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def freshness(prices: DataFrame, wanted: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    """One row: wanted, fresh, coverage; names without data count in the denominator."""
    last = prices.where(F.col("adj_close").isNotNull()).groupBy("entity").agg(F.max("date").alias("last"))
    fresh = F.count_if(F.col("last") >= F.date_sub(F.col("_as_of"), days))
    rows = wanted.select("entity").distinct().join(last, "entity", "left").withColumn("_as_of", as_of)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("wanted"), fresh.alias("fresh"),
                    (fresh / F.greatest(n, F.lit(1))).alias("coverage"))


def freshness_gate(prices: DataFrame, wanted: DataFrame, as_of: Column, days: int = STALE_DAYS,
                   min_coverage: float = MIN_FRESH_COVERAGE) -> None:
    row = freshness(prices, wanted, as_of, days).first()
    if row["coverage"] < min_coverage:
        raise ValueError(f"only {row['fresh']}/{row['wanted']} entities have a close within {days} days "
                         f"({row['coverage']:.0%}, need {min_coverage:.0%})")


# ---- statements and filings -------------------------------------------------------------------

SPLIT_JSON = "struct<columns:array<string>,index:array<string>,data:array<array<double>>>"


def decode_statements(df: DataFrame, columns: dict[str, str], key: str = "entity") -> DataFrame:
    """Split-oriented JSON statements to ``entity, statement, period_end, item, value``.

    ``columns`` maps a statement name to its JSON column.  Empty or broken JSON gives no rows.
    """
    docs = F.explode(F.array(*[F.struct(F.lit(s).alias("statement"),
                                        F.from_json(F.col(c), SPLIT_JSON, {"mode": "PERMISSIVE"}).alias("j"))
                               for s, c in columns.items()])).alias("d")
    rows = df.select(key, docs).select(key, "d.statement", "d.j")
    items = rows.select(key, "statement", F.col("j.columns").alias("cols"),
                        F.posexplode(F.arrays_zip(F.col("j.index").alias("item"), F.col("j.data").alias("cells")))
                        .alias("i", "r"))
    cells = items.select(key, "statement", F.col("r.item").alias("item"),
                         F.explode(F.arrays_zip(F.col("cols").alias("period"), F.col("r.cells").alias("value"))).alias("c"))
    return (cells.select(key, "statement", F.try_to_date(F.substring("c.period", 1, 10)).alias("period_end"), "item",
                         F.col("c.value").alias("value"))
            .where(F.col("period_end").isNotNull() & F.col("value").isNotNull()))


def encode_statements(stmt: DataFrame, key: str = "entity") -> DataFrame:
    """The reverse of :func:`decode_statements`: one JSON text per entity and statement, newest period first.

    A statement holds at most its quarters x line items, so the lists are small.
    """
    cells = stmt.groupBy(key, "statement", "item").agg(
        F.collect_list(F.struct(F.col("period_end").cast("string").alias("p"), "value")).alias("m"))
    periods = stmt.groupBy(key, "statement").agg(
        F.reverse(F.array_sort(F.collect_set(F.col("period_end").cast("string")))).alias("columns"))
    rows = cells.groupBy(key, "statement").agg(F.array_sort(F.collect_list(F.struct("item", "m"))).alias("rows"))
    doc = F.struct("columns", F.transform("rows", lambda r: r["item"]).alias("index"),
                   F.transform("rows", lambda r: F.transform("columns", lambda p: F.map_from_entries(r["m"])[p]))
                   .alias("data"))
    return periods.join(rows, [key, "statement"]).select(key, "statement", F.to_json(doc, {"ignoreNullFields": "false"})
                                                         .alias("json"))


FILING_JSON = "struct<filings:struct<recent:struct<form:array<string>,filingDate:array<string>>>>"


def decode_filings(df: DataFrame, payload: str = "payload", key: str = "entity") -> DataFrame:
    """Parallel arrays of forms and dates to ``entity, form, filed``; unparseable dates skipped."""
    recent = F.from_json(F.col(payload), FILING_JSON)["filings"]["recent"]
    zipped = F.explode(F.arrays_zip(recent["form"].alias("form"), recent["filingDate"].alias("filed"))).alias("f")
    return (df.select(key, zipped).select(key, "f.form", F.try_to_date(F.col("f.filed")).alias("filed"))
            .where(F.col("filed").isNotNull()))


ID_JSON = "map<string,struct<ticker:string,cik_str:string>>"


def id_map(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Registry JSON to ``entity, filer_id`` with the id padded to ten digits."""
    entry = F.explode(F.map_values(F.from_json(F.col(payload), ID_JSON))).alias("e")
    return df.select(entry).select(F.upper("e.ticker").alias("entity"), F.lpad("e.cik_str", 10, "0").alias("filer_id"))


# ---- factor series ----------------------------------------------------------------------------

def read_manual(spark: SparkSession, path: str, start: str, end: str | None = None) -> DataFrame:
    """User-supplied ``date,value`` CSV, any header case, inclusive date slice."""
    raw = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in raw.columns}
    if "date" not in names or "value" not in names:
        raise ValueError(f"expected columns date,value; found {raw.columns}")
    out = raw.select(F.try_to_date(F.trim(F.col(f"`{names['date']}`"))).alias("date"),
                     to_number(F.trim(F.col(f"`{names['value']}`"))).alias("value")).dropna()
    out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def parse_daily_block(lines: DataFrame) -> DataFrame:
    """First contiguous block of ``YYYYMMDD,…`` rows as ``date, factor, value`` in decimals.

    ``lines`` has ``value`` and an increasing ``line``.  The block ends at the first other line; the header is the
    last complete line before it; a header shorter than a row names none of its columns (they are F0, F1, …).  Missing numbers are null and all-null rows disappear in long form.
    """
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    toks = lines.select("line", parts.alias("p")).withColumn("is_day", F.col("p")[0].rlike(r"^\d{8}$"))
    first = toks.agg(F.min(F.when(F.col("is_day"), F.col("line")))).scalar()
    marked = toks.withColumn("_first", first)
    stop = marked.agg(F.min(F.when(~F.col("is_day") & (F.col("line") > F.col("_first")), F.col("line")))).scalar()
    before = ~F.col("is_day") & (F.col("line") < F.col("_first")) & (F.size("p") > 1)
    header = marked.agg(F.max_by("p", F.when(before, F.col("line")))).scalar()
    rows = (marked.withColumn("_stop", stop).withColumn("_header", header)
            .where(F.col("is_day") & (F.col("_stop").isNull() | (F.col("line") < F.col("_stop")))))
    named = rows.select(F.try_to_date(F.col("p")[0], "yyyyMMdd").alias("date"),
                        F.size("p").alias("_width"), F.posexplode("p").alias("pos", "v"), "_header").where("pos > 0")
    number = F.concat(F.lit("F"), (F.col("pos") - 1).cast("string"))
    name = F.when(F.size("_header") >= F.col("_width"), F.get("_header", F.col("pos")))
    return (named.select("date", F.when(name != "", name).otherwise(number).alias("factor"), (to_number("v") / 100).alias("value"))
            .where(F.col("value").isNotNull()))


def read_daily_block(spark: SparkSession, path: str) -> DataFrame:
    """One text file of the kind above; lines keep file order through the block offset and the reader's sequence."""
    raw = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                          F.monotonically_increasing_id().alias("i")).alias("line"))
    return parse_daily_block(raw)


def merge_factor_files(main: DataFrame, momentum: DataFrame, canonical: Sequence[str]) -> DataFrame:
    """Wide daily table of two long factor files: inner on date, canonical column order, trimmed names."""
    mom = momentum.groupBy("date").agg(F.first("value").alias("Mom"))
    cols = [c for c in canonical if c != "Mom"]
    wide = main.withColumn("factor", F.trim("factor")).groupBy("date").agg(
        *[F.max(F.when(F.col("factor") == c, F.col("value"))).alias(c) for c in cols])
    return wide.join(mom, "date").select("date", *[c for c in canonical if c in {*cols, "Mom"}])
