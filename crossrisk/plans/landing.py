"""Files landed, read back and gated: every query writes a driver table in a vendor's form and reads it with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import asof, pca, report
from ..session import checkpoint_folder
from ..sources import landed, sinks
from ..sources.store import load_store
from . import macro as M
from . import series as S
from . import views as V
from ..operators.order_stats import row_numbers
from .registry import query, r6


def _landed(df, form: str, **options) -> str:
    """Write ``df`` into the shared folder in a form (csv, text, parquet) and give back the path."""
    import uuid
    path = f"{checkpoint_folder(df.sparkSession)}/landed-{uuid.uuid4().hex}"
    df.write.format(form).options(**options).save(path)
    return path


@query("store_round_trip", "features_pit prices", """
    SELECT 'features' AS name, count(*) AS n, count(DISTINCT entity) AS entities, max(date) AS last FROM features_pit
    UNION ALL SELECT 'prices', count(*), count(DISTINCT entity), max(date) FROM prices""")
def store_round_trip(spark, sf_dir):
    """A store of two tables, prices stored twice; of repeated keys the last row counts."""
    px = V.prices(spark, sf_dir)
    folder = _landed(V.features_pit(spark, sf_dir), "parquet")
    root = f"{folder}-store"
    spark.read.parquet(folder).write.parquet(f"{root}/features.parquet")
    px.unionByName(px).write.parquet(f"{root}/prices.parquet")
    store = load_store(spark, root)
    return store.features.select(F.lit("features").alias("name"), "entity", "date").unionByName(
        store.prices.select(F.lit("prices").alias("name"), "entity", "date")).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.max("date").alias("last"))


@query("forward_return_duplicates", "fwd", """
    SELECT entity, as_of, round(fwd_ret_3m, 6) AS fwd_ret_3m, round(fwd_maxdd, 6) AS fwd_maxdd FROM fwd""")
def forward_return_duplicates(spark, sf_dir):
    """Every price row comes twice, first with another value; the later version counts."""
    px = V.prices(spark, sf_dir)
    twice = px.withColumn("v", F.lit(1)).unionByName(px.withColumn("adj_close", F.col("adj_close") * 3).withColumn("v", F.lit(0)))
    out = asof.forward_stats(twice, S.quarter_ends(spark, sf_dir), [3], 6, V.delistings(spark, sf_dir), order="v")
    return out.select("entity", "as_of", r6("fwd_ret_3m"), r6("fwd_maxdd"))


@query("universe_csv", "universe", "SELECT entity, name, sector, industry FROM universe")
def universe_csv(spark, sf_dir):
    """Constituents under other headers, each of them twice; the first row of a key counts."""
    u = V.universe(spark, sf_dir).select(
        F.concat(F.lit(" "), "entity").alias("Ticker Symbol"), F.col("name").alias("Company"), F.col("sector").alias("GICS Sector"),
        F.col("industry").alias("Industry Group"), F.lit("x").alias("Sub-Sector"))
    doubled = u.withColumn("o", F.lit(0)).unionByName(u.withColumn("Company", F.lit("late")).withColumn("o", F.lit(1)))
    path = _landed(doubled.coalesce(1).sortWithinPartitions("o").drop("o"), "csv", header=True)
    return landed.load_universe(spark, path, 1)


@query("batch_keys", "universe", "SELECT DISTINCT upper(entity) AS entity FROM universe")
def batch_keys(spark, sf_dir):
    """Keys, blanks and comments, one to a line."""
    u = V.universe(spark, sf_dir)
    lines = u.select(F.col("entity").alias("value")).unionByName(u.select(F.concat(F.lit("# "), "name").alias("value"))).unionByName(
        u.select(F.lit("   ").alias("value")))
    return landed.batch_keys(spark, _landed(lines, "text"))


@query("filings_json", "filings", """
    SELECT entity, form, filed, count(*) AS n FROM filings WHERE filed IS NOT NULL GROUP BY ALL""")
def filings_json(spark, sf_dir):
    """Filings as one document of parallel arrays per name."""
    f = V.filings(spark, sf_dir).withColumn("filed", F.col("filed").cast("string"))
    pair = F.collect_list(F.struct("form", "filed"))
    docs = f.groupBy("entity").agg(pair.alias("p")).select("entity", F.to_json(F.struct(F.struct(F.struct(
        F.col("p.form").alias("form"), F.col("p.filed").alias("filingDate")).alias("recent")).alias("filings"))).alias("payload"))
    return landed.decode_filings(docs).groupBy("entity", "form", "filed").agg(F.count(F.lit(1)).alias("n"))


@query("id_map", "universe", "SELECT upper(name) AS entity, lpad(entity, 10, '0') AS filer_id FROM universe")
def id_map(spark, sf_dir):
    """The registry of filer ids, one document per sector."""
    entry = F.map_from_entries(F.collect_list(F.struct("entity", F.struct(F.col("name").alias("ticker"), F.col("entity").alias("cik_str")))))
    docs = V.universe(spark, sf_dir).groupBy("sector").agg(F.to_json(entry).alias("payload"))
    return landed.id_map(docs)


@query("manual_series", "factor_levels", """
    SELECT date, round(avg(value), 6) AS value FROM factor_levels WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY date""")
def manual_series(spark, sf_dir):
    """A series typed by hand, headers in capitals, sliced by date."""
    rows = V.factor_levels(spark, sf_dir).groupBy("date").agg(r6(F.avg("value"), "value"))
    path = _landed(rows.select(F.col("date").cast("string").alias(" DATE"), F.col("value").alias("Value")), "csv", header=True)
    return landed.read_manual(spark, path, "1996-01-01", "1997-12-31").select("date", r6("value"))


def _block(rows, factors):
    """Lines of a daily file in order: preamble, header, days, a closing block of other lines."""
    days = rows.groupBy("date").agg(*[F.max(F.when(F.col("factor") == f, F.round("value", 4))).alias(f) for f in factors])
    cells = [F.coalesce(F.format_string("%.4f", F.col(f)), F.lit("x")) for f in factors]
    body = days.select(F.date_format("date", "yyyyMMdd").alias("k"), F.concat_ws(",", F.date_format("date", "yyyyMMdd"), *cells).alias("value"))
    extra = rows.sparkSession.createDataFrame([("0", "made by hand"), ("1", "," + ",".join(factors)), ("A", " Annual"), ("B", "20210101,9,9")],
                                              "k string, value string")
    return body.unionByName(extra).orderBy("k").select("value")       # ranges of lines: the files' names are in order


@query("daily_block", "factor_levels", """
    SELECT date, factor, round(round(value, 4) / 100, 6) AS value FROM factor_levels""")
def daily_block(spark, sf_dir):
    """The first block of days of a file with a header of the same width."""
    path = _landed(_block(V.factor_levels(spark, sf_dir), V.FACTORS), "text")
    return landed.read_daily_block(spark, path).select("date", "factor", r6("value"))


_MAIN = [f for f in V.FACTORS if f != "R_F"]


@query("factor_files", "factor_levels", f"""
    SELECT date, {", ".join(f"round(max(round(value, 4) / 100) FILTER (factor = '{f}'), 6) AS {f}" for f in _MAIN)},
           round(max(round(value, 4) / 100) FILTER (factor = 'R_F'), 6) AS Mom
    FROM factor_levels WHERE value IS NOT NULL GROUP BY date
    HAVING count(*) FILTER (factor <> 'R_F') > 0 AND count(*) FILTER (factor = 'R_F') > 0""")
def factor_files(spark, sf_dir):
    """Two files merged on their common days."""
    levels = V.factor_levels(spark, sf_dir)
    read = lambda fs: landed.read_daily_block(spark, _landed(_block(levels.where(F.col("factor").isin(fs)), fs), "text"))
    out = landed.merge_factor_files(read(_MAIN), read(["R_F"]), [*_MAIN, "Mom"])
    return out.select("date", *[r6(f) for f in [*_MAIN, "Mom"]])


@query("rolling_loadings", "sreg", """
    SELECT factor AS pc, date, CASE WHEN count(*) OVER w = 60 AND var_samp(x) OVER w > 0
             THEN round(covar_samp(port, x) OVER w / var_samp(x) OVER w, 6) END AS beta
    FROM sreg WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def rolling_loadings(spark, sf_dir):
    """The factors stand in for component scores."""
    d = M.sample(spark, sf_dir)
    scores = d.unpivot("date", V.FACTORS, "pc", "score")
    return pca.rolling_loadings(d.select("date", F.col("port").alias("ret")), scores).select("pc", "date", r6("beta"))


@query("component_labels", "reg", "".join(f"""
    {"UNION ALL" if i else ""} SELECT '{f}' AS pc, CASE WHEN abs(corr({f}, bench)) > 0.7 OR abs(corr({f}, A_O)) > 0.7 THEN 'Market Beta'
      WHEN abs(corr({f}, R_F)) > 0.4 AND abs(corr({f}, A_O)) < 0.5 THEN 'Value/Growth' WHEN abs(corr({f}, N_O)) > 0.4 THEN 'Momentum'
      WHEN abs(corr({f}, R_O)) > 0.5 THEN 'Sector: ' || CASE WHEN corr({f}, R_O) > 0 THEN '' ELSE 'Short ' END || 'Energy'
      ELSE 'Unclassified (inspect loadings)' END AS label FROM reg""" for i, f in enumerate(V.FACTORS)))
def component_labels(spark, sf_dir):
    """Factors under the names that the rules read."""
    d = M.sample(spark, sf_dir)
    scores = d.unpivot("date", V.FACTORS, "pc", "score")
    named = {"A_O": "Mkt-RF", "R_F": "HML", "N_O": "Mom", "R_O": "Energy", "bench": "Benchmark"}
    factors = d.select("date", *[F.col(c).alias(n) for c, n in named.items()])
    corr = scores.join(factors, "date").groupBy("pc").agg(*[F.corr("score", F.col(f"`{n}`")).alias(n) for n in named.values()])
    return pca.label_by_factors(corr, ["Energy"]).select("pc", "label")


@query("top_bottom", "ebeta", """
    SELECT factor AS pc, entity, round(beta, 6) AS loading, side, rank FROM (
      SELECT *, 'top' AS side, row_number() OVER (PARTITION BY factor ORDER BY beta DESC, entity) AS rank FROM ebeta
      UNION ALL SELECT *, 'bottom', row_number() OVER (PARTITION BY factor ORDER BY beta, entity) FROM ebeta) WHERE rank <= 10""")
def top_bottom(spark, sf_dir):
    """The ten largest and smallest values per component, here betas per factor."""
    loads = M.slopes(M.entity_betas(spark, sf_dir)).select(F.col("factor").alias("pc"), "entity", F.col("beta").alias("loading"))
    return pca.top_bottom(loads).select("pc", "entity", r6("loading"), "side", F.col("rank").cast("long").alias("rank"))


@query("largest_absolute", "ebeta", """
    SELECT entity, factor, round(beta, 6) AS beta, row_number() OVER (ORDER BY abs(beta) DESC, entity, factor) AS place
    FROM ebeta""")
def largest_absolute(spark, sf_dir):
    """O1: the order itself is compared, as the place of every row."""
    rows = M.slopes(M.entity_betas(spark, sf_dir)).select("entity", "factor", "beta")
    placed = row_numbers(rows, [F.abs("beta").desc(), "entity", "factor"], "place")
    return placed.select("entity", "factor", r6("beta"), F.col("place").cast("long").alias("place"))


@query("suggestions", "universe", """
    SELECT entity, name FROM universe WHERE starts_with(lower(entity), '1') OR contains(lower(name), '1') ORDER BY entity LIMIT 8""")
def suggestions(spark, sf_dir):
    """P16."""
    return report.suggest(V.universe(spark, sf_dir).select("entity", "name"), "1")


@query("significance", "ebeta", """
    SELECT factor, count(*) AS fits, round(0.05 / greatest(count(*), 1), 9) AS threshold,
           format('{:.1f}%', 100.0 * count(*) FILTER (beta > 0) / count(*)) AS positive FROM ebeta GROUP BY factor""")
def significance(spark, sf_dir):
    """the Bonferroni threshold of a family of fits, and a share as text."""
    rows = M.slopes(M.entity_betas(spark, sf_dir)).groupBy("factor").agg(
        F.count(F.lit(1)).alias("fits"), (F.count_if(F.col("beta") > 0) / F.count(F.lit(1))).alias("share"))
    return rows.select("factor", "fits", F.round(X.bonferroni(F.col("fits")), 9).alias("threshold"), X.percent_text(F.col("share")).alias("positive"))


@query("series_arrays", "factor_levels", """
    SELECT factor, count(*) AS n, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS days,
           string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY date) AS hundredths
    FROM factor_levels GROUP BY factor""")
def series_arrays(spark, sf_dir):
    """K5: every factor's series as arrays in date order."""
    out = sinks.series_arrays(V.factor_levels(spark, sf_dir))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select("factor", F.size("values").cast("long").alias("n"), text("dates", lambda d: d.cast("string")).alias("days"),
                      text("values", lambda v: F.round(v * 100).cast("long").cast("string")).alias("hundredths"))
