"""Canonical tables of the engine derived from the star-schema test tables, in Spark and as oracle SQL.

Amounts are summed as integer cents and counts as integers, so both engines see bit-identical inputs.  Every view
uses whole tables.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import FEATURE_LABELS, FEATURES
from ..operators import asof, returns
from ..session import cut_lineage


_STORED: dict[tuple, DataFrame] = {}


def stored(fn):
    """Write a derived table once per session and directory, as the store the operators would read from."""
    @wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _STORED:
            _STORED[key] = cut_lineage(fn(spark, sf_dir))
        return _STORED[key]
    return wrapper


def forget_stored() -> None:
    _STORED.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(col: str):
    return F.round(F.col(col) * 100).cast("long")


@stored
def prices(spark, sf_dir) -> DataFrame:
    """entity, date, adj_close, volume: average unit price and quantity per supplier and shipping day."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").cast("string").alias("entity"), F.to_date("l_shipdate").alias("date"))
            .agg(F.sum(_cents("l_extendedprice")).alias("_c"), F.sum(F.col("l_quantity").cast("long")).alias("_q"))
            .select("entity", "date",
                    (F.col("_c").cast("double") / F.col("_q").cast("double")).alias("adj_close"),
                    F.col("_q").cast("double").alias("volume")))


def universe(spark, sf_dir) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").cast("string").alias("entity"), F.col("s_name").alias("name"),
                    F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
                    F.col("s_acctbal").alias("acctbal")))


DELIST_DATE = "2000-06-30"


def delistings(spark, sf_dir) -> DataFrame:
    gone = (F.col("entity").cast("long") % 12 == 0) & (F.col("date") <= F.lit(DELIST_DATE).cast("date"))
    return (prices(spark, sf_dir).where(gone).groupBy("entity")
            .agg((F.max_by("adj_close", "date") * 0.1).alias("final_value"))
            .select("entity", F.lit(DELIST_DATE).cast("date").alias("delist_date"), "final_value"))


def holdings(spark, sf_dir) -> DataFrame:
    """entity, weight: suppliers with a large balance, weighted by it."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 7000")
    total = s.agg(F.sum(_cents("s_acctbal"))).scalar()
    return s.select(F.col("s_suppkey").cast("string").alias("entity"),
                    (_cents("s_acctbal").cast("double") / total.cast("double")).alias("weight"))


def holdings_pit(spark, sf_dir) -> DataFrame:
    """date, entity, weight: a third of the solvent suppliers at each quarter start, rotating."""
    li = table(spark, sf_dir, "lineitem")
    quarters = li.select(F.trunc(F.to_date("l_shipdate"), "quarter").alias("date")).distinct()
    days = asof.calendar(quarters)
    s = (table(spark, sf_dir, "supplier").where("s_acctbal > 3000")
         .withColumn("_d", days).withColumn("date", F.explode("_d")).drop("_d"))
    turn = F.year("date") * 4 + F.quarter("date")
    held = s.where((F.col("s_suppkey") + turn) % 3 == 0)
    total = held.groupBy("date").agg(F.sum(_cents("s_acctbal")).alias("_t"))
    return (held.join(total, "date")
            .select("date", F.col("s_suppkey").cast("string").alias("entity"),
                    (_cents("s_acctbal").cast("double") / F.col("_t").cast("double")).alias("weight")))


def universe_pit(spark, sf_dir) -> DataFrame:
    """date, entity, in_index: membership at each quarter start; delisted names leave."""
    li = table(spark, sf_dir, "lineitem")
    days = asof.calendar(li.select(F.trunc(F.to_date("l_shipdate"), "quarter").alias("date")).distinct())
    s = (table(spark, sf_dir, "supplier").select("s_suppkey").withColumn("_d", days)
         .withColumn("date", F.explode("_d")))
    gone = (F.col("s_suppkey") % 12 == 0) & (F.col("date") > F.lit(DELIST_DATE).cast("date"))
    young = (F.col("s_suppkey") % 9 == 0) & (F.col("date") < F.lit("1996-07-01").cast("date"))
    return s.select("date", F.col("s_suppkey").cast("string").alias("entity"), (~(gone | young)).alias("in_index"))


@stored
def features_pit(spark, sf_dir) -> DataFrame:
    """date, entity, sector, 16 features: one row per supplier and quarter, dated at the quarter's last shipping day."""
    li = table(spark, sf_dir, "lineitem").withColumn("_day", F.to_date("l_shipdate"))
    quarter = F.trunc("_day", "quarter").alias("q")
    stats = li.groupBy(F.col("l_suppkey").cast("string").alias("entity"), quarter).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.sum(_cents("l_extendedprice")).alias("rev"),
        F.sum(_cents("l_discount")).alias("disc"),
        F.sum(_cents("l_tax")).alias("tax"),
        F.count_if(F.col("l_returnflag") == "R").alias("ret"),
        F.count_if(F.col("l_linestatus") == "O").alias("opn"),
        F.max("l_quantity").alias("maxq"),
        F.sum(F.col("l_linenumber").cast("long")).alias("lines"))
    ends = li.groupBy(quarter).agg(F.max("_day").alias("date"))
    w = W.partitionBy("entity").orderBy("q")
    stats = (stats.withColumn("rev4", F.lag("rev", 4).over(w)).withColumn("n4", F.lag("n", 4).over(w))
             .join(ends, "q"))
    signals = returns.price_signals(prices(spark, sf_dir))
    signals = asof.features_asof(signals.withColumnRenamed("date", "day"), asof.calendar(ends),
                                 date="day", out="date", src="px_date")
    sectors = universe(spark, sf_dir).select("entity", "sector")
    d = lambda c: F.col(c).cast("double")
    return (stats.join(signals, ["entity", "date"], "left").join(sectors, "entity", "left").select(
        "date", "entity", "sector",
        F.when(F.col("n") % 7 != 0, d("disc") / d("n")).alias("altman_z"),
        (d("tax") / d("n")).alias("current_ratio"),
        (d("rev") / d("qty")).alias("net_debt_to_ebitda"),
        (d("ret") / d("n")).alias("fcf_yield"),
        (d("opn") / d("n")).alias("interest_coverage"),
        d("maxq").alias("accruals_ratio"),
        (d("rev") / d("rev4") - 1).alias("asset_growth_yoy"),
        (d("n") / d("n4") - 1).alias("net_issuance_yoy"),
        (F.col("disc") % 17).cast("double").alias("short_pct_float"),
        "momentum_30d", "momentum_90d", "volatility_60d", "relative_volume",
        (d("lines") / d("n")).alias("pe_ratio"),
        (d("rev") / d("n")).alias("ev_to_ebitda"),
        d("n").alias("filing_count_90d")))


FACTORS = ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"]


def factor_levels(spark, sf_dir) -> DataFrame:
    """factor, date, value: average unit price per return flag, line status and day."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("factor"),
                       F.to_date("l_shipdate").alias("date"))
            .agg(F.sum(_cents("l_extendedprice")).alias("_c"), F.sum(F.col("l_quantity").cast("long")).alias("_q"))
            .select("factor", "date", (F.col("_c").cast("double") / F.col("_q").cast("double")).alias("value")))


def stmt(spark, sf_dir) -> DataFrame:
    """entity, statement, period_end, item, value: order totals per customer and quarter as line items."""
    o = table(spark, sf_dir, "orders")
    kind = F.substring("o_orderpriority", 1, 1)
    item = (F.when(kind == "1", "Total Revenue").when(kind == "2", "EBITDA").when(kind == "3", "Operating Income")
            .when(kind == "4", "Operating Cash Flow").otherwise("Capital Expenditure"))
    sheet = F.when(kind.isin("1", "2", "3"), "income").otherwise("cashflow")
    end = F.last_day(F.add_months(F.trunc(F.to_date("o_orderdate"), "quarter"), 2))
    return (o.groupBy(F.col("o_custkey").cast("string").alias("entity"), sheet.alias("statement"),
                      end.alias("period_end"), item.alias("item"))
            .agg((F.sum(_cents("o_totalprice")).cast("double")).alias("value")))


def filings(spark, sf_dir) -> DataFrame:
    """entity, form, filed: events as filings; purchases play the current reports."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("entity"),
                    F.when(F.col("event_type") == "purchase", "8-K").otherwise(F.upper("event_type")).alias("form"),
                    F.to_date("ts").alias("filed"))


PCS = ["PC1", "PC2", "PC3", "PC4"]
DIMS = [f"PC{i}" for i in range(1, 65)]


def points(spark, sf_dir) -> DataFrame:
    """entity, cluster, PC1..PC64: all embedding dimensions with their label as cluster."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("entity"), F.col("label").cast("long").alias("cluster"),
                    *[F.col("embedding")[i].cast("double").alias(pc) for i, pc in enumerate(DIMS)])


# ---------------------------------------------------------------------------------------------
# Oracle SQL of the same views: name -> (needed views, body)
# ---------------------------------------------------------------------------------------------
_FEATURE_LIST = ", ".join(FEATURES)
_FLIPPED = "('altman_z','current_ratio','fcf_yield','interest_coverage','accruals_ratio','momentum_30d','momentum_90d')"

SQL_LABEL = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items()) + " ELSE feature END"

SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "prices": ([], """
        SELECT CAST(l_suppkey AS VARCHAR) AS entity, CAST(l_shipdate AS DATE) AS date,
               CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
                 / CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS adj_close,
               CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
        FROM lineitem GROUP BY 1, 2"""),
    "universe": ([], """
        SELECT CAST(s_suppkey AS VARCHAR) AS entity, s_name AS name, r_name AS sector, n_name AS industry,
               s_acctbal AS acctbal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "delistings": (["prices"], f"""
        SELECT entity, DATE '{DELIST_DATE}' AS delist_date, max_by(adj_close, date) * CAST(0.1 AS DOUBLE) AS final_value
        FROM prices WHERE CAST(entity AS BIGINT) % 12 = 0 AND date <= DATE '{DELIST_DATE}' GROUP BY entity"""),
    "holdings": ([], """
        SELECT CAST(s_suppkey AS VARCHAR) AS entity,
               CAST(CAST(ROUND(s_acctbal * 100) AS BIGINT) AS DOUBLE)
                 / CAST(SUM(CAST(ROUND(s_acctbal * 100) AS BIGINT)) OVER () AS DOUBLE) AS weight
        FROM supplier WHERE s_acctbal > 7000"""),
    "quarters": ([], """
        SELECT DISTINCT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date FROM lineitem"""),
    "holdings_pit": (["quarters"], """
        SELECT date, CAST(s_suppkey AS VARCHAR) AS entity,
               CAST(CAST(ROUND(s_acctbal * 100) AS BIGINT) AS DOUBLE)
                 / CAST(SUM(CAST(ROUND(s_acctbal * 100) AS BIGINT)) OVER (PARTITION BY date) AS DOUBLE) AS weight
        FROM supplier, quarters
        WHERE s_acctbal > 3000 AND (s_suppkey + year(date) * 4 + quarter(date)) % 3 = 0"""),
    "universe_pit": (["quarters"], f"""
        SELECT date, CAST(s_suppkey AS VARCHAR) AS entity,
               NOT ((s_suppkey % 12 = 0 AND date > DATE '{DELIST_DATE}')
                    OR (s_suppkey % 9 = 0 AND date < DATE '1996-07-01')) AS in_index
        FROM supplier, quarters"""),
    "ends": ([], """
        SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, CAST(MAX(l_shipdate) AS DATE) AS date
        FROM lineitem GROUP BY 1"""),
    "signals": (["prices"], """
        SELECT entity, date, adj_close, volume,
               CASE WHEN n >= 10 AND p30 > 0 THEN adj_close / p30 - 1 END AS momentum_30d,
               CASE WHEN n >= 10 AND p90 > 0 THEN adj_close / p90 - 1 END AS momentum_90d,
               CASE WHEN n >= 30 THEN vol * sqrt(CAST(252 AS DOUBLE)) END AS volatility_60d,
               CASE WHEN n >= 60 AND v60 > 0 THEN v20 / v60 END AS relative_volume
        FROM (SELECT *, last_value(adj_close) OVER (PARTITION BY entity ORDER BY date
                            RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAY PRECEDING) AS p30,
                     last_value(adj_close) OVER (PARTITION BY entity ORDER BY date
                            RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 90 DAY PRECEDING) AS p90,
                     stddev_samp(ret) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS vol,
                     avg(volume) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v20,
                     avg(volume) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v60
              FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS n,
                           adj_close / lag(adj_close) OVER (PARTITION BY entity ORDER BY date) - 1 AS ret FROM prices))"""),
    "features_pit": (["ends", "signals", "universe"], """
        SELECT b.date, b.entity, u.sector,
               CASE WHEN n % 7 <> 0 THEN CAST(disc AS DOUBLE) / n END AS altman_z,
               CAST(tax AS DOUBLE) / n AS current_ratio,
               CAST(rev AS DOUBLE) / CAST(qty AS DOUBLE) AS net_debt_to_ebitda,
               CAST(ret AS DOUBLE) / n AS fcf_yield,
               CAST(opn AS DOUBLE) / n AS interest_coverage,
               CAST(maxq AS DOUBLE) AS accruals_ratio,
               CAST(rev AS DOUBLE) / CAST(rev4 AS DOUBLE) - 1 AS asset_growth_yoy,
               CAST(n AS DOUBLE) / CAST(n4 AS DOUBLE) - 1 AS net_issuance_yoy,
               CAST(disc % 17 AS DOUBLE) AS short_pct_float,
               g.momentum_30d, g.momentum_90d, g.volatility_60d, g.relative_volume,
               CAST(lines AS DOUBLE) / n AS pe_ratio,
               CAST(rev AS DOUBLE) / n AS ev_to_ebitda,
               CAST(n AS DOUBLE) AS filing_count_90d
        FROM (SELECT s.*, e.date FROM (
                SELECT *, lag(rev, 4) OVER (PARTITION BY entity ORDER BY q) AS rev4,
                          lag(n, 4) OVER (PARTITION BY entity ORDER BY q) AS n4
                FROM (SELECT CAST(l_suppkey AS VARCHAR) AS entity, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q,
                             COUNT(*) AS n, SUM(CAST(l_quantity AS BIGINT)) AS qty,
                             SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS rev,
                             SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS disc,
                             SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) AS tax,
                             COUNT(*) FILTER (l_returnflag = 'R') AS ret, COUNT(*) FILTER (l_linestatus = 'O') AS opn,
                             MAX(l_quantity) AS maxq, SUM(CAST(l_linenumber AS BIGINT)) AS lines
                      FROM lineitem GROUP BY 1, 2)) s JOIN ends e USING (q)) b
        ASOF LEFT JOIN signals g ON b.entity = g.entity AND b.date >= g.date
        LEFT JOIN universe u ON b.entity = u.entity"""),
    # screener mode: sparse rows dropped, medians per date, all-null features 0
    "screen": (["features_pit"], f"""
        SELECT date, entity, sector, {", ".join(
            f"COALESCE({c}, median({c}) OVER (PARTITION BY date), 0.0) AS {c}" for c in FEATURES)}
        FROM (SELECT * FROM features_pit
              WHERE ({" + ".join(f"CAST({c} IS NULL AS INT)" for c in FEATURES)}) / 16.0 <= 0.5)"""),
    "ranks": (["screen"], f"""
        SELECT date, entity, sector, feature, x,
               CASE WHEN feature IN {_FLIPPED} THEN 100 - p ELSE p END AS risk_pct
        FROM (SELECT *, CAST(100 AS DOUBLE) * (2 * rank() OVER (PARTITION BY date, feature ORDER BY x)
                          + count(*) OVER (PARTITION BY date, feature, x) - 1)
                        / (2 * count(*) OVER (PARTITION BY date, feature)) AS p
              FROM (UNPIVOT screen ON {_FEATURE_LIST} INTO NAME feature VALUE x))"""),
    "scores": (["ranks"], """
        SELECT date, entity, sector, composite_score, CAST(100 AS DOUBLE) * num / den AS score_percentile,
               CASE WHEN 100 * num < 20 * den THEN 'Low Risk' WHEN 100 * num < 80 * den THEN 'In Line'
                    ELSE 'Elevated' END AS risk_tier
        FROM (SELECT *, 2 * rank() OVER (PARTITION BY date ORDER BY composite_score)
                        + count(*) OVER (PARTITION BY date, composite_score) - 1 AS num,
                     2 * count(*) OVER (PARTITION BY date) AS den
              FROM (SELECT date, entity, sector, round(avg(risk_pct), 9) AS composite_score
                    FROM ranks GROUP BY date, entity, sector))"""),
    "factor_levels": ([], """
        SELECT l_returnflag || '_' || l_linestatus AS factor, CAST(l_shipdate AS DATE) AS date,
               CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
                 / CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value
        FROM lineitem GROUP BY 1, 2"""),
    "stmt": ([], """
        SELECT CAST(o_custkey AS VARCHAR) AS entity,
               CASE WHEN substr(o_orderpriority, 1, 1) IN ('1','2','3') THEN 'income' ELSE 'cashflow' END AS statement,
               last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Total Revenue' WHEN '2' THEN 'EBITDA'
                    WHEN '3' THEN 'Operating Income' WHEN '4' THEN 'Operating Cash Flow'
                    ELSE 'Capital Expenditure' END AS item,
               CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS value
        FROM orders GROUP BY 1, 2, 3, 4"""),
    "filings": ([], """
        SELECT CAST(user_id AS VARCHAR) AS entity,
               CASE WHEN event_type = 'purchase' THEN '8-K' ELSE upper(event_type) END AS form,
               CAST(ts AS DATE) AS filed FROM events"""),
    "points": ([], f"""
        SELECT vec_id AS entity, CAST(label AS BIGINT) AS cluster, {", ".join(
            f"CAST(embedding[{i + 1}] AS DOUBLE) AS {pc}" for i, pc in enumerate(DIMS))} FROM embeddings"""),
    "centroids": (["points"], f"""
        SELECT cluster, {", ".join(f"avg({pc}) AS c{i + 1}" for i, pc in enumerate(DIMS))} FROM points GROUP BY cluster"""),
}


def squared(left: str, right: str) -> str:
    """Squared distance over all dimensions; the two sides are patterns with {i} for the number of the dimension."""
    return " + ".join(f"({left.format(i=i)} - {right.format(i=i)}) ** 2" for i in range(1, len(DIMS) + 1))


def oracle(needs: str, body: str) -> str:
    """Oracle query with the views it needs as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in SQL_VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1]})" for n in order)
    if not order:
        return body
    return f"WITH {ctes} {body}"        # a body may go on with its own expressions after a comma
