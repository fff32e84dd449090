"""Queries on prices, as-of joins, calendars, forward windows, ingest gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DD_HORIZON_MONTHS, HORIZONS, TIMEFRAMES
from ..operators import asof, fundamentals, returns
from ..sources import landed, schema, sinks
from . import views as V
from .registry import query, r6


def quarter_ends(spark, sf_dir):
    return asof.rebalance_dates(V.prices(spark, sf_dir).select("date"), "Q")


def _signals_asof(spark, sf_dir):
    sig = returns.price_signals(V.prices(spark, sf_dir))
    return asof.features_asof(sig, asof.calendar(quarter_ends(spark, sf_dir)), src="px_date")


@query("rebalance_calendar", "prices", """
    SELECT max(date) AS date FROM prices GROUP BY date_trunc('quarter', date)""")
def rebalance_calendar(spark, sf_dir):
    """W13."""
    return quarter_ends(spark, sf_dir)


for _name, _cols in (("momentum_asof", ["momentum_30d", "momentum_90d"]), ("volatility_60", ["volatility_60d"]),
                     ("relative_volume", ["relative_volume"])):
    def _make(cols):
        def run(spark, sf_dir):
            return _signals_asof(spark, sf_dir).select("entity", "as_of", "px_date", *[r6(c) for c in cols])
        run.__module__ = __name__
        return run
    query(_name, "ends signals", f"""
        SELECT s.entity, d.as_of, s.date AS px_date, {", ".join(f"round({c}, 6) AS {c}" for c in _cols)}
        FROM (SELECT e.entity, q.as_of FROM (SELECT DISTINCT entity FROM signals) e, (SELECT date AS as_of FROM ends) q) d
        ASOF JOIN signals s ON d.entity = s.entity AND d.as_of >= s.date""")(_make(_cols))


@query("simple_returns", "prices", """
    SELECT entity, date, round(adj_close / prev - 1, 6) AS ret
    FROM (SELECT *, lag(adj_close) OVER (PARTITION BY entity ORDER BY date) AS prev FROM prices) WHERE prev IS NOT NULL""")
def simple_returns(spark, sf_dir):
    """W5."""
    return returns.simple_returns(V.prices(spark, sf_dir)).select("entity", "date", r6("ret"))


@query("weekly_returns", "prices", """
    SELECT entity, week, round(product(1 + ret) - 1, 6) AS ret FROM (
      SELECT entity, date + CAST((12 - isodow(date)) % 7 AS INT) AS week,
             adj_close / lag(adj_close) OVER (PARTITION BY entity ORDER BY date) - 1 AS ret FROM prices)
    WHERE ret IS NOT NULL GROUP BY entity, week""")
def weekly_returns(spark, sf_dir):
    """A17."""
    rets = returns.simple_returns(V.prices(spark, sf_dir))
    return returns.weekly_returns(rets).select("entity", "week", r6("ret"))


_CHANGE = "value - lag(value) OVER (PARTITION BY factor ORDER BY date)"


@query("weekly_factor_sums", "factor_levels", f"""
    SELECT factor, date + CAST((12 - isodow(date)) % 7 AS INT) AS week, round(coalesce(sum(chg), 0), 6) AS value
    FROM (SELECT *, {_CHANGE} AS chg FROM factor_levels) GROUP BY 1, 2""")
def weekly_factor_sums(spark, sf_dir):
    """A18."""
    levels = V.factor_levels(spark, sf_dir)
    changes = levels.withColumn("value", returns.transform("level_change"))
    return returns.weekly_sums(changes).select("factor", "week", r6("value"))


@query("transforms", "factor_levels", """
    SELECT factor, date, round(value - prev, 6) AS level_change, round(prev - value, 6) + 0.0 AS neg_level_change,
           round(CASE WHEN value > 0 AND prev > 0 THEN ln(value / prev) END, 6) AS log_return,
           round(value / prev - 1, 6) AS pct_change
    FROM (SELECT *, lag(value) OVER (PARTITION BY factor ORDER BY date) AS prev FROM factor_levels)""")
def transforms(spark, sf_dir):
    """W6."""
    kinds = ("level_change", "neg_level_change", "log_return", "pct_change")
    return V.factor_levels(spark, sf_dir).select("factor", "date", *[r6(returns.transform(k), k) for k in kinds])


@query("asof_features", "features_pit", """
    SELECT s.entity, d.as_of, s.date AS src_date, round(pe_ratio, 6) AS pe_ratio
    FROM (SELECT e.entity, m.as_of FROM (SELECT DISTINCT entity FROM features_pit) e,
                 (SELECT DISTINCT last_day(CAST(l_shipdate AS DATE)) AS as_of FROM lineitem) m) d
    ASOF JOIN features_pit s ON d.entity = s.entity AND d.as_of >= s.date""")
def asof_features(spark, sf_dir):
    """Quarterly rows seen from every month end."""
    months = V.table(spark, sf_dir, "lineitem").select(F.last_day(F.to_date("l_shipdate")).alias("date")).distinct()
    facts = V.features_pit(spark, sf_dir).select("entity", "date", "pe_ratio")
    return (asof.features_asof(facts, asof.calendar(months))
            .select("entity", "as_of", "src_date", r6("pe_ratio")))


@query("asof_membership", "universe_pit ends", """
    SELECT m.entity, d.as_of FROM (SELECT e.entity, q.as_of FROM (SELECT DISTINCT entity FROM universe_pit) e,
                 (SELECT date AS as_of FROM ends) q) d
    ASOF JOIN universe_pit m ON d.entity = m.entity AND d.as_of >= m.date WHERE m.in_index""")
def asof_membership(spark, sf_dir):
    """J7."""
    return asof.membership_asof(V.universe_pit(spark, sf_dir), asof.calendar(quarter_ends(spark, sf_dir))) \
        .select("entity", "as_of")


@query("asof_holdings", "holdings_pit ends", """
    SELECT d.as_of, h.entity, h.date AS src_date, round(h.weight, 6) AS weight
    FROM (SELECT date AS as_of FROM ends) d ASOF JOIN (SELECT DISTINCT date FROM holdings_pit) s ON d.as_of >= s.date
    JOIN holdings_pit h ON h.date = s.date""")
def asof_holdings(spark, sf_dir):
    """The whole newest snapshot."""
    return asof.snapshot_asof(V.holdings_pit(spark, sf_dir), asof.calendar(quarter_ends(spark, sf_dir))) \
        .select("as_of", "entity", "src_date", r6("weight"))


@query("price_on_or_before", "prices", """
    SELECT p.entity, d.as_of, p.date AS px_date, round(p.adj_close, 6) AS adj_close
    FROM (SELECT e.entity, m.as_of FROM (SELECT DISTINCT entity FROM prices) e,
                 (SELECT DISTINCT last_day(date) AS as_of FROM prices) m) d
    ASOF JOIN prices p ON d.entity = p.entity AND d.as_of >= p.date""")
def price_on_or_before(spark, sf_dir):
    """J9."""
    px = V.prices(spark, sf_dir)
    months = asof.calendar(px.select(F.last_day("date").alias("date")))
    return asof.price_on_or_before(px.drop("volume"), months).select("entity", "as_of", "px_date", r6("adj_close"))


@query("price_on_or_after", "prices", """
    SELECT p.entity, d.as_of, p.date AS px_date, round(p.adj_close, 6) AS adj_close
    FROM (SELECT e.entity, m.as_of FROM (SELECT DISTINCT entity FROM prices) e,
                 (SELECT DISTINCT last_day(date) AS as_of FROM prices) m) d
    ASOF JOIN prices p ON d.entity = p.entity AND d.as_of <= p.date""")
def price_on_or_after(spark, sf_dir):
    """J9."""
    px = V.prices(spark, sf_dir)
    months = asof.calendar(px.select(F.last_day("date").alias("date")))
    return asof.price_on_or_after(px.drop("volume"), months).select("entity", "as_of", "px_date", r6("adj_close"))


V.SQL_VIEWS["path"] = (["prices", "delistings"], """
    SELECT entity, date, adj_close FROM prices p WHERE NOT EXISTS
      (SELECT 1 FROM delistings x WHERE x.entity = p.entity AND p.date >= x.delist_date)
    UNION ALL SELECT entity, delist_date, final_value FROM delistings""")
V.SQL_VIEWS["win"] = (["path", "ends"], """
    SELECT p.entity, d.date AS as_of, p.date, p.adj_close FROM path p JOIN ends d
    ON p.date >= d.date AND p.date <= CAST(d.date + INTERVAL 12 MONTH AS DATE)""")
V.SQL_VIEWS["fwd"] = (["win"], "SELECT entity, as_of, " + ", ".join(
    f"""CASE WHEN count(*) FILTER (date <= CAST(as_of + INTERVAL {h} MONTH AS DATE)) >= 2
             THEN max_by(adj_close, date) FILTER (date <= CAST(as_of + INTERVAL {h} MONTH AS DATE))
                  / min_by(adj_close, date) - 1 END AS fwd_ret_{h}m""" for h in (1, 3, 6, 12)) + """,
      CASE WHEN count(*) FILTER (date <= CAST(as_of + INTERVAL 6 MONTH AS DATE)) >= 2
           THEN max(dd) FILTER (date <= CAST(as_of + INTERVAL 6 MONTH AS DATE)) END AS fwd_maxdd
    FROM (SELECT *, (peak - adj_close) / peak AS dd FROM (SELECT *, max(adj_close) OVER (PARTITION BY entity, as_of
            ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM win)) GROUP BY entity, as_of""")


def forward(spark, sf_dir):
    return asof.forward_stats(V.prices(spark, sf_dir), quarter_ends(spark, sf_dir), HORIZONS, DD_HORIZON_MONTHS,
                              V.delistings(spark, sf_dir))


@query("forward_return", "fwd", "SELECT entity, as_of, " + ", ".join(
    f"round(fwd_ret_{h}m, 6) AS fwd_ret_{h}m" for h in (1, 3, 6, 12)) + " FROM fwd")
def forward_return(spark, sf_dir):
    """Four horizons from one expansion, delisting-aware."""
    return forward(spark, sf_dir).select("entity", "as_of", *[r6(f"fwd_ret_{h}m") for h in (1, 3, 6, 12)])


@query("forward_maxdd", "fwd", "SELECT entity, as_of, round(fwd_maxdd, 6) AS fwd_maxdd FROM fwd")
def forward_maxdd(spark, sf_dir):
    """W11."""
    return forward(spark, sf_dir).select("entity", "as_of", r6("fwd_maxdd"))


@query("period_return", "path ends", """
    SELECT entity, as_of, CASE WHEN count(*) >= 2 THEN round(max_by(adj_close, date) / min_by(adj_close, date) - 1, 6) END
           AS period_ret
    FROM (SELECT p.entity, d.as_of, p.date, p.adj_close FROM path p JOIN (
            SELECT date AS as_of, CAST(date + to_months(CAST(greatest(1, date_diff('month', date,
                      lead(date) OVER (ORDER BY date))) AS INT)) AS DATE) AS until,
                   lead(date) OVER (ORDER BY date) AS nxt FROM ends) d
          ON nxt IS NOT NULL AND p.date >= d.as_of AND p.date <= d.until)
    GROUP BY entity, as_of""")
def period_return(spark, sf_dir):
    """Return to the next rebalance date; the last date has none."""
    out = forward(spark, sf_dir).select("entity", "as_of", r6("period_ret"))
    last = quarter_ends(spark, sf_dir).agg(F.max("date")).scalar()
    return out.withColumn("_l", last).where(F.col("as_of") < F.col("_l")).drop("_l")


@query("severe_label", "fwd", """
    SELECT entity, as_of, CAST(fwd_maxdd >= 0.25 AS BIGINT) AS label FROM fwd""")
def severe_label(spark, sf_dir):
    """W12."""
    return forward(spark, sf_dir).select("entity", "as_of", (F.col("fwd_maxdd") >= 0.25).cast("long").alias("label"))


@query("business_day_ffill", "factor_levels", """
    , cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM factor_levels),
    dense AS (SELECT f.factor, c.date, v.value FROM (SELECT DISTINCT factor FROM factor_levels) f
              CROSS JOIN (SELECT date FROM cal WHERE isodow(date) < 6) c
              LEFT JOIN factor_levels v ON v.factor = f.factor AND v.date = c.date)
    SELECT factor, date, round(last_value(value IGNORE NULLS) OVER (PARTITION BY factor ORDER BY date
             ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS value FROM dense""")
def business_day_ffill(spark, sf_dir):
    """Monday to Friday calendar, gaps of one row filled."""
    return asof.reindex_ffill(V.factor_levels(spark, sf_dir), "factor", "value", 1).select("factor", "date", r6("value"))


@query("ffill_limit", "prices", """
    , dense AS (SELECT entity, date, CASE WHEN (day(date) + month(date)) % 4 = 0 THEN adj_close END AS adj_close FROM prices)
    SELECT entity, date, round(last_value(adj_close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date
             ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS adj_close FROM dense""")
def ffill_limit(spark, sf_dir):
    """Bounded forward fill over seven rows."""
    gaps = V.prices(spark, sf_dir).select("entity", "date", F.when(
        (F.day("date") + F.month("date")) % 4 == 0, F.col("adj_close")).alias("adj_close"))
    return asof.ffill_limit(gaps, ["entity"], "date", "adj_close", 7).select("entity", "date", r6("adj_close"))


@query("freshness_gate", "prices universe", """
    SELECT count(*) AS wanted, count(*) FILTER (last >= (SELECT max(date) FROM prices) - 5) AS fresh,
           round(count(*) FILTER (last >= (SELECT max(date) FROM prices) - 5) / count(*), 6) AS coverage
    FROM universe LEFT JOIN (SELECT entity, max(date) AS last FROM prices GROUP BY entity) USING (entity)""")
def freshness_gate(spark, sf_dir):
    """S13."""
    px = V.prices(spark, sf_dir)
    return landed.freshness(px, V.universe(spark, sf_dir), px.agg(F.max("date")).scalar()) \
        .select("wanted", "fresh", r6("coverage"))


@query("refresh_merge", "prices", """
    , new AS (SELECT entity, date, adj_close * 2 AS adj_close FROM prices
              WHERE CAST(entity AS BIGINT) % 5 = 0 AND date >= DATE '1999-01-01')
    SELECT entity, date, round(adj_close, 6) AS adj_close FROM prices WHERE entity NOT IN (SELECT entity FROM new)
    UNION ALL SELECT entity, date, round(adj_close, 6) FROM new""")
def refresh_merge(spark, sf_dir):
    """Refreshed entities are replaced whole."""
    prior = V.prices(spark, sf_dir).drop("volume")
    new = (prior.where((F.col("entity").cast("long") % 5 == 0) & (F.col("date") >= F.lit("1999-01-01").cast("date")))
           .withColumn("adj_close", F.col("adj_close") * 2))
    return landed.merge_refresh(prior, new).select("entity", "date", r6("adj_close"))


@query("missing_keys", "universe holdings_pit", """
    SELECT entity FROM universe EXCEPT SELECT entity FROM holdings_pit""")
def missing_keys(spark, sf_dir):
    """S12, O6."""
    return landed.missing_keys(V.universe(spark, sf_dir), V.holdings_pit(spark, sf_dir))


@query("key_sets", "universe holdings", """
    SELECT 'union' AS op, count(*) AS n FROM (SELECT entity FROM universe UNION SELECT entity FROM holdings)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT entity FROM universe INTERSECT SELECT entity FROM holdings)""")
def key_sets(spark, sf_dir):
    """O4, O5."""
    u, h = V.universe(spark, sf_dir), V.holdings(spark, sf_dir)
    count = lambda df, name: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return count(landed.union_keys(u, h), "union").union(count(landed.intersect_keys(u, h), "intersect"))


@query("pad_universe", "universe holdings", """
    , part_u AS (SELECT entity, name, sector, industry FROM universe WHERE sector <> 'ASIA')
    SELECT * FROM part_u UNION ALL SELECT entity, entity, 'Unknown', 'Unknown' FROM holdings
    WHERE entity NOT IN (SELECT entity FROM part_u)""")
def pad_universe(spark, sf_dir):
    """Holdings outside the (reduced) universe are appended."""
    u = V.universe(spark, sf_dir).where("sector <> 'ASIA'").drop("acctbal")
    return landed.pad_universe(u, V.holdings(spark, sf_dir))


@query("unpivot_prices", "prices", """
    SELECT CAST(year(date) AS VARCHAR) AS entity, date, round(avg(adj_close), 6) AS adj_close, sum(volume) AS volume
    FROM prices GROUP BY 1, 2""")
def unpivot_prices(spark, sf_dir):
    """A wide KEY|Field table, one key per year, back to long rows."""
    px = V.prices(spark, sf_dir)
    years = [str(r["y"]) for r in px.select(F.year("date").alias("y")).distinct().orderBy("y").collect()]  # bounded by the calendar
    wide = px.groupBy("date").agg(*[
        agg.alias(f"{y}|{f}") for y in years for f, agg in (
            ("Close", F.avg(F.when(F.year("date") == int(y), F.col("adj_close")))),
            ("Volume", F.sum(F.when(F.year("date") == int(y), F.col("volume")))))])
    return landed.unpivot_prices(wide).select("entity", "date", r6("adj_close"), "volume")


@query("duplicate_keys", "", """
    SELECT CAST(l_suppkey AS VARCHAR) AS entity, CAST(l_shipdate AS DATE) AS date, count(*) AS n
    FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    """S5."""
    li = V.table(spark, sf_dir, "lineitem")
    return schema.duplicate_keys(li.select(F.col("l_suppkey").cast("string").alias("entity"),
                                           F.to_date("l_shipdate").alias("date")), ["entity", "date"])


@query("coercion_counts", "", """
    SELECT count(*) AS n, count(TRY_CAST(replace(event_type, 'error', '2024-01-05') AS DATE)) AS dates,
           count(TRY_CAST(replace(event_type, 'click', '3.5') AS DOUBLE)) AS numbers,
           count(DISTINCT replace(upper(trim(event_type)), '.', '-')) AS keys
    FROM events""")
def coercion_counts(spark, sf_dir):
    """What survives coercion."""
    from ..functions.expr import normalize_key
    e = V.table(spark, sf_dir, "events").withColumn("d", F.replace("event_type", F.lit("error"), F.lit("2024-01-05")))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count(schema.to_day(e, "d")).alias("dates"),
                 F.count(schema.to_number(F.replace("event_type", F.lit("click"), F.lit("3.5")))).alias("numbers"),
                 F.countDistinct(normalize_key("event_type")).alias("keys"))


@query("json_decode", "stmt", "SELECT entity, statement, period_end, item, value FROM stmt")
def json_decode(spark, sf_dir):
    """Statements through their JSON form and back."""
    docs = landed.encode_statements(V.stmt(spark, sf_dir))
    wide = docs.groupBy("entity").agg(*[F.max(F.when(F.col("statement") == s, F.col("json"))).alias(s)
                                        for s in ("income", "cashflow")])
    return landed.decode_statements(wide, {"income": "income", "cashflow": "cashflow"})


@query("props_decode", "", """
    SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k
    FROM events GROUP BY event_type""")
def props_decode(spark, sf_dir):
    """JSON payload column."""
    k = F.from_json("props", "k bigint")["k"]
    return V.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("event_count_90d", "filings", """
    , days AS (SELECT DATE '2024-01-15' AS as_of UNION ALL SELECT DATE '2024-01-31' UNION ALL SELECT DATE '2024-04-10')
    SELECT k.entity, d.as_of, count(f.entity) AS n
    FROM (SELECT DISTINCT entity FROM filings) k CROSS JOIN days d
    LEFT JOIN filings f ON f.entity = k.entity AND f.form = '8-K' AND f.filed <= d.as_of AND f.filed >= d.as_of - 90
    GROUP BY 1, 2""")
def event_count_90d(spark, sf_dir):
    """known entities without events give 0."""
    f = V.filings(spark, sf_dir)
    dates = F.array(*[F.lit(d).cast("date") for d in ("2024-01-15", "2024-01-31", "2024-04-10")])
    return fundamentals.trailing_event_count(f, f.select("entity").distinct(), dates).select("entity", "as_of", "n")


@query("timeframe_windows", "prices", """
    , bounds AS (SELECT max(date) AS hi FROM prices),
    tf AS (SELECT 'ytd' AS timeframe, CAST(date_trunc('year', hi) AS DATE) AS start FROM bounds
           UNION ALL SELECT '6m', CAST(hi - INTERVAL 6 MONTH AS DATE) FROM bounds
           UNION ALL SELECT '1y', CAST(hi - INTERVAL 12 MONTH AS DATE) FROM bounds
           UNION ALL SELECT '2y', CAST(hi - INTERVAL 24 MONTH AS DATE) FROM bounds
           UNION ALL SELECT 'max', DATE '1900-01-01')
    SELECT timeframe, count(DISTINCT date) AS n_days, min(date) AS first_day FROM tf JOIN prices ON date >= start
    GROUP BY timeframe HAVING count(DISTINCT date) >= 30""")
def timeframe_windows(spark, sf_dir):
    """Inclusive named windows, short ones skipped."""
    rows = returns.by_timeframe(V.prices(spark, sf_dir).select("date").distinct(), TIMEFRAMES)
    return (rows.groupBy("timeframe").agg(F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_day"))
            .where("n_days >= 30"))


V.SQL_VIEWS["rets"] = (["prices"], """
    SELECT entity, date, ret FROM (SELECT entity, date,
        adj_close / lag(adj_close) OVER (PARTITION BY entity ORDER BY date) - 1 AS ret FROM prices) WHERE ret IS NOT NULL""")
V.SQL_VIEWS["port"] = (["rets", "holdings"], """
    SELECT date, coalesce(sum(weight * ret), 0)
                 / (SELECT sum(weight) FROM holdings WHERE entity IN (SELECT entity FROM rets)) AS ret
    FROM rets LEFT JOIN holdings USING (entity) GROUP BY date""")
V.SQL_VIEWS["bench"] = (["rets"], "SELECT date, avg(ret) AS ret FROM rets GROUP BY date")


def portfolio(spark, sf_dir):
    return returns.portfolio_returns(returns.simple_returns(V.prices(spark, sf_dir)), V.holdings(spark, sf_dir))


def benchmark(spark, sf_dir):
    return returns.simple_returns(V.prices(spark, sf_dir)).groupBy("date").agg(F.avg("ret").alias("ret"))


@query("portfolio_return", "port", "SELECT date, round(ret, 6) AS ret FROM port")
def portfolio_return(spark, sf_dir):
    """A16."""
    return portfolio(spark, sf_dir).select("date", r6("ret"))


@query("excess_return", "port factor_levels", """
    , rf AS (SELECT date, value / 10000 / 100 / 252 AS rf FROM factor_levels WHERE factor = 'R_F'),
    joined AS (SELECT p.date, p.ret, rf.rf FROM port p LEFT JOIN rf USING (date))
    SELECT date, round(ret - coalesce(last_value(rf IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 0), 6) AS ret
    FROM joined""")
def excess_return(spark, sf_dir):
    """G13."""
    rf = V.factor_levels(spark, sf_dir).where("factor = 'R_F'").select("date", (F.col("value") / 10000).alias("value"))
    return returns.excess_returns(portfolio(spark, sf_dir), rf).select("date", r6("ret"))


@query("min_observations", "rets", """
    SELECT entity, count(*) AS n FROM rets GROUP BY entity HAVING count(*) >= 500""")
def min_observations(spark, sf_dir):
    """P7."""
    kept = returns.min_observations(returns.simple_returns(V.prices(spark, sf_dir)), 500)
    return kept.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("tail_export", "port", """
    SELECT date, round(ret, 6) AS ret FROM port ORDER BY date DESC LIMIT 504""")
def tail_export(spark, sf_dir):
    """K6."""
    return sinks.tail(portfolio(spark, sf_dir)).select("date", r6("ret"))


@query("snapshot_dates", "prices", """
    SELECT CAST(max(date) - 91 * k AS DATE) AS date FROM prices, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY k""")
def snapshot_dates(spark, sf_dir):
    """The last date and three predecessors 91 days apart."""
    last = V.prices(spark, sf_dir).agg(F.max("date").alias("d"))
    return last.select(F.explode(asof.step_back(F.col("d"), 4, 91)).alias("date"))
