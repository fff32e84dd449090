"""Backtest panel and evaluation queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..config import FEATURES, RunConfig
from ..operators import backtest, evaluate as E
from ..sources.store import Store
from . import series  # noqa: F401  (its oracle views are used below)
from . import views as V
from .registry import query, r6

CFG = RunConfig()
_F = ", ".join(FEATURES)
_FLIP = "('altman_z','current_ratio','fcf_yield','interest_coverage','accruals_ratio','momentum_30d','momentum_90d')"

V.SQL_VIEWS["members"] = (["universe_pit", "ends"], """
    SELECT m.entity, d.as_of FROM (SELECT e.entity, q.as_of FROM (SELECT DISTINCT entity FROM universe_pit) e,
          (SELECT date AS as_of FROM ends) q) d
    ASOF JOIN universe_pit m ON d.entity = m.entity AND d.as_of >= m.date WHERE m.in_index""")
V.SQL_VIEWS["held"] = (["holdings_pit", "ends"], """
    SELECT d.as_of AS date, h.entity, h.weight AS held_weight
    FROM (SELECT date AS as_of FROM ends) d ASOF JOIN (SELECT DISTINCT date FROM holdings_pit) s ON d.as_of >= s.date
    JOIN holdings_pit h ON h.date = s.date""")
V.SQL_VIEWS["pfeat"] = (["features_pit", "members"], f"""
    SELECT d.as_of AS date, f.entity, f.sector, {", ".join("f." + c for c in FEATURES)}
    FROM members d ASOF JOIN features_pit f ON d.entity = f.entity AND d.as_of >= f.date""")
V.SQL_VIEWS["pimp"] = (["pfeat"], f"""
    SELECT * FROM (SELECT date, entity, sector, {", ".join(
        f"COALESCE({c}, median({c}) OVER (PARTITION BY date)) AS {c}" for c in FEATURES)} FROM pfeat)
    WHERE COALESCE({_F}) IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 5""")
V.SQL_VIEWS["pscores"] = (["pimp"], f"""
    SELECT date, entity, sector, composite_score, CAST(100 AS DOUBLE) * num / den AS score_percentile,
           CASE WHEN 100 * num < 20 * den THEN 'Low Risk' WHEN 100 * num < 80 * den THEN 'In Line'
                ELSE 'Elevated' END AS risk_tier
    FROM (SELECT *, 2 * rank() OVER (PARTITION BY date ORDER BY composite_score)
                    + count(*) OVER (PARTITION BY date, composite_score) - 1 AS num,
                 2 * count(*) OVER (PARTITION BY date) AS den
          FROM (SELECT date, entity, any_value(sector) AS sector,
                       round(avg(CASE WHEN feature IN {_FLIP} THEN 100 - p ELSE p END), 9) AS composite_score
                FROM (SELECT *, CAST(100 AS DOUBLE) * (2 * rank() OVER (PARTITION BY date, feature ORDER BY x)
                          + count(*) OVER (PARTITION BY date, feature, x) - 1)
                        / (2 * count(*) OVER (PARTITION BY date, feature)) AS p
                      FROM (UNPIVOT pimp ON {_F} INTO NAME feature VALUE x)) GROUP BY date, entity))""")
V.SQL_VIEWS["period"] = (["path", "ends"], """
    SELECT entity, as_of AS date, CASE WHEN count(*) >= 2 THEN max_by(adj_close, date) / min_by(adj_close, date) - 1 END
           AS period_ret
    FROM (SELECT p.entity, d.as_of, p.date, p.adj_close FROM path p JOIN (
            SELECT date AS as_of, CAST(date + to_months(CAST(greatest(1, date_diff('month', date,
                      lead(date) OVER (ORDER BY date))) AS INT)) AS DATE) AS until,
                   lead(date) OVER (ORDER BY date) AS nxt FROM ends) d
          ON nxt IS NOT NULL AND p.date >= d.as_of AND p.date <= d.until)
    GROUP BY entity, as_of""")
V.SQL_VIEWS["panel"] = (["pscores", "fwd", "held", "period", "delistings"], """
    SELECT s.*, h.entity IS NOT NULL AS is_held, coalesce(h.held_weight, 0) AS held_weight,
           f.fwd_ret_1m, f.fwd_ret_3m, f.fwd_ret_6m, f.fwd_ret_12m, f.fwd_maxdd,
           CAST(f.fwd_maxdd >= 0.25 AS INT) AS label, x.entity IS NOT NULL AS delisted, p.period_ret
    FROM pscores s LEFT JOIN fwd f ON s.entity = f.entity AND s.date = f.as_of
    LEFT JOIN held h ON s.entity = h.entity AND s.date = h.date
    LEFT JOIN period p ON s.entity = p.entity AND s.date = p.date
    LEFT JOIN delistings x ON s.entity = x.entity""")
V.SQL_VIEWS["valid"] = (["panel"], "SELECT * FROM panel WHERE label IS NOT NULL AND composite_score IS NOT NULL")
V.SQL_VIEWS["deciled"] = (["valid"], """
    SELECT *, CAST(greatest(1, ceil((rn - 1) * CAST(10 AS DOUBLE) / (n - 1))) AS BIGINT) AS decile
    FROM (SELECT *, row_number() OVER (ORDER BY composite_score, date, entity) AS rn, count(*) OVER () AS n FROM valid)""")
V.SQL_VIEWS["ic"] = (["panel"], """
    SELECT date, count(*) AS n, CASE WHEN count(*) >= 5 THEN corr(rs, rt) END AS ic FROM (
      SELECT date, rank() OVER (PARTITION BY date ORDER BY composite_score)
                   + (count(*) OVER (PARTITION BY date, composite_score) - 1) / 2 AS rs,
             rank() OVER (PARTITION BY date ORDER BY fwd_maxdd) + (count(*) OVER (PARTITION BY date, fwd_maxdd) - 1) / 2 AS rt
      FROM panel WHERE composite_score IS NOT NULL AND fwd_maxdd IS NOT NULL) GROUP BY date""")

_WILSON = """round(events / n, 6) AS rate,
    round(greatest((p + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 0), 6) AS ci_low,
    round(least((p + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 1), 6) AS ci_high"""


def store(spark, sf_dir) -> Store:
    return Store(features=V.features_pit(spark, sf_dir), prices=V.prices(spark, sf_dir),
                 universe=V.universe_pit(spark, sf_dir), holdings=V.holdings_pit(spark, sf_dir),
                 delistings=V.delistings(spark, sf_dir))


@V.stored
def panel(spark, sf_dir):
    return backtest.build_panel(store(spark, sf_dir), CFG)


@query("backtest_panel", "panel", """
    SELECT date, entity, sector, round(composite_score, 6) AS composite_score,
           round(score_percentile, 6) AS score_percentile, risk_tier, is_held, round(held_weight, 6) AS held_weight,
           round(fwd_ret_6m, 6) AS fwd_ret_6m, round(fwd_maxdd, 6) AS fwd_maxdd, CAST(label AS BIGINT) AS label, delisted,
           round(period_ret, 6) AS period_ret FROM panel""")
def backtest_panel(spark, sf_dir):
    """B1: as-of joins, imputation, scoring and forward labels for every rebalance date in one plan."""
    p = backtest.build_panel(store(spark, sf_dir), CFG)
    return p.select("date", "entity", "sector", r6("composite_score"), r6("score_percentile"), "risk_tier", "is_held",
                    r6("held_weight"), r6("fwd_ret_6m"), r6("fwd_maxdd"), F.col("label").cast("long").alias("label"),
                    "delisted", r6("period_ret"))


@query("window_complete", "panel prices", """
    SELECT date, count(*) AS n, count(*) FILTER (CAST(date + INTERVAL 6 MONTH AS DATE) <= (SELECT max(date) FROM prices)) AS complete
    FROM panel GROUP BY date""")
def window_complete(spark, sf_dir):
    """B1: right-censored windows."""
    return panel(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_if("window_complete").alias("complete"))


@query("lookahead_rows", "features_pit ends", "SELECT CAST(0 AS BIGINT) AS n FROM region LIMIT 1")
def lookahead_rows(spark, sf_dir):
    """B2: no as-of row may be dated after its as-of date."""
    from ..operators import asof
    f = asof.features_asof(V.features_pit(spark, sf_dir),
                           asof.calendar(asof.rebalance_dates(V.features_pit(spark, sf_dir))))
    return backtest.lookahead_rows(f).agg(F.count(F.lit(1)).alias("n"))


@query("decile_hit_rates", "deciled", f"""
    SELECT year, decile, n, events, mean_score, {_WILSON}, n < 5 OR events < 5 AS thin
    FROM (SELECT CAST(year(date) AS BIGINT) AS year, decile, count(*) AS n, CAST(sum(label) AS BIGINT) AS events,
                 CAST(sum(label) AS DOUBLE) / count(*) AS p,
                 CASE WHEN GROUPING(year(date)) = 1 THEN round(avg(composite_score), 6) END AS mean_score
          FROM deciled GROUP BY GROUPING SETS ((decile), (year(date), decile)))""")
def decile_hit_rates(spark, sf_dir):
    """A4-A6, W3."""
    return E.decile_hit_rates(panel(spark, sf_dir)).select(
        F.col("year").cast("long").alias("year"), "decile", "n", "events", r6("mean_score"), r6("rate"), r6("ci_low"),
        r6("ci_high"), "thin")


@query("decile_monotone", "deciled", """
    SELECT bool_and(ok) AS monotone FROM (SELECT rate >= coalesce(lag(rate) OVER (ORDER BY decile), 0) - 1e-9 AS ok
      FROM (SELECT decile, CAST(sum(label) AS DOUBLE) / count(*) AS rate FROM deciled GROUP BY decile))""")
def decile_monotone(spark, sf_dir):
    """A29."""
    return E.is_monotone(E.decile_hit_rates(panel(spark, sf_dir)))


@query("tier_hit_rates", "valid", f"""
    , years AS (SELECT DISTINCT CAST(year(date) AS BIGINT) AS year FROM valid UNION ALL SELECT NULL),
    grid AS (SELECT year, unnest(['Low Risk', 'In Line', 'Elevated']) AS risk_tier FROM years),
    cells AS (SELECT CAST(year(date) AS BIGINT) AS year, risk_tier, count(*) AS n, sum(label) AS events FROM valid
              GROUP BY GROUPING SETS ((risk_tier), (year(date), risk_tier)))
    SELECT year, risk_tier, n, events, {_WILSON}, n < 5 OR events < 5 AS thin
    FROM (SELECT g.year, g.risk_tier, coalesce(c.n, 0) AS n, CAST(coalesce(c.events, 0) AS BIGINT) AS events,
                 CAST(c.events AS DOUBLE) / c.n AS p
          FROM grid g LEFT JOIN cells c ON g.year IS NOT DISTINCT FROM c.year AND g.risk_tier = c.risk_tier)""")
def tier_hit_rates(spark, sf_dir):
    """A7."""
    return E.tier_hit_rates(panel(spark, sf_dir)).select(
        F.col("year").cast("long").alias("year"), "risk_tier", "n", "events", r6("rate"), r6("ci_low"), r6("ci_high"), "thin")


@query("tier_summary", "valid", """
    , r AS (SELECT risk_tier, CAST(sum(label) AS DOUBLE) / count(*) AS rate FROM valid GROUP BY risk_tier)
    SELECT coalesce(l.rate <= m.rate AND m.rate <= h.rate, false) AS monotone, round(h.rate - l.rate, 6) AS spread
    FROM (SELECT rate FROM r WHERE risk_tier = 'Low Risk') l, (SELECT rate FROM r WHERE risk_tier = 'In Line') m,
         (SELECT rate FROM r WHERE risk_tier = 'Elevated') h""")
def tier_summary(spark, sf_dir):
    """Order and spread of the tiers."""
    return E.tier_summary(E.tier_hit_rates(panel(spark, sf_dir))).select("monotone", r6("spread"))


@query("base_rate_rollup", "panel", """
    SELECT CAST(year AS BIGINT) AS year, n, events, round(events / n, 6) AS rate, round(events / years, 6) AS events_per_year
    FROM (SELECT year(date) AS year, count(*) AS n, CAST(sum(label) AS BIGINT) AS events, count(DISTINCT year(date)) AS years
          FROM panel WHERE label IS NOT NULL GROUP BY ROLLUP (year(date)))""")
def base_rate_rollup(spark, sf_dir):
    """A8."""
    return E.base_rates(panel(spark, sf_dir)).select(F.col("year").cast("long").alias("year"), "n", "events", r6("rate"),
                                                     r6("events_per_year"))


@query("threshold_metrics", "valid", """
    , t AS (SELECT unnest(['Low Risk', 'In Line', 'Elevated']) AS tier, unnest([0, 20, 80]) AS lo),
    c AS (SELECT tier, CAST(lo AS BIGINT) AS score_floor, count(*) FILTER (score_percentile >= lo) AS n_flagged,
                 count(*) FILTER (score_percentile >= lo AND label = 1) AS tp, CAST(sum(label) AS BIGINT) AS events, count(*) AS n
          FROM valid, t GROUP BY tier, lo)
    SELECT tier, score_floor, n_flagged, round(tp / n_flagged, 6) AS precision, round(tp / events, 6) AS recall,
           round((tp / n_flagged) / (events / n), 6) AS lift FROM c""")
def threshold_metrics(spark, sf_dir):
    """A9."""
    return E.threshold_metrics(panel(spark, sf_dir)).select("tier", "score_floor", "n_flagged", r6("precision"),
                                                            r6("recall"), r6("lift"))


@query("calibration", "deciled", f"""
    SELECT decile - 1 AS bin, round(m, 6) AS mean_score, round(m / 100, 6) AS predicted, rate AS realized, ci_low, ci_high, n
    FROM (SELECT *, {_WILSON} FROM (SELECT decile, count(*) AS n, CAST(sum(label) AS BIGINT) AS events,
             CAST(sum(label) AS DOUBLE) / count(*) AS p, avg(composite_score) AS m FROM deciled GROUP BY decile))""")
def calibration(spark, sf_dir):
    """A10."""
    return E.calibration(panel(spark, sf_dir)).select("bin", r6("mean_score"), r6("predicted"), r6("realized"),
                                                      r6("ci_low"), r6("ci_high"), "n")


@query("calibration_by_tier", "valid", f"""
    SELECT risk_tier, round(m, 6) AS mean_score, round(m / 100, 6) AS predicted, rate AS realized, ci_low, ci_high, n
    FROM (SELECT *, {_WILSON} FROM (SELECT risk_tier, count(*) AS n, CAST(sum(label) AS BIGINT) AS events,
             CAST(sum(label) AS DOUBLE) / count(*) AS p, avg(composite_score) AS m FROM valid GROUP BY risk_tier))""")
def calibration_by_tier(spark, sf_dir):
    """A10: the block per tier."""
    return E.calibration_by_tier(panel(spark, sf_dir)).select("risk_tier", r6("mean_score"), r6("predicted"), r6("realized"),
                                                              r6("ci_low"), r6("ci_high"), "n")


@query("spearman_ic", "ic", "SELECT date, n, round(ic, 6) AS ic FROM ic")
def spearman_ic(spark, sf_dir):
    """A12, B3."""
    return E.spearman_ic(panel(spark, sf_dir), "fwd_maxdd").select("date", "n", r6("ic"))


@query("newey_west_t", "ic", """
    , x AS (SELECT ic, row_number() OVER (ORDER BY date) AS t, avg(ic) OVER () AS m, count(*) OVER () AS n FROM ic WHERE ic IS NOT NULL),
    l AS (SELECT max(n) AS n, max(m) AS m, greatest(1, least(floor(4 * pow(max(n) / 100, CAST(2 AS DOUBLE) / 9)), max(n) - 1)) AS L FROM x),
    g AS (SELECT a.t - b.t AS k, sum((a.ic - a.m) * (b.ic - b.m)) / max(a.n) AS gamma FROM x a JOIN x b ON a.t >= b.t
          WHERE a.t - b.t <= (SELECT L FROM l) GROUP BY 1),
    v AS (SELECT sum(CASE WHEN k = 0 THEN gamma ELSE 2 * (1 - k / ((SELECT L FROM l) + 1)) * gamma END) AS var FROM g)
    SELECT l.n, round(l.m, 6) AS mean, round(l.m / sqrt(v.var / l.n), 6) AS t_stat, CAST(l.L AS BIGINT) AS lags FROM l, v""")
def newey_west_t(spark, sf_dir):
    """A13, B3."""
    ic = E.spearman_ic(panel(spark, sf_dir), "fwd_maxdd")
    return E.newey_west(ic, "ic").select("n", r6("mean"), r6("t_stat"), "lags")


@query("auc", "valid", """
    SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS events,
           round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auc
    FROM (SELECT label, rank() OVER (ORDER BY composite_score) + (count(*) OVER (PARTITION BY composite_score) - 1) / 2 AS r FROM valid)""")
def auc(spark, sf_dir):
    """A14."""
    return E.auc(panel(spark, sf_dir)).select("n", "events", r6("auc"))


@query("roc", "valid", """
    , steps AS (SELECT composite_score AS s, sum(label) AS pos, count(*) - sum(label) AS neg FROM valid GROUP BY 1),
    cum AS (SELECT s, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q,
                   lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2, row_number() OVER w AS rn
            FROM steps WINDOW w AS (ORDER BY s DESC)),
    kept AS (SELECT *, row_number() OVER (ORDER BY s DESC) AS j, count(*) OVER () AS n FROM cum
             WHERE p > 0 AND q > 0 AND (rn = 1 OR pos2 IS NULL OR pos <> pos2 OR neg <> neg2)),
    pick AS (SELECT DISTINCT (i * n) // (k - 1) AS j FROM (SELECT n, least(60, n + 1) AS k, unnest(range(0, 60)) AS i
             FROM (SELECT max(n) AS n FROM kept)) WHERE i < k)
    SELECT CAST(j AS BIGINT) AS idx, round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr, round(s, 6) AS threshold
    FROM kept WHERE j IN (SELECT j FROM pick)
    UNION ALL SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE)
    WHERE EXISTS (SELECT 1 FROM kept)""")
def roc(spark, sf_dir):
    """Points with collinear ones dropped, sixty at most."""
    return E.roc(panel(spark, sf_dir)).select("idx", r6("fpr"), r6("tpr"), r6("threshold"))


@query("confusion", "panel", """
    SELECT count(*) FILTER (risk_tier = 'Elevated' AND label = 1) AS true_positive,
           count(*) FILTER (risk_tier = 'Elevated' AND label = 0) AS false_positive,
           count(*) FILTER (risk_tier <> 'Elevated' AND label = 1) AS false_negative,
           count(*) FILTER (risk_tier <> 'Elevated' AND label = 0) AS true_negative
    FROM panel WHERE is_held AND label IS NOT NULL""")
def confusion(spark, sf_dir):
    """A11."""
    return E.confusion(panel(spark, sf_dir))


@query("holding_ledger", "panel", """
    SELECT date, entity, round_even(composite_score, 1) AS score, risk_tier AS tier, risk_tier = 'Elevated' AS flagged,
           round(fwd_maxdd, 6) AS fwd_maxdd, label = 1 AS severe,
           CASE WHEN risk_tier = 'Elevated' AND label = 1 THEN 'CAUGHT (true positive)' WHEN risk_tier = 'Elevated' THEN 'false alarm'
                WHEN label = 1 THEN 'MISSED (false negative)' ELSE 'correctly cleared' END AS outcome
    FROM panel WHERE is_held AND label IS NOT NULL""")
def holding_ledger(spark, sf_dir):
    """B4."""
    return E.ledger(panel(spark, sf_dir)).withColumn("fwd_maxdd", r6("fwd_maxdd"))


@query("missed_events", "panel", """
    SELECT date, entity, round_even(composite_score, 1) AS score, risk_tier AS tier, round(fwd_maxdd, 6) AS fwd_maxdd
    FROM panel WHERE is_held AND label = 1 AND risk_tier <> 'Elevated'""")
def missed_events(spark, sf_dir):
    """B4."""
    return E.held_events(panel(spark, sf_dir), caught=False).withColumn("fwd_maxdd", r6("fwd_maxdd"))


@query("score_series", "panel", """
    SELECT date, round(avg(composite_score) FILTER (is_held), 6) AS held_mean, round(avg(composite_score), 6) AS universe_mean,
           count(*) FILTER (is_held) AS n_held FROM panel GROUP BY date HAVING count(*) FILTER (is_held) > 0""")
def score_series(spark, sf_dir):
    """A15."""
    return E.score_series(panel(spark, sf_dir)).select("date", r6("held_mean"), r6("universe_mean"), "n_held")


V.SQL_VIEWS["weights"] = (["panel"], """
    SELECT 'avoid_top_tier' AS strategy, date, entity, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY date) AS weight, period_ret
    FROM panel WHERE period_ret IS NOT NULL AND risk_tier <> 'Elevated'
    UNION ALL SELECT 'long_short', date, entity, CASE risk_tier WHEN 'Low Risk' THEN 0.5 ELSE -0.5 END
               / CAST(count(*) OVER (PARTITION BY date, risk_tier) AS DOUBLE), period_ret
    FROM panel WHERE period_ret IS NOT NULL AND risk_tier IN ('Elevated', 'Low Risk')""")
V.SQL_VIEWS["moves"] = (["weights"], """
    SELECT strategy, i, sum(abs(d)) AS turnover FROM (
      SELECT strategy, i, entity, sum(w) AS d FROM (
        SELECT strategy, i, entity, weight AS w FROM weights JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i
            FROM (SELECT DISTINCT date FROM weights)) USING (date)
        UNION ALL SELECT strategy, i + 1, entity, -weight FROM weights JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i
            FROM (SELECT DISTINCT date FROM weights)) USING (date)) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
V.SQL_VIEWS["strat"] = (["weights", "moves", "panel"], """
    SELECT g.strategy, g.date, g.gross - 0.001 * m.turnover AS ret, m.turnover, b.bench
    FROM (SELECT strategy, date, sum(weight * period_ret) AS gross FROM weights GROUP BY 1, 2) g
    JOIN (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM weights)) o USING (date)
    JOIN moves m ON m.strategy = g.strategy AND m.i = o.i
    JOIN (SELECT date, avg(period_ret) AS bench FROM panel WHERE period_ret IS NOT NULL GROUP BY date) b USING (date)
    UNION ALL SELECT 'benchmark', date, avg(period_ret), NULL, avg(period_ret) FROM panel WHERE period_ret IS NOT NULL GROUP BY date""")


@query("avoid_tier", "strat", """
    SELECT date, round(ret, 6) AS ret, round(turnover, 6) AS turnover, round(bench, 6) AS bench FROM strat WHERE strategy = 'avoid_top_tier'""")
def avoid_tier(spark, sf_dir):
    """B6, W30."""
    return (E.strategy_returns(panel(spark, sf_dir), CFG.cost_bps).where("strategy = 'avoid_top_tier'")
            .select("date", r6("ret"), r6("turnover"), r6("bench")))


@query("long_short", "strat", """
    SELECT date, round(ret, 6) AS ret, round(turnover, 6) AS turnover FROM strat WHERE strategy = 'long_short'""")
def long_short(spark, sf_dir):
    """B7."""
    return (E.strategy_returns(panel(spark, sf_dir), CFG.cost_bps).where("strategy = 'long_short'")
            .select("date", r6("ret"), r6("turnover")))


@query("long_short_by_sector", "panel", """
    , sides AS (SELECT *, count(*) OVER (PARTITION BY date, sector, risk_tier) AS k FROM panel
                WHERE period_ret IS NOT NULL AND risk_tier IN ('Elevated', 'Low Risk')),
    s AS (SELECT *, (SELECT 1) AS one FROM sides),
    n AS (SELECT date, risk_tier, count(DISTINCT sector) AS ns FROM sides GROUP BY 1, 2)
    SELECT date, entity, round(CASE risk_tier WHEN 'Low Risk' THEN 0.5 ELSE -0.5 END / CAST(k * ns AS DOUBLE), 6) AS weight
    FROM s JOIN n USING (date, risk_tier)""")
def long_short_by_sector(spark, sf_dir):
    """Each side split equally over sectors."""
    return (E.strategy_weights(panel(spark, sf_dir), per_sector=True).where("strategy = 'long_short'")
            .select("date", "entity", r6("weight")))


@query("turnover", "strat", """
    SELECT strategy, round(avg(turnover), 6) AS avg_turnover, round(avg(CAST(ret > bench AS INT)), 6) AS hit_rate_vs_bench
    FROM strat GROUP BY strategy""")
def turnover(spark, sf_dir):
    """W30, B8."""
    return E.strategy_summary(panel(spark, sf_dir), CFG).select("strategy", r6("avg_turnover"), r6("hit_rate_vs_bench"))


_STATS = """
    , eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM {src}),
    dd AS (SELECT *, (max(equity) OVER w - equity) / max(equity) OVER w AS drawdown FROM eq
           WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)),
    st AS (SELECT strategy, count(*) AS n, pow(max_by(equity, date), CAST(4 AS DOUBLE) / count(*)) - 1 AS cagr,
                  stddev_samp(ret) * 2 AS vol, avg(ret) * 4 / (stddev_samp(ret) * 2) AS sharpe,
                  max(drawdown) AS max_drawdown, max_by(equity, date) - 1 AS total_return FROM dd GROUP BY strategy)"""


@query("equity_stats", "strat", _STATS.format(src="strat") + """
    SELECT strategy, n, round(cagr, 6) AS cagr, round(vol, 6) AS vol, round(sharpe, 6) AS sharpe,
           round(max_drawdown, 6) AS max_drawdown, round(ln(1 + total_return), 6) AS log_growth FROM st""")
def equity_stats(spark, sf_dir):
    """W15."""
    return E.strategy_summary(panel(spark, sf_dir), CFG).select(
        "strategy", "n", r6("cagr"), r6("vol"), r6("sharpe"), r6("max_drawdown"), r6(F.log1p("total_return"), "log_growth"))


V.SQL_VIEWS["cf"] = (["panel"], """
    SELECT date, s.strategy, CASE WHEN s.strategy = 'actual' THEN a ELSE coalesce(v, a) END AS ret FROM (
      SELECT date, sum(held_weight * period_ret) / sum(held_weight) AS a,
             sum(held_weight * period_ret) FILTER (risk_tier <> 'Elevated')
               / sum(held_weight) FILTER (risk_tier <> 'Elevated') AS v
      FROM panel WHERE is_held AND period_ret IS NOT NULL GROUP BY date),
      (SELECT unnest(['actual', 'avoid_top_tier']) AS strategy) s""")


@query("counterfactual", "cf", _STATS.format(src="cf") + """
    SELECT strategy, round(cagr, 6) AS cagr, round(max_drawdown, 6) AS max_drawdown,
           round(cagr - (SELECT cagr FROM st WHERE strategy = 'actual'), 6) + 0.0 AS delta_cagr,
           round(max_drawdown - (SELECT max_drawdown FROM st WHERE strategy = 'actual'), 6) + 0.0 AS delta_maxdd FROM st""")
def counterfactual(spark, sf_dir):
    """B5."""
    return E.counterfactual(panel(spark, sf_dir), CFG).select("strategy", r6("cagr"), r6("max_drawdown"),
                                                              r6("delta_cagr"), r6("delta_maxdd"))


@query("equity_curve", "strat", _STATS.format(src="strat") + """
    SELECT strategy, date, round(ln(equity), 6) AS log_equity, round(drawdown, 6) AS drawdown FROM dd""")
def equity_curve(spark, sf_dir):
    """The curve itself."""
    rets = E.strategy_returns(panel(spark, sf_dir), CFG.cost_bps)
    return E.equity_curve(rets, ["strategy"]).select("strategy", "date", r6(F.ln("equity"), "log_equity"), r6("drawdown"))


@query("placebo", "panel ic", """
    , r AS (SELECT date, entity, composite_score, fwd_maxdd, row_number() OVER (PARTITION BY date ORDER BY md5(entity || '|0'), entity) AS a,
                   row_number() OVER (PARTITION BY date ORDER BY md5(entity || '|1'), entity) AS b FROM panel WHERE composite_score IS NOT NULL),
    p AS (SELECT x.date, x.fwd_maxdd, y.composite_score FROM r x JOIN r y ON x.date = y.date AND x.a = y.b WHERE x.fwd_maxdd IS NOT NULL),
    k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY composite_score) + (count(*) OVER (PARTITION BY date, composite_score) - 1) / 2 AS rs,
                 rank() OVER (PARTITION BY date ORDER BY fwd_maxdd) + (count(*) OVER (PARTITION BY date, fwd_maxdd) - 1) / 2 AS rt FROM p),
    f AS (SELECT avg(ic) AS fake FROM (SELECT CASE WHEN count(*) >= 5 THEN corr(rs, rt) END AS ic FROM k GROUP BY date)),
    t AS (SELECT avg(ic) AS real FROM ic)
    SELECT round(fake, 6) + 0.0 AS placebo_ic, round(real, 6) + 0.0 AS real_ic, abs(fake) < 0.05 AND abs(real) > abs(fake) + 0.03 AS passed
    FROM f, t""")
def placebo(spark, sf_dir):
    """B10, O9."""
    return E.placebo(panel(spark, sf_dir), "fwd_maxdd").select(r6("placebo_ic"), r6("real_ic"), "passed")


@query("panel_clusters", "panel", """
    SELECT date, count(*) AS n, CASE WHEN count(*) >= 20 THEN count(*) ELSE 0 END AS n_clustered,
           CASE WHEN count(*) >= 20 THEN 3 ELSE 0 END AS n_clusters, true AS all_named FROM panel GROUP BY date""")
def panel_clusters(spark, sf_dir):
    """The run passes the fundamentals gate and fits PCA, clusters and styles of every date with at least 20 names."""
    rows = backtest.build_panel(store(spark, sf_dir), replace(CFG, run_clusters=True, gate=True))
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count("cluster").alias("n_clustered"),
                                    F.countDistinct("cluster").cast("int").alias("n_clusters"),
                                    (F.count("cluster") == F.count("cluster_style")).alias("all_named"))


@query("evaluation_metadata", "panel", """
    SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_snapshots, 'Q' AS rebalance,
           CAST(6 AS BIGINT) AS horizon_months, CAST(0.25 AS DOUBLE) AS dd_threshold, true AS survivorship_safe,
           CAST(10 AS DOUBLE) AS cost_bps FROM panel""")
def evaluation_metadata(spark, sf_dir):
    """B9, B11."""
    meta = E.evaluation(panel(spark, sf_dir), CFG, store(spark, sf_dir).survivorship_safe)["metadata"]()
    return meta.withColumn("horizon_months", F.col("horizon_months").cast("long"))
