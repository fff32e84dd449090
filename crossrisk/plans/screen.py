"""Screener queries: gates, cleaning, ranking, scoring, tiers, drivers, peers, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FEATURES, TIER_LABELS
from ..functions import expr as X
from ..operators import clean, order_stats, report, scoring
from . import views as V
from .registry import query, r6


@V.stored
def screened(spark, sf_dir):
    return clean.impute_median(V.features_pit(spark, sf_dir), FEATURES, ["date"], "screener")


@V.stored
def ranks(spark, sf_dir):
    return scoring.feature_ranks(screened(spark, sf_dir), ["date"], cols=FEATURES)


@V.stored
def scores(spark, sf_dir):
    out = scoring.score(screened(spark, sf_dir), ["date"], cols=FEATURES, keep_ranks=False)
    return out.join(V.universe(spark, sf_dir).select("entity", "sector"), "entity", "left")


@query("screen_scores", "scores", """
    SELECT date, entity, round(composite_score, 6) AS composite_score,
           round(score_percentile, 6) AS score_percentile, risk_tier FROM scores""")
def screen_scores(spark, sf_dir):
    """Cleaned cross-sections scored at every quarter end."""
    out = scoring.score(screened(spark, sf_dir), ["date"], cols=FEATURES, keep_ranks=False)
    return out.select("date", "entity", r6("composite_score"), r6("score_percentile"), "risk_tier")


@query("tiers", "scores", """
    SELECT date, risk_tier, count(*) AS n, round(avg(composite_score), 6) AS mean_score
    FROM scores GROUP BY date, risk_tier""")
def tiers(spark, sf_dir):
    return (scores(spark, sf_dir).groupBy("date", "risk_tier")
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("composite_score"), "mean_score")))


@query("impute_median", "features_pit screen", f"""
    SELECT s.date, s.entity, {", ".join(f"round(s.{c}, 6) AS {c}" for c in FEATURES)},
           CAST({" + ".join(f"CAST(f.{c} IS NULL AS INT)" for c in FEATURES)} AS BIGINT) AS n_imputed
    FROM screen s JOIN features_pit f USING (date, entity)""")
def impute_median(spark, sf_dir):
    """A1, A2: filled values and how many of the row were missing."""
    raw = V.features_pit(spark, sf_dir)
    mask = clean.imputation_mask(raw, FEATURES, ["date", "entity"])
    n = sum((F.col(f"m.{c}").cast("long") for c in FEATURES[1:]), F.col(f"m.{FEATURES[0]}").cast("long"))
    filled = clean.impute_median(raw, FEATURES, ["date"], "screener")
    return (filled.alias("f").join(mask.alias("m"), ["date", "entity"])
            .select("date", "entity", *[r6(F.col(f"f.{c}"), c) for c in FEATURES], n.alias("n_imputed")))


@query("coverage_report", "features_pit", """
    SELECT date, count(DISTINCT entity) AS n_entities, count(DISTINCT entity) < 10 AS thin FROM features_pit GROUP BY date""")
def coverage_report(spark, sf_dir):
    """S19."""
    n = F.countDistinct("entity")
    return V.features_pit(spark, sf_dir).groupBy("date").agg(n.alias("n_entities"), (n < 10).alias("thin"))


@query("feature_coverage", "features_pit", " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, count(*) AS n, count({c}) AS non_null, round(count({c}) / count(*), 6) AS coverage
    FROM features_pit""" for c in FEATURES))
def feature_coverage(spark, sf_dir):
    """A28."""
    return (clean.coverage(V.features_pit(spark, sf_dir), FEATURES)
            .select("feature", "n", "non_null", r6("coverage")))


@query("drivers_topk", "ranks", """
    SELECT date, entity, feature, round(risk_pct, 6) AS risk_pct, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY date, entity ORDER BY risk_pct DESC, feature) AS rank FROM ranks)
    WHERE rank <= 3""")
def drivers_topk(spark, sf_dir):
    """W24."""
    return (scoring.drivers(ranks(spark, sf_dir), ["date"])
            .select("date", "entity", "feature", r6("risk_pct"), F.col("rank").cast("long").alias("rank")))


@query("safest_features", "ranks", """
    SELECT date, entity, feature, round(risk_pct, 6) AS risk_pct, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY date, entity ORDER BY risk_pct, feature) AS rank FROM ranks)
    WHERE rank <= 3""")
def safest_features(spark, sf_dir):
    """O3."""
    return (scoring.safest(ranks(spark, sf_dir), ["date"])
            .select("date", "entity", "feature", r6("risk_pct"), F.col("rank").cast("long").alias("rank")))


@query("driver_text", "ranks", """
    SELECT date, entity, string_agg(feature || '(' || CAST(CAST(round_even(risk_pct, 0) AS BIGINT) AS VARCHAR) || ')',
                                    '; ' ORDER BY rank) AS drivers
    FROM (SELECT *, row_number() OVER (PARTITION BY date, entity ORDER BY risk_pct DESC, feature) AS rank FROM ranks)
    WHERE rank <= 3 GROUP BY date, entity""")
def driver_text(spark, sf_dir):
    """F15."""
    return scoring.driver_text(scoring.drivers(ranks(spark, sf_dir), ["date"]), ["date"])


@query("humanized_drivers", "ranks", f"""
    SELECT date, entity, string_agg({V.SQL_LABEL} || ' ' || CAST(p AS VARCHAR)
             || CASE WHEN p % 100 IN (11, 12, 13) THEN 'th' WHEN p % 10 = 1 THEN 'st' WHEN p % 10 = 2 THEN 'nd'
                     WHEN p % 10 = 3 THEN 'rd' ELSE 'th' END || ' pct', ' · ' ORDER BY rank) AS drivers
    FROM (SELECT *, CAST(round_even(risk_pct, 0) AS BIGINT) AS p,
                 row_number() OVER (PARTITION BY date, entity ORDER BY risk_pct DESC, feature) AS rank FROM ranks)
    WHERE rank <= 3 GROUP BY date, entity""")
def humanized_drivers(spark, sf_dir):
    """labels and ordinals instead of codes."""
    text = scoring.driver_text(scoring.drivers(ranks(spark, sf_dir), ["date"]), ["date"])
    return text.withColumn("drivers", X.humanize_drivers("drivers"))


@query("opportunity_screen", "screen", """
    SELECT date, entity, contrarian, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY date ORDER BY contrarian DESC, entity) AS rank FROM (
        SELECT date, entity,
               round(CAST(100 AS DOUBLE) * (2 * rank() OVER (PARTITION BY date ORDER BY short_pct_float)
                     + count(*) OVER (PARTITION BY date, short_pct_float) - 1) / (2 * count(*) OVER (PARTITION BY date))
                   - CAST(100 AS DOUBLE) * (2 * rank() OVER (PARTITION BY date ORDER BY momentum_90d)
                     + count(*) OVER (PARTITION BY date, momentum_90d) - 1) / (2 * count(*) OVER (PARTITION BY date)), 6)
               AS contrarian
        FROM screen WHERE altman_z > 2 AND accruals_ratio > 0.7 AND short_pct_float > 8 AND momentum_90d < 0))
    WHERE rank <= 25""")
def opportunity_screen(spark, sf_dir):
    """P5, O2."""
    return (scoring.opportunity_screen(screened(spark, sf_dir), ["date"])
            .select("date", "entity", r6("contrarian"), F.col("rank").cast("long").alias("rank")))


@query("sector_peer_delta", "scores", """
    SELECT a.date, a.entity, a.sector, round(median(b.composite_score), 6) AS sector_median,
           round(any_value(a.composite_score) - median(b.composite_score), 6) AS sector_delta
    FROM scores a LEFT JOIN scores b ON a.date = b.date AND a.sector = b.sector AND a.entity <> b.entity
    GROUP BY a.date, a.entity, a.sector""")
def sector_peer_delta(spark, sf_dir):
    """Median of the peers without the own score."""
    return (scoring.sector_comparison(scores(spark, sf_dir), ["date"])
            .select("date", "entity", "sector", r6("sector_median"), r6("sector_delta")))


@query("sector_percentile", "scores", """
    SELECT date, entity, CASE WHEN count(*) OVER (PARTITION BY date, sector) >= 2 THEN
             round(CAST(100 AS DOUBLE) * (2 * (rank() OVER (PARTITION BY date, sector ORDER BY composite_score) - 1)
                    + count(*) OVER (PARTITION BY date, sector, composite_score))
                   / (2 * count(*) OVER (PARTITION BY date, sector)), 6) END AS sector_percentile
    FROM scores""")
def sector_percentile(spark, sf_dir):
    """W27."""
    return (scoring.sector_percentile(scores(spark, sf_dir), ["date"])
            .select("date", "entity", r6("sector_percentile")))


@query("strict_percentile", "scores", """
    SELECT date, entity, round(CAST(100 AS DOUBLE) * (rank() OVER (PARTITION BY date ORDER BY composite_score) - 1)
           / count(*) OVER (PARTITION BY date), 6) AS strict_pct FROM scores""")
def strict_percentile(spark, sf_dir):
    """W26."""
    return (order_stats.strict_pct(scores(spark, sf_dir), ["date"], "composite_score", "strict_pct")
            .select("date", "entity", r6("strict_pct")))


@query("sector_distribution", "scores", """
    SELECT date, sector, count(*) AS n, round(quantile_cont(composite_score, 0.25), 6) AS q1,
           round(median(composite_score), 6) AS median, round(quantile_cont(composite_score, 0.75), 6) AS q3,
           round(min(composite_score), 6) AS lo, round(max(composite_score), 6) AS hi
    FROM scores GROUP BY date, sector""")
def sector_distribution(spark, sf_dir):
    """A22."""
    out = report.sector_distribution(scores(spark, sf_dir), ["date"])
    return out.select("date", "sector", "n", *[r6(c) for c in ("q1", "median", "q3", "lo", "hi")])


@query("histogram", "scores", """
    SELECT bin, count(*) AS n FROM (
      SELECT CAST(least(floor((composite_score - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin
      FROM scores, (SELECT min(composite_score) AS lo, max(composite_score) AS hi FROM scores)) GROUP BY bin""")
def histogram(spark, sf_dir):
    """A23."""
    return report.histogram(scores(spark, sf_dir), "composite_score", 40)


@query("tier_cut_values", "scores", """
    SELECT date, round(quantile_cont(composite_score, 0.2), 6) AS low_cut,
           round(quantile_cont(composite_score, 0.8), 6) AS high_cut FROM scores GROUP BY date""")
def tier_cut_values(spark, sf_dir):
    """Tier bounds mapped back to scores."""
    q = order_stats.quantiles(scores(spark, sf_dir), ["date"], "composite_score", {"low_cut": 0.2, "high_cut": 0.8})
    return q.select("date", r6("low_cut"), r6("high_cut"))


@query("headline_stats", "scores holdings", """
    SELECT date, round(sum(weight * composite_score) / sum(weight), 6) AS weighted_score,
           count(*) FILTER (risk_tier = 'Elevated') AS n_elevated, count(*) AS n_held
    FROM scores JOIN holdings USING (entity) GROUP BY date""")
def headline_stats(spark, sf_dir):
    """A24, P2, J4."""
    return (report.headline(scores(spark, sf_dir), V.holdings(spark, sf_dir), ["date"])
            .select("date", r6("weighted_score"), "n_elevated", "n_held"))


@query("sector_rollup", "scores holdings", """
    SELECT date, sector, count(*) AS n, round(sum(weight), 6) AS weight FROM scores JOIN holdings USING (entity)
    GROUP BY date, sector""")
def sector_rollup(spark, sf_dir):
    """A26."""
    held = scores(spark, sf_dir).join(V.holdings(spark, sf_dir), "entity")
    return report.sector_rollup(held, ["date"]).select("date", "sector", "n", r6("weight"))


@query("sector_peers", "scores", """
    SELECT date, sector, entity, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY composite_score DESC, entity) AS rank FROM scores)
    WHERE rank <= 15""")
def sector_peers(spark, sf_dir):
    """The fifteen riskiest names of each sector."""
    return (scoring.top_k(scores(spark, sf_dir), ["date", "sector"], [F.col("composite_score").desc(), F.col("entity")], 15)
            .select("date", "sector", "entity", F.col("rank").cast("long").alias("rank")))


@query("universe_search", "scores universe", """
    SELECT date, entity, name, s.sector, round(composite_score, 6) AS composite_score
    FROM scores s JOIN universe u USING (entity)
    WHERE contains(lower(name), '7') AND risk_tier IN ('Elevated', 'In Line')
    ORDER BY composite_score DESC NULLS LAST, entity, date LIMIT 50 OFFSET 20""")
def universe_search(spark, sf_dir):
    """Substring and tier filter, nulls last, one page."""
    rows = scores(spark, sf_dir).join(V.universe(spark, sf_dir).drop("sector"), "entity")
    page = report.search(rows, text="7", columns=["name"], isin={"risk_tier": ["Elevated", "In Line"]},
                         order=[F.col("composite_score").desc_nulls_last(), F.col("entity"), F.col("date")],
                         page=20, size=50, offset=True)
    return page.select("date", "entity", "name", "sector", r6("composite_score"))


@query("riskiest", "scores", """
    SELECT date, entity, round(composite_score, 6) AS composite_score FROM scores
    ORDER BY composite_score DESC, date, entity LIMIT 5""")
def riskiest(spark, sf_dir):
    """O2, A report of the five riskiest rows."""
    return report.head(scores(spark, sf_dir), [F.col("composite_score").desc(), F.col("date"), F.col("entity")], 5) \
        .select("date", "entity", r6("composite_score"))


@query("holdings_report", "scores ranks holdings", """
    SELECT h.entity, round(h.weight, 6) AS weight, coalesce(r.status, 'NOT_IN_UNIVERSE') AS status,
           round(r.composite_score, 6) AS composite_score, round(r.score_percentile, 6) AS score_percentile, r.risk_tier,
           r.drivers, round(r.composite_score - p.m, 6) AS sector_delta
    FROM holdings h
    LEFT JOIN (SELECT s.*, 'OK' AS status, d.drivers FROM scores s
               JOIN (SELECT date, entity, string_agg(feature || '(' || CAST(CAST(round_even(risk_pct, 0) AS BIGINT) AS VARCHAR) || ')',
                                    '; ' ORDER BY rank) AS drivers
                     FROM (SELECT *, row_number() OVER (PARTITION BY date, entity ORDER BY risk_pct DESC, feature) AS rank FROM ranks)
                     WHERE rank <= 3 GROUP BY date, entity) d USING (date, entity)
               WHERE date = (SELECT max(date) FROM scores)) r ON h.entity = r.entity
    LEFT JOIN (SELECT a.entity, median(b.composite_score) AS m FROM scores a
               JOIN scores b ON a.date = b.date AND a.sector = b.sector AND a.entity <> b.entity
               WHERE a.date = (SELECT max(date) FROM scores) GROUP BY a.entity) p ON h.entity = p.entity""")
def holdings_report(spark, sf_dir):
    """One row per holding at the latest date, with drivers and sector comparison."""
    s, rk = scores(spark, sf_dir), ranks(spark, sf_dir)
    s = s.withColumn("_last", s.agg(F.max("date")).scalar()).where(F.col("date") == F.col("_last")).drop("_last")
    rk = rk.join(s.select("date", "entity"), ["date", "entity"], "left_semi")
    out = report.holdings_report(V.holdings(spark, sf_dir), s, rk)
    return out.select("entity", r6("weight"), "status", r6("composite_score"), r6("score_percentile"), "risk_tier",
                      "drivers", r6("sector_delta"))


@query("universe_export", "scores holdings", """
    SELECT s.date, s.entity, s.sector, round(composite_score, 6) AS composite_score, risk_tier,
           h.entity IS NOT NULL AS is_portfolio, round(coalesce(h.weight, 0), 6) AS weight
    FROM scores s LEFT JOIN holdings h USING (entity)""")
def universe_export(spark, sf_dir):
    """K4, J3, P2."""
    out = report.attach_holdings(scores(spark, sf_dir), V.holdings(spark, sf_dir))
    return out.select("date", "entity", "sector", r6("composite_score"), "risk_tier", "is_portfolio", r6("weight"))


@query("run_metadata", "scores", """
    SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT date) AS n_dates,
           max(date) AS freshest, count(*) FILTER (risk_tier = 'Low Risk') AS n_low,
           count(*) FILTER (risk_tier = 'In Line') AS n_in_line, count(*) FILTER (risk_tier = 'Elevated') AS n_elevated
    FROM scores""")
def run_metadata(spark, sf_dir):
    """K7: one row of counts."""
    tier = lambda t: F.count_if(F.col("risk_tier") == t)
    return scores(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity").alias("n_entities"),
        F.countDistinct("date").alias("n_dates"), F.max("date").alias("freshest"),
        *[tier(t).alias(a) for t, a in zip(TIER_LABELS, ("n_low", "n_in_line", "n_elevated"))])


@query("combined_label", "scores", """
    SELECT date, entity, risk_tier || ' · ' || CAST(CAST(round_even(score_percentile, 0) AS BIGINT) AS VARCHAR)
           || 'th pct' AS label FROM scores""")
def combined_label(spark, sf_dir):
    """F15."""
    return scores(spark, sf_dir).select("date", "entity", X.combined_label("risk_tier", "score_percentile").alias("label"))
