"""Evaluation of a backtest panel: hit rates, information coefficients, ROC, calibration, strategies.

Statistics over the panel are partial aggregates.  Series keyed by date are bounded by the calendar, and only those
are ever ordered in one task or held in one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import BOTTOM_TIER, MIN_EVENTS, RunConfig, TIERS, TIER_LABELS, TOP_TIER
from ..functions.expr import wilson
from .gram import keyed
from .order_stats import mid_rank, pooled_deciles, positions, row_numbers, value_table, with_ranks

DECILE_ORDER = ("composite_score", "date", "entity")


def labelled(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("label").isNotNull() & F.col("composite_score").isNotNull())


# ---- hit rates --------------------------------------------------------------------------------

def hit_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("events")]


def with_rates(df: DataFrame) -> DataFrame:
    """Rate, Wilson interval and thin-sample flag from ``n`` and ``events`` (A4, A5)."""
    rate, lo, hi = wilson("events", "n")
    return df.select("*", rate.alias("rate"), lo.alias("ci_low"), hi.alias("ci_high"),
                     ((F.col("n") < MIN_EVENTS) | (F.col("events") < MIN_EVENTS)).alias("thin"))


def decile_hit_rates(panel: DataFrame) -> DataFrame:
    """Hit rates per score decile, pooled (year null) and per year; deciles are cut once on the pooled panel."""
    rows = pooled_deciles(labelled(panel), DECILE_ORDER).withColumn("year", F.year("date"))
    cells = rows.groupingSets([["decile"], ["year", "decile"]], "year", "decile").agg(
        *hit_columns(), F.avg("composite_score").alias("_m"))
    return with_rates(cells.withColumn("mean_score", F.when(F.col("year").isNull(), F.col("_m"))).drop("_m"))


def is_monotone(rates: DataFrame) -> DataFrame:
    """Whether each pooled decile rate is at least the previous one (A29); ten rows at most."""
    prev = F.lag("rate").over(W.orderBy("decile"))
    step = rates.where("year IS NULL").select((prev.isNull() | (F.col("rate") >= prev - 1e-9)).alias("ok"))
    return step.agg(F.bool_and("ok").alias("monotone"))


def tier_hit_rates(panel: DataFrame) -> DataFrame:
    """Hit rates per tier, pooled and per year; empty tiers are kept."""
    rows = labelled(panel).withColumn("year", F.year("date"))
    cells = rows.groupingSets([["risk_tier"], ["year", "risk_tier"]], "year", "risk_tier").agg(*hit_columns())
    years = rows.select("year").distinct().union(rows.select(F.lit(None).cast("int")).limit(1))
    grid = years.withColumn("risk_tier", F.explode(F.array(*[F.lit(t) for t in TIER_LABELS])))
    full = grid.join(cells, grid["year"].eqNullSafe(cells["year"]) & (grid["risk_tier"] == cells["risk_tier"]), "left") \
        .select(grid["year"], grid["risk_tier"], F.coalesce(cells["n"], F.lit(0)).alias("n"),
                F.coalesce(cells["events"], F.lit(0)).cast("long").alias("events"))
    return with_rates(full)


def tier_summary(rates: DataFrame) -> DataFrame:
    """Monotone over the three tiers, and the spread between the outer two."""
    pick = lambda t: F.max(F.when(F.col("risk_tier") == t, F.col("rate")))
    low, mid, top = (pick(t) for t in TIER_LABELS)
    return rates.where("year IS NULL").agg(
        F.coalesce((low <= mid) & (mid <= top), F.lit(False)).alias("monotone"), (top - low).alias("spread"))


def base_rates(panel: DataFrame) -> DataFrame:
    """Events and rate in total and per year, with events per distinct year."""
    rows = panel.where(F.col("label").isNotNull()).withColumn("year", F.year("date"))
    out = rows.rollup("year").agg(*hit_columns(), F.countDistinct(F.year("date")).alias("_years"))
    return out.select("year", "n", "events", (F.col("events") / F.col("n")).alias("rate"),
                      (F.col("events") / F.col("_years")).alias("events_per_year"))


# ---- classification ---------------------------------------------------------------------------

def threshold_metrics(panel: DataFrame) -> DataFrame:
    """Precision, recall, lift and flagged count at each tier's lower percentile bound (A9); one pass."""
    rows = labelled(panel)
    y = F.col("label") == 1
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y).alias("events")]
    for i, (_, lo, _) in enumerate(TIERS):
        flagged = F.col("score_percentile") >= lo
        aggs += [F.count_if(flagged).alias(f"f{i}"), F.count_if(flagged & y).alias(f"tp{i}")]
    one = rows.agg(*aggs)
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(lo).cast("long").alias("score_floor"),
                                         F.col(f"f{i}").alias("n_flagged"), F.col(f"tp{i}").alias("tp"))
                                for i, (t, lo, _) in enumerate(TIERS)])).alias("c")
    ratio = lambda a, b: F.when(b > 0, a / b)
    precision = ratio(F.col("c.tp"), F.col("c.n_flagged"))
    return one.select("n", "events", cells).select(
        "c.tier", "c.score_floor", "c.n_flagged", precision.alias("precision"),
        ratio(F.col("c.tp"), F.col("events")).alias("recall"),
        (precision / F.when(F.col("events") > 0, F.col("events") / F.col("n"))).alias("lift"))


def _classes(panel: DataFrame) -> DataFrame:
    return value_table(labelled(panel), [], "composite_score", {"pos": F.col("label").cast("long")})


def auc(panel: DataFrame) -> DataFrame:
    """Area under the ROC curve from mid-ranks, null with a single class."""
    table = _classes(panel)
    ranks = F.sum(F.col("pos") * mid_rank() / 2)
    p, n = F.max("pos_total"), F.max("n")
    value = (ranks - p * (p + 1) / 2) / (p * (n - p))
    return table.agg(n.alias("n"), p.alias("events"), F.when((p > 0) & (p < n), value).alias("auc"))


def roc(panel: DataFrame, points: int = 60) -> DataFrame:
    """ROC points at distinct scores, collinear interior points dropped, at most ``points`` evenly indexed.

    The table of distinct scores is ordered by a distributed sort; a point is collinear when its step equals the
    next one, so only the neighbour's counts are needed.
    """
    steps = _classes(panel).select(
        "composite_score", "pos", (F.col("cnt") - F.col("pos")).alias("neg"),
        (F.col("pos_total") - F.col("pos_below")).alias("tp"),
        (F.col("n") - F.col("pos_total") - (F.col("below") - F.col("pos_below"))).alias("fp"),
        F.col("pos_total").alias("p"), (F.col("n") - F.col("pos_total")).alias("q"))
    steps = steps.where("p > 0 AND q > 0")        # a single class has no curve
    ordered = row_numbers(steps, [F.col("composite_score").desc()], "rn")
    following = ordered.select((F.col("rn") - 1).alias("rn"), F.col("pos").alias("pos2"), F.col("neg").alias("neg2"))
    corner = (F.col("rn") == 1) | F.col("pos2").isNull() | (F.col("pos") != F.col("pos2")) | (F.col("neg") != F.col("neg2"))
    kept = row_numbers(ordered.join(following, "rn", "left").where(corner).drop("n", "rn"),
                       [F.col("composite_score").desc()], "j")
    # j counts from 1 because the origin (0, 0) takes index 0
    total, k = F.col("n"), F.least(F.lit(points), F.col("n") + 1)
    i = F.ceil(F.col("j") * (k - 1) / total)
    picked = kept.where(F.floor(i * total / (k - 1)) == F.col("j"))
    out = picked.select(F.col("j").alias("idx"), (F.col("fp") / F.col("q")).alias("fpr"),
                        (F.col("tp") / F.col("p")).alias("tpr"), F.col("composite_score").alias("threshold"))
    origin = kept.limit(1).select(F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                  F.lit(None).cast("double").alias("threshold"))
    return out.unionByName(origin)


def calibration(panel: DataFrame) -> DataFrame:
    """Pooled decile bins: mean score, score/100 as predicted rate, realized rate with interval (A10)."""
    rows = pooled_deciles(labelled(panel), DECILE_ORDER, out="bin")
    cells = with_rates(rows.groupBy("bin").agg(*hit_columns(), F.avg("composite_score").alias("mean_score")))
    return cells.select((F.col("bin") - 1).alias("bin"), "mean_score", (F.col("mean_score") / 100).alias("predicted"),
                        F.col("rate").alias("realized"), "ci_low", "ci_high", "n")


def calibration_by_tier(panel: DataFrame) -> DataFrame:
    """The same per tier (A10): mean score as predicted rate against the realized rate with its interval."""
    cells = with_rates(labelled(panel).groupBy("risk_tier").agg(*hit_columns(), F.avg("composite_score").alias("mean_score")))
    return cells.select("risk_tier", "mean_score", (F.col("mean_score") / 100).alias("predicted"),
                        F.col("rate").alias("realized"), "ci_low", "ci_high", "n")


def confusion_label() -> Column:
    """Four-way outcome text."""
    flagged, event = F.col("risk_tier") == TOP_TIER, F.col("label") == 1
    return (F.when(flagged & event, "CAUGHT (true positive)").when(flagged, "false alarm")
            .when(event, "MISSED (false negative)").otherwise("correctly cleared"))


def holding_rows(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("is_held") & F.col("label").isNotNull())


def confusion(panel: DataFrame) -> DataFrame:
    flagged, event = F.col("risk_tier") == TOP_TIER, F.col("label") == 1
    return holding_rows(panel).agg(
        F.count_if(flagged & event).alias("true_positive"), F.count_if(flagged & ~event).alias("false_positive"),
        F.count_if(~flagged & event).alias("false_negative"), F.count_if(~flagged & ~event).alias("true_negative"))


def ledger(panel: DataFrame) -> DataFrame:
    """Hit or miss of every holding at every date."""
    return (holding_rows(panel)
            .select("date", "entity", F.bround("composite_score", 1).alias("score"), F.col("risk_tier").alias("tier"),
                    (F.col("risk_tier") == TOP_TIER).alias("flagged"), "fwd_maxdd",
                    (F.col("label") == 1).alias("severe"), confusion_label().alias("outcome"))
            .orderBy("date", "entity"))


def held_events(panel: DataFrame, caught: bool) -> DataFrame:
    """Severe drawdowns held and flagged (caught) or not (missed), worst first."""
    hit = F.col("risk_tier") == TOP_TIER
    return (holding_rows(panel).where((F.col("label") == 1) & (hit if caught else ~hit))
            .select("date", "entity", F.bround("composite_score", 1).alias("score"), F.col("risk_tier").alias("tier"),
                    "fwd_maxdd").orderBy(F.col("fwd_maxdd").desc(), "date", "entity"))


def score_series(panel: DataFrame) -> DataFrame:
    """Mean score of holdings and of everything per date; dates without holdings are left out."""
    held = F.when(F.col("is_held"), F.col("composite_score"))
    return (panel.groupBy("date").agg(F.avg(held).alias("held_mean"), F.avg("composite_score").alias("universe_mean"),
                                      F.count_if("is_held").alias("n_held")).where("n_held > 0"))


# ---- information coefficient ------------------------------------------------------------------

def spearman_ic(panel: DataFrame, target: str, min_pairs: int = 5) -> DataFrame:
    """Rank correlation of score and target per date over complete pairs.

    The value 0 for a constant side is undefined and comes out null.
    """
    pairs = panel.where(F.col("composite_score").isNotNull() & F.col(target).isNotNull())
    pairs = pairs.select("date", "entity", F.col("composite_score").alias("_s"), F.col(target).alias("_t"))
    ranked = with_ranks(pairs, ["date"], "_s").withColumn("_rs", mid_rank()).drop("cnt", "below", "n")
    ranked = with_ranks(ranked, ["date"], "_t").withColumn("_rt", mid_rank()).drop("cnt", "below", "n")
    rs, rt = F.col("_rs").cast("double"), F.col("_rt").cast("double")
    varied = (F.min("_rs") < F.max("_rs")) & (F.min("_rt") < F.max("_rt"))
    n = F.count(F.lit(1))
    return ranked.groupBy("date").agg(n.alias("n"), F.when((n >= min_pairs) & varied, F.corr(rs, rt)).alias("ic"))


def newey_west(series: DataFrame, value: str, by: Sequence[str] = (), lags: int | None = None) -> DataFrame:
    """Mean and its Newey-West t per group of a date series.

    Nulls are dropped and gaps close up; Bartlett weights; the automatic lag count is clamped to [1, n - 1].  The
    series has one value per date; lagged products come from an equi-join on the shifted position.
    """
    rows, keys = keyed(series.where(F.col(value).isNotNull()), by)
    whole = W.partitionBy(*keys)
    rows = rows.select(*keys, F.col(value).alias("_v"), F.row_number().over(whole.orderBy("date")).alias("_t"),
                       F.count(F.lit(1)).over(whole).alias("_n"), F.avg(value).over(whole).alias("_m"))
    auto = F.greatest(F.lit(1), F.least(F.floor(4 * F.pow(F.col("_n") / 100, F.lit(2.0 / 9.0))), F.col("_n") - 1))
    rows = rows.select(*keys, "_t", "_n", "_m", (F.col("_v") - F.col("_m")).alias("_e"),
                       (F.lit(lags) if lags is not None else auto).cast("int").alias("_L"))
    now = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_L")))).withColumn("_t", F.col("_t") - F.col("_k"))
    then = rows.select(*keys, "_t", F.col("_e").alias("_e2"))
    weight = F.when(F.col("_k") == 0, F.lit(1.0)).otherwise(2 * (1 - F.col("_k") / (F.col("_L") + 1)))
    agg = now.join(then, [*keys, "_t"]).groupBy(*keys).agg(
        F.max("_n").alias("n"), F.max("_m").alias("mean"), F.max("_L").alias("lags"),
        (F.sum(weight * F.col("_e") * F.col("_e2")) / F.max("_n")).alias("_var"))
    se = F.when((F.col("n") >= 2) & (F.col("_var") > 0), F.sqrt(F.col("_var") / F.col("n")))
    return agg.select(*by, "n", "mean", (F.col("mean") / se).alias("t_stat"),
                      F.when(F.col("n") >= 2, F.col("lags").cast("long")).alias("lags"))


# ---- strategies -------------------------------------------------------------------------------

def equity_curve(rets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative wealth and drawdown per series; ``rets`` has date and ret."""
    w = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    out = rets.where(F.col("ret").isNotNull()).withColumn("equity", F.product(1 + F.col("ret")).over(w))
    peak = F.max("equity").over(w)
    return out.withColumn("drawdown", F.try_divide(peak - F.col("equity"), peak))


def equity_stats(rets: DataFrame, by: Sequence[str] = (), per_year: int = 4) -> DataFrame:
    """CAGR, volatility, Sharpe ratio (no risk-free rate), maximum drawdown, total return."""
    curve = equity_curve(rets, by)
    agg = curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("equity", "date").alias("_end"), F.avg("ret").alias("_m"),
        F.stddev_samp("ret").alias("_s"), F.max("drawdown").alias("max_drawdown"))
    vol = F.col("_s") * F.sqrt(F.lit(float(per_year)))
    return agg.select(*by, "n", (F.pow("_end", F.lit(float(per_year)) / F.col("n")) - 1).alias("cagr"), vol.alias("vol"),
                      F.when(vol > 0, F.col("_m") * per_year / vol).alias("sharpe"), "max_drawdown",
                      (F.col("_end") - 1).alias("total_return"))


def turnover(weights: DataFrame, dates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of absolute weight changes per rebalance, the first one against nothing.

    A holding enters once with its weight and once, one rebalance later, with minus its weight; no join.
    """
    order = dates.select("date").distinct().select("date", F.row_number().over(W.orderBy("date")).alias("_i"))
    cur = weights.join(order, "date")
    moves = (cur.select(*by, "_i", "entity", "weight")
             .unionByName(cur.select(*by, (F.col("_i") + 1).alias("_i"), "entity", (-F.col("weight")).alias("weight"))))
    per_name = moves.groupBy(*by, "_i", "entity").agg(F.sum("weight").alias("d"))
    total = per_name.groupBy(*by, "_i").agg(F.sum(F.abs("d")).alias("turnover"))
    return order.join(total, "_i").drop("_i")


def strategy_weights(panel: DataFrame, per_sector: bool = False) -> DataFrame:
    """``strategy, date, entity, weight, period_ret`` of the avoid-top-tier and long/short strategies.

    Long/short pools all sectors; ``per_sector`` splits each side equally over the sectors that have it.
    """
    rows = panel.where(F.col("period_ret").isNotNull())
    n_keep = F.count_if(F.col("risk_tier") != TOP_TIER).alias("n_keep")
    sizes = rows.groupBy("date").agg(n_keep, F.count_if(F.col("risk_tier") == BOTTOM_TIER).alias("n_long"),
                                     F.count_if(F.col("risk_tier") == TOP_TIER).alias("n_short"))
    base = rows.select("date", "entity", "sector", "risk_tier", "period_ret").join(sizes, "date")
    avoid = (base.where(F.col("risk_tier") != TOP_TIER)
             .select(F.lit("avoid_top_tier").alias("strategy"), "date", "entity", (1 / F.col("n_keep")).alias("weight"),
                     "period_ret"))
    sides = base.where(F.col("risk_tier").isin(TOP_TIER, BOTTOM_TIER))
    long = F.col("risk_tier") == BOTTOM_TIER
    if per_sector:
        cells = sides.groupBy("date", "sector", "risk_tier").agg(F.count(F.lit(1)).alias("_n"))
        sectors = cells.groupBy("date", "risk_tier").agg(F.count(F.lit(1)).alias("_k"))
        sides = sides.join(cells, ["date", "sector", "risk_tier"]).join(sectors, ["date", "risk_tier"])
        size = F.col("_n") * F.col("_k")
    else:
        size = F.when(long, F.col("n_long")).otherwise(F.col("n_short"))
    ls = sides.select(F.lit("long_short").alias("strategy"), "date", "entity",
                      (F.when(long, F.lit(0.5)).otherwise(F.lit(-0.5)) / size).alias("weight"), "period_ret")
    return avoid.unionByName(ls)


def strategy_returns(panel: DataFrame, cost_bps: float, per_sector: bool = False) -> DataFrame:
    """Net return and turnover per strategy and date, with the equal-weight benchmark.

    No surviving name means holding the benchmark.
    """
    rows = panel.where(F.col("period_ret").isNotNull())
    bench = rows.groupBy("date").agg(F.avg("period_ret").alias("bench"))
    weights = strategy_weights(panel, per_sector)
    gross = weights.groupBy("strategy", "date").agg(F.sum(F.col("weight") * F.col("period_ret")).alias("gross"))
    moved = turnover(weights, rows, ["strategy"])
    grid = bench.withColumn("strategy", F.explode(F.array(F.lit("avoid_top_tier"), F.lit("long_short"))))
    empty = F.when(F.col("strategy") == "avoid_top_tier", F.col("bench")).otherwise(F.lit(0.0))
    net = F.coalesce("gross", empty) - F.lit(cost_bps / 1e4) * F.coalesce("turnover", F.lit(0.0))
    out = (grid.join(gross, ["strategy", "date"], "left").join(moved, ["strategy", "date"], "left")
           .select("strategy", "date", net.alias("ret"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), "bench"))
    flat = bench.select(F.lit("benchmark").alias("strategy"), "date", F.col("bench").alias("ret"),
                        F.lit(None).cast("double").alias("turnover"), "bench")
    return out.unionByName(flat)


def strategy_summary(panel: DataFrame, cfg: RunConfig, per_sector: bool = False) -> DataFrame:
    """Equity statistics, share of periods above the benchmark and mean turnover."""
    rets = strategy_returns(panel, cfg.cost_bps, per_sector)
    stats = equity_stats(rets, ["strategy"], cfg.periods_per_year)
    extra = rets.groupBy("strategy").agg(
        F.avg((F.col("ret") > F.col("bench")).cast("int")).alias("hit_rate_vs_bench"),
        F.avg("turnover").alias("avg_turnover"))
    return stats.join(extra, "strategy")


def counterfactual_returns(panel: DataFrame) -> DataFrame:
    """Held portfolio and its variant without the top tier, weights renormalized per date."""
    held = panel.where(F.col("is_held") & F.col("period_ret").isNotNull())
    keep = F.col("risk_tier") != TOP_TIER

    def mean(cond: Column) -> Column:
        w, r = F.when(cond, F.col("held_weight")), F.when(cond, F.col("period_ret"))
        return F.when(F.sum(w) > 0, F.sum(w * r) / F.sum(w)).otherwise(F.avg(r))

    rows = held.groupBy("date").agg(mean(F.lit(True)).alias("actual"), mean(keep).alias("_avoid"))
    return rows.select("date", "actual", F.coalesce("_avoid", "actual").alias("avoid_top_tier"))


def counterfactual(panel: DataFrame, cfg: RunConfig) -> DataFrame:
    """Equity statistics of both variants with the deltas of CAGR and drawdown."""
    long = counterfactual_returns(panel).unpivot("date", ["actual", "avoid_top_tier"], "strategy", "ret")
    stats = equity_stats(long, ["strategy"], cfg.periods_per_year)
    at = lambda c: F.max(F.when(F.col("strategy") == "actual", F.col(c)))
    actual = stats.agg(F.struct(at("cagr").alias("cagr"), at("max_drawdown").alias("mdd"))).scalar()
    return (stats.withColumn("_a", actual)
            .withColumn("delta_cagr", F.col("cagr") - F.col("_a.cagr"))
            .withColumn("delta_maxdd", F.col("max_drawdown") - F.col("_a.mdd")).drop("_a"))


# ---- guards -----------------------------------------------------------------------------------

def shuffled_scores(panel: DataFrame, seed: int = 0) -> DataFrame:
    """Scores permuted inside each date by a keyed hash.

    The row in place i by the MD5 of ``entity|seed`` gets the score of the row in place i by that of ``entity|seed + 1``: any
    engine can repeat it.  Both orders get exact ranks from value tables of their hashes, so no date is ordered in one task.
    """
    rows = panel.where(F.col("composite_score").isNotNull())

    def keyed_hash(n: int):
        return F.conv(F.substring(F.md5(F.concat(F.col("entity").cast("string"), F.lit(f"|{n}"))), 1, 15), 16, 10).cast("long")
    hashed = rows.withColumn("_a", keyed_hash(seed)).withColumn("_b", keyed_hash(seed + 1))
    left = positions(hashed, ["date"], "_a", "entity", "_pos").drop("n")
    right = positions(hashed.select("date", "entity", "_b", F.col("composite_score").alias("_score")), ["date"], "_b",
                      "entity", "_pos").select("date", "_pos", "_score")
    return (left.join(right, ["date", "_pos"]).withColumn("composite_score", F.col("_score"))
            .drop("_a", "_b", "_pos", "_score"))


def placebo(panel: DataFrame, target: str, seed: int = 0) -> DataFrame:
    """Mean IC of real and permuted scores, and whether the guard passes."""
    real = spearman_ic(panel, target).agg(F.avg("ic")).scalar()
    fake = spearman_ic(shuffled_scores(panel, seed), target).agg(F.avg("ic").alias("placebo_ic"))
    out = fake.withColumn("real_ic", real)
    passed = (F.abs("placebo_ic") < 0.05) & (F.abs("real_ic") > F.abs("placebo_ic") + 0.03)
    return out.withColumn("passed", passed)


def evaluation(panel: DataFrame, cfg: RunConfig, survivorship_safe: bool) -> dict:
    """Every evaluation of a panel by name, as functions to call for the table.

    Write the panel first: each table reads it.
    """
    meta = lambda: panel.agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.countDistinct("date").alias("n_snapshots"), F.lit(cfg.cadence).alias("rebalance"),
        F.lit(cfg.horizon_months).alias("horizon_months"), F.lit(cfg.dd_threshold).alias("dd_threshold"),
        F.lit(survivorship_safe).alias("survivorship_safe"), F.lit(cfg.cost_bps).alias("cost_bps"))
    return {
        "metadata": meta,
        "base_rate": lambda: base_rates(panel),
        "deciles": lambda: decile_hit_rates(panel),
        "tiers": lambda: tier_hit_rates(panel),
        "ic_return": lambda: spearman_ic(panel, f"fwd_ret_{cfg.horizon_months}m"),
        "ic_drawdown": lambda: spearman_ic(panel, "fwd_maxdd"),
        "auc": lambda: auc(panel),
        "roc": lambda: roc(panel),
        "thresholds": lambda: threshold_metrics(panel),
        "calibration": lambda: calibration(panel),
        "ledger": lambda: ledger(panel),
        "score_series": lambda: score_series(panel),
        "confusion": lambda: confusion(panel),
        "counterfactual": lambda: counterfactual(panel, cfg),
        "strategy": lambda: strategy_summary(panel, cfg),
    }
