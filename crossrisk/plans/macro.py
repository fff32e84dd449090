"""Factor panel and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TIMEFRAMES, TWO_WAY_RULES
from ..functions import expr as X
from ..operators import cube, regress as R, report, returns
from ..sources import sinks
from . import series as S
from . import views as V
from .registry import query, r6

XS = ["A_F", "A_O", "N_F"]

V.SQL_VIEWS["dense"] = (["factor_levels"], """
    SELECT factor, date, last_value(value IGNORE NULLS) OVER (PARTITION BY factor ORDER BY date
             ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS value
    FROM (SELECT f.factor, c.date, v.value FROM (SELECT DISTINCT factor FROM factor_levels) f
          CROSS JOIN (SELECT * FROM (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
                                     FROM factor_levels) WHERE isodow(date) < 6) c
          LEFT JOIN factor_levels v ON v.factor = f.factor AND v.date = c.date)""")
V.SQL_VIEWS["moved"] = (["dense"], """
    SELECT factor, date, CASE WHEN value > 0 AND prev > 0 THEN ln(value / prev) END AS value
    FROM (SELECT *, lag(value) OVER (PARTITION BY factor ORDER BY date) AS prev FROM dense)""")
V.SQL_VIEWS["fac"] = (["moved"], "SELECT * FROM (SELECT date, " + ", ".join(
    f"max(value) FILTER (factor = '{f}') AS {f}" for f in V.FACTORS) + " FROM moved GROUP BY date) WHERE " + " AND ".join(
    f"{f} IS NOT NULL" for f in V.FACTORS))
V.SQL_VIEWS["reg"] = (["fac", "port", "bench"], """
    SELECT f.*, p.ret AS port, b.ret AS bench FROM fac f JOIN port p USING (date) JOIN bench b USING (date)""")
V.SQL_VIEWS["ereg"] = (["fac", "rets"], "SELECT r.entity, r.ret, f.* FROM rets r JOIN fac f USING (date)")
_ALL = ", ".join(V.FACTORS)
V.SQL_VIEWS["xreg"] = (["ereg"], f"SELECT * FROM (UNPIVOT ereg ON {_ALL} INTO NAME factor VALUE x)")
V.SQL_VIEWS["sreg"] = (["reg"], f"SELECT * FROM (UNPIVOT reg ON {_ALL} INTO NAME factor VALUE x)")
_TF = """
    SELECT tf.timeframe, t.* FROM {src} t JOIN (
        SELECT 'ytd' AS timeframe, CAST(date_trunc('year', max(date)) AS DATE) AS start FROM {src}
        UNION ALL SELECT '6m', CAST(max(date) - INTERVAL 6 MONTH AS DATE) FROM {src}
        UNION ALL SELECT '1y', CAST(max(date) - INTERVAL 12 MONTH AS DATE) FROM {src}
        UNION ALL SELECT '2y', CAST(max(date) - INTERVAL 24 MONTH AS DATE) FROM {src}
        UNION ALL SELECT 'max', DATE '1900-01-01') tf ON t.date >= tf.start"""
V.SQL_VIEWS["xtf"] = (["xreg"], _TF.format(src="xreg"))
V.SQL_VIEWS["stf"] = (["sreg"], _TF.format(src="sreg"))
V.SQL_VIEWS["ebeta"] = (["xreg"], """
    SELECT entity, factor, count(*) AS n, regr_slope(ret, x) AS beta, regr_intercept(ret, x) AS alpha
    FROM xreg GROUP BY entity, factor HAVING count(*) >= 30""")


def _meta(spark):
    return spark.createDataFrame([(f, "log_return", "daily") for f in V.FACTORS],
                                 "factor string, transform string, frequency string")


@V.stored
def factors(spark, sf_dir):
    return R.factor_panel(V.factor_levels(spark, sf_dir), _meta(spark), V.FACTORS)


@V.stored
def sample(spark, sf_dir):
    """date, factors, portfolio and benchmark returns."""
    p = S.portfolio(spark, sf_dir).withColumnRenamed("ret", "port")
    b = S.benchmark(spark, sf_dir).withColumnRenamed("ret", "bench")
    return factors(spark, sf_dir).join(p, "date").join(b, "date")


@V.stored
def entity_sample(spark, sf_dir):
    return returns.simple_returns(V.prices(spark, sf_dir)).join(factors(spark, sf_dir), "date")


def entity_paths(spark, sf_dir):
    """``entity_sample`` as it comes, all rows of an entity in one task: prices are dealt before returns are taken, and what has one
    row per day is broadcast to them."""
    rets = returns.simple_returns(V.prices(spark, sf_dir).repartition("entity"))
    return rets.join(F.broadcast(factors(spark, sf_dir)), "date")


def each_factor(df, y, by=(), lags=5, placed=False):
    """One-factor fits for every factor at once."""
    fits = R.one_factor_ols(df, y, V.FACTORS, by, lags, placed=placed)
    return fits.withColumn("factor", F.when(F.col("factor") == "x", F.col("which")).otherwise(F.col("factor")))


@V.stored
def entity_betas(spark, sf_dir):
    return each_factor(entity_paths(spark, sf_dir), "ret", ["entity"], placed=True)


def each_timeframe(df, y, by=(), controls=()):
    """One-factor fits for every factor and timeframe from one cube."""
    ids, last = [c for c in df.columns if c not in V.FACTORS], df.agg(F.max("date")).scalar()
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("which"), F.col(f).alias("x")) for f in V.FACTORS]))
    own = df.repartition(*by) if by else df         # rows travel once, and become one for each factor where they are summed
    long = own.select(*ids, each.alias("_f")).select(*ids, "_f.which", "_f.x")
    fits = cube.timeframe_fits(long, y, ["x"], [*by, "which"], controls=controls, last=last)
    return fits.withColumn("factor", F.when(F.col("factor") == "x", F.col("which")).otherwise(F.col("factor")))


@V.stored
def timeframe_entity_betas(spark, sf_dir):
    return slopes(each_timeframe(entity_sample(spark, sf_dir), "ret", ["entity"]))


def shocks_of_factors(spark):
    return R.shocks_table(spark, [(f, f"{t} {f}", s) for f in V.FACTORS for t, s in (("-10%", -0.10), ("+3%", 0.03))] + [
        ("B_X", "unused", 1.0)])


def slopes(fits):
    return fits.where("factor <> 'const'").drop("which")


@query("factor_panel", "fac", "SELECT date, " + ", ".join(f"round({f}, 6) AS {f}" for f in V.FACTORS) + " FROM fac")
def factor_panel(spark, sf_dir):
    """Calendar, bounded fill, transform, complete rows."""
    out = R.factor_panel(V.factor_levels(spark, sf_dir), _meta(spark), V.FACTORS)
    return out.select("date", *[r6(f) for f in V.FACTORS])


@query("factor_validation", "moved", """
    , st AS (SELECT factor, count(value) AS n_valid, count(*) AS rows, avg(value) AS mean, stddev_samp(value) AS std FROM moved GROUP BY factor)
    SELECT factor, n_valid, round(100 * (1 - CAST(n_valid AS DOUBLE) / rows), 6) AS pct_missing, round(mean, 6) AS mean,
           round(std, 6) AS std, count(*) FILTER (abs((value - mean) / std) > 10) AS n_outliers
    FROM moved JOIN st USING (factor) GROUP BY factor, n_valid, rows, mean, std""")
def factor_validation(spark, sf_dir):
    """A19."""
    from ..operators import asof
    dense = asof.reindex_ffill(V.factor_levels(spark, sf_dir), "factor", "value", 1)
    moved = dense.withColumn("value", returns.transform("log_return"))
    return R.factor_validation(moved).select("factor", "n_valid", r6("pct_missing"), r6("mean"), r6("std"), "n_outliers")


_HAC = """
    , b AS (SELECT {g} count(*) AS n, regr_slope({y}, {x}) AS beta, regr_intercept({y}, {x}) AS alpha, avg({x}) AS mx,
                   regr_sxx({x}, {x}) AS sxx FROM {src} {group}),
    e AS (SELECT {s} date, {x} AS x, b.n, b.sxx, b.mx, {y} - b.alpha - b.beta * {x} AS e FROM {src} t {join}),
    s AS (SELECT *, (x - mx) * e AS s FROM e),
    u AS (SELECT *, {lags} AS u FROM s),
    m AS (SELECT {g} sum(s * s + 2 * s * u) AS meat FROM u {group})"""


def _hac(y, x, src, key=None, lags=5):
    over = f"OVER ({'PARTITION BY ' + key if key else ''} ORDER BY date)"
    terms = " + ".join(f"CAST({1 - k / (lags + 1)!r} AS DOUBLE) * coalesce(lag(s, {k}) {over}, 0)" for k in range(1, lags + 1))
    return _HAC.format(g=f"{key}," if key else "", s=f"{key}," if key else "", y=y, x=x, src=src,
                       group=f"GROUP BY {key}" if key else "", join=f"JOIN b USING ({key})" if key else ", b", lags=terms)


@query("ols_hac_single", "sreg", _hac("port", "x", "sreg", "factor") + """
    SELECT factor, b.n, round(b.beta, 6) AS beta, round(b.alpha, 6) AS alpha, round(sqrt(m.meat) / b.sxx, 6) AS std_err,
           round(b.beta / (sqrt(m.meat) / b.sxx), 6) AS t_stat FROM b JOIN m USING (factor)""")
def ols_hac_single(spark, sf_dir):
    """Slope with HAC error, every factor alone."""
    fits = each_factor(sample(spark, sf_dir), "port")
    const = fits.where("factor = 'const'").select("which", r6("beta", "alpha"))
    return fits.where("factor <> 'const'").join(const, "which").select("factor", "n", r6("beta"), "alpha", r6("std_err"), r6("t_stat"))


@query("ols_two_factors", "reg", """
    , m AS (SELECT count(*) AS n, covar_pop(port, A_F) AS ya, covar_pop(port, N_F) AS yb, var_pop(A_F) AS aa, var_pop(N_F) AS bb,
                   covar_pop(A_F, N_F) AS ab, avg(port) AS my, avg(A_F) AS ma, avg(N_F) AS mb, var_pop(port) AS yy FROM reg),
    c AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS bn FROM m)
    SELECT f.factor, c.n, round(CASE f.factor WHEN 'A_F' THEN ba WHEN 'N_F' THEN bn ELSE my - ba * ma - bn * mb END, 6) AS beta,
           round((ba * ya + bn * yb) / yy, 6) AS r2, CASE WHEN f.factor <> 'const' THEN round(1 / (1 - ab * ab / (aa * bb)), 6) END AS vif
    FROM c, (SELECT unnest(['const', 'A_F', 'N_F']) AS factor) f""")
def ols_two_factors(spark, sf_dir):
    """G2, G3, T4."""
    return R.ols_hac(sample(spark, sf_dir), "port", ["A_F", "N_F"]).select("factor", "n", r6("beta"), r6("r2"), r6("vif"))


@query("per_entity_betas", "xreg", _hac("ret", "x", "xreg", "entity, factor") + """
    SELECT entity, factor, b.n, round(b.beta, 6) AS beta, round(sqrt(m.meat) / b.sxx, 6) AS std_err
    FROM b JOIN m USING (entity, factor) WHERE b.n >= 30""")
def per_entity_betas(spark, sf_dir):
    """Every entity and factor in one plan."""
    fits = each_factor(entity_paths(spark, sf_dir), "ret", ["entity"], placed=True)
    return slopes(fits).select("entity", "factor", "n", r6("beta"), r6("std_err"))


@query("multi_factor_betas")
def multi_factor_betas(spark, sf_dir):
    """Six factors with p-values and stars; checked against numpy in the tests."""
    fits = R.estimates(R.ols_hac(sample(spark, sf_dir), "port", V.FACTORS), len(V.FACTORS))
    return fits.select("factor", r6("beta"), r6("std_err"), r6("t_stat"), r6("p_value"), r6("ci_low"), r6("ci_high"),
                       X.stars("p_value").alias("stars"), "significant_05", r6("bonferroni_threshold"))


@query("residualized_betas", "sreg", """
    , g AS (SELECT factor, regr_slope(x, bench) AS gf, regr_intercept(x, bench) AS cf, regr_slope(port, bench) AS mb FROM sreg GROUP BY factor),
    r AS (SELECT factor, port - mb * bench AS rest, x - cf - gf * bench AS rf, mb FROM sreg JOIN g USING (factor))
    SELECT factor, round(regr_slope(rest, rf), 6) AS beta, round(any_value(mb), 6) AS market_beta FROM r GROUP BY factor""")
def residualized_betas(spark, sf_dir):
    """One control, every factor alone; slopes equal the partialled-out forms."""
    long = sample(spark, sf_dir).unpivot(["date", "port", "bench"], V.FACTORS, "which", "x")
    fits = R.residualized(long, "port", ["bench"], ["x"], ["which"])
    pick = lambda f: F.max(F.when(F.col("factor") == f, F.col("beta")))
    return fits.groupBy(F.col("which").alias("factor")).agg(r6(pick("x"), "beta"), r6(pick("bench"), "market_beta"))


@query("raw_vs_residualized")
def raw_vs_residualized(spark, sf_dir):
    """Raw, one control, two controls, with the interpretation text."""
    d = sample(spark, sf_dir)
    xs = ["A_F", "A_O", "N_F"]
    raw = R.ols_hac(d, "port", xs)
    v1, v2 = R.residualized(d, "port", ["bench"], xs), R.residualized(d, "port", ["bench", "R_F"], xs)
    three = R.compare_three(raw, v1, v2)
    two = R.compare_two(raw, v1).select("factor", r6("delta"), F.col("interpretation").alias("two_way"))
    return three.select("factor", r6("raw_beta"), r6("v1_beta"), r6("v2_beta"), "interpretation").join(two, "factor")


@query("weekly_betas", "port factor_levels", f"""
    , chg AS (SELECT factor, date, {S._CHANGE} AS chg FROM factor_levels),
    x AS (SELECT factor, date + CAST((12 - isodow(date)) % 7 AS INT) AS week, coalesce(sum(chg), 0) AS x FROM chg GROUP BY 1, 2),
    y AS (SELECT date + CAST((12 - isodow(date)) % 7 AS INT) AS week, product(1 + ret) - 1 AS y FROM port GROUP BY 1)
    SELECT factor, count(*) AS n, round(regr_slope(y, x / 1000), 6) AS beta, round(regr_r2(y, x / 1000), 6) AS r2
    FROM x JOIN y USING (week) GROUP BY factor HAVING count(*) >= 30""")
def weekly_betas(spark, sf_dir):
    """Weekly bars, at most two lags."""
    port = S.portfolio(spark, sf_dir).withColumn("entity", F.lit("p"))
    y = returns.weekly_returns(port).select("week", F.col("ret").alias("y"))
    chg = V.factor_levels(spark, sf_dir).withColumn("value", returns.transform("level_change"))
    x = returns.weekly_sums(chg).select(F.col("factor").alias("which"), "week", (F.col("value") / 1000).alias("x"))
    fits = R.ols_hac(x.join(y, "week"), "y", ["x"], ["which"], lags=2, date="week")
    return fits.where("factor = 'x'").select(F.col("which").alias("factor"), "n", r6("beta"), r6("r2"))


def _rolled(window):
    return f"""SELECT date, CASE WHEN count(*) OVER w = {window} THEN round(covar_samp(port, bench) OVER w / var_samp(bench) OVER w, 6) END AS beta
    FROM reg WINDOW w AS (ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"""


def _rolled_ols(window):
    return f"""SELECT date, factor, round(covar_pop(port, x) OVER w / var_pop(x) OVER w, 6) AS beta
    FROM sreg WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)
    QUALIFY count(*) OVER w = {window}"""


def _rolled_factors(spark, sf_dir, window):
    long = sample(spark, sf_dir).unpivot(["date", "port"], V.FACTORS, "which", "x")
    return R.rolling_betas(long, "port", ["x"], window, ["which"]).select("date", F.col("which").alias("factor"), r6("beta"))


@query("rolling_beta", "reg", _rolled(60))
def rolling_beta(spark, sf_dir):
    """W25, R10."""
    return R.rolling_beta(sample(spark, sf_dir), "port", "bench").select("date", r6("beta"))


@query("rolling_beta_252", "reg", _rolled(252))
def rolling_beta_252(spark, sf_dir):
    """A year's window at the cost of a short one."""
    return R.rolling_beta(sample(spark, sf_dir), "port", "bench", 252).select("date", r6("beta"))


@query("rolling_ols", "sreg", _rolled_ols(60))
def rolling_ols(spark, sf_dir):
    """G9."""
    return _rolled_factors(spark, sf_dir, 60)


@query("rolling_ols_252", "sreg", _rolled_ols(252))
def rolling_ols_252(spark, sf_dir):
    """A year's window."""
    return _rolled_factors(spark, sf_dir, 252)


@query("rolling_entity_betas", "ereg port", """
    SELECT e.entity, e.date, round(covar_pop(e.ret, p.ret) OVER w / nullif(var_pop(p.ret) OVER w, 0), 6) AS beta
    FROM ereg e JOIN port p USING (date) WINDOW w AS (PARTITION BY e.entity ORDER BY e.date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
    QUALIFY count(*) OVER w = 60""")
def rolling_entity_betas(spark, sf_dir):
    """Every entity against the portfolio."""
    p = S.portfolio(spark, sf_dir).withColumnRenamed("ret", "port")
    rows = entity_paths(spark, sf_dir).select("entity", "date", "ret").join(F.broadcast(p), "date")      # p: one row per day
    out = R.rolling_betas(rows, "ret", ["port"], by=["entity"], placed=True)
    return out.select("entity", "date", r6("beta"))


@query("rolling_beta_by_timeframe", "reg", """
    , r AS (SELECT date, covar_samp(port, bench) OVER w / var_samp(bench) OVER w AS beta, count(*) OVER w AS n
            FROM reg WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    rolled AS (SELECT date, beta FROM r WHERE n = 60),
    sliced AS (""" + _TF.format(src="rolled") + """)
    SELECT timeframe, date, round(beta, 6) AS beta FROM sliced""")
def rolling_beta_by_timeframe(spark, sf_dir):
    """The rolled series cut to every named timeframe."""
    rolled = R.rolling_beta(sample(spark, sf_dir), "port", "bench").where("beta IS NOT NULL").select("date", "beta")
    return returns.by_timeframe(rolled, TIMEFRAMES).select("timeframe", "date", r6("beta"))


@query("timeframe_betas", "xtf", _hac("ret", "x", "xtf", "timeframe, entity, factor") + """
    SELECT timeframe, entity, factor, b.n, round(b.beta, 6) AS beta, round(sqrt(greatest(m.meat, 0)) / b.sxx, 6) AS std_err
    FROM b JOIN m USING (timeframe, entity, factor) WHERE b.n >= 30""")
def timeframe_betas(spark, sf_dir):
    """Every entity, factor and timeframe with HAC errors, from one period cube."""
    return timeframe_entity_betas(spark, sf_dir).select("timeframe", "entity", "factor", "n", r6("beta"), r6("std_err"))


_TF_RES = """
    , g AS (SELECT timeframe, factor, regr_slope(x, bench) AS gf, regr_intercept(x, bench) AS cf, regr_slope(port, bench) AS mb,
                   regr_intercept(port, bench) AS ma FROM stf GROUP BY ALL),
    tfr AS (SELECT timeframe, factor, date, port - ma - mb * bench AS rest, x - cf - gf * bench AS rf FROM stf JOIN g USING (timeframe, factor))
    """ + _hac("rest", "rf", "tfr", "timeframe, factor")
_TF_RAW = ", raw AS (SELECT timeframe, factor, regr_slope(port, x) AS raw FROM stf GROUP BY ALL)"


@query("timeframe_residualized", "stf", _TF_RES + """
    SELECT timeframe, factor, b.n, round(b.beta, 6) AS beta, round(sqrt(m.meat) / b.sxx, 6) AS std_err, round(g.mb, 6) AS control_beta
    FROM b JOIN m USING (timeframe, factor) JOIN g USING (timeframe, factor) WHERE b.n >= 30""")
def timeframe_residualized(spark, sf_dir):
    """Both stages of every factor and timeframe from one period cube."""
    fits = each_timeframe(sample(spark, sf_dir), "port", controls=["bench"])
    pick = lambda f, c: F.max(F.when(f, F.col(c)))
    own, control = F.col("factor") == F.col("which"), F.col("factor") == "bench"
    return (fits.groupBy("timeframe", "which").agg(F.max("n").alias("n"), r6(pick(own, "beta"), "beta"), r6(pick(own, "std_err"), "std_err"),
                                                   r6(pick(control, "beta"), "control_beta"))
            .withColumnRenamed("which", "factor"))


# p > 0.10 as a bound on the t statistic
_READ = "CASE " + " ".join(f"WHEN {c.replace('p > 0.10', 'abs(t) < 1.6448536269514722')} THEN '{t}'" for c, t in TWO_WAY_RULES) + " END"


@query("timeframe_comparison", "stf", _TF_RES + _TF_RAW + f"""
    , c AS (SELECT timeframe, factor, raw.raw, b.beta AS res, b.beta / (sqrt(m.meat) / b.sxx) AS t
            FROM b JOIN m USING (timeframe, factor) JOIN raw USING (timeframe, factor) WHERE b.n >= 30)
    SELECT timeframe, factor, round(raw, 6) AS raw_beta, round(res, 6) AS residualized_beta, round(res - raw, 6) + 0.0 AS delta,
           {_READ} AS interpretation FROM c""")
def timeframe_comparison(spark, sf_dir):
    """Raw against residualized per timeframe, with its reading."""
    d = sample(spark, sf_dir)
    raw, res = slopes(each_timeframe(d, "port")), each_timeframe(d, "port", controls=["bench"]).where("factor <> 'bench'")
    out = R.compare_two(raw, slopes(res), ["timeframe"])
    return out.select("timeframe", "factor", r6("raw_beta"), r6("residualized_beta"), r6("delta"), "interpretation")


@query("timeframe_scenarios", "xtf", """
    , tb AS (SELECT timeframe, entity, factor, regr_slope(ret, x) AS beta FROM xtf GROUP BY ALL HAVING count(*) >= 30)
    SELECT timeframe, entity, factor, '-10% ' || factor AS label, round(beta * -0.1, 6) + 0.0 AS impact FROM tb
    UNION ALL SELECT timeframe, entity, factor, '+3% ' || factor, round(beta * 0.03, 6) + 0.0 FROM tb""")
def timeframe_scenarios(spark, sf_dir):
    """Shocks on the betas of every timeframe."""
    return R.scenarios(timeframe_entity_betas(spark, sf_dir), shocks_of_factors(spark)).select(
        "timeframe", "entity", "factor", "label", r6("impact"))


@query("scenarios", "ebeta", """
    SELECT entity, factor, '-10% ' || factor AS label, round(beta * -0.1, 6) + 0.0 AS impact FROM ebeta
    UNION ALL SELECT entity, factor, '+3% ' || factor, round(beta * 0.03, 6) + 0.0 FROM ebeta""")
def scenarios(spark, sf_dir):
    """G11, J15, O1."""
    return R.scenarios(entity_betas(spark, sf_dir), shocks_of_factors(spark)).select("entity", "factor", "label", r6("impact"))


@query("attribution", "sreg", """
    , b AS (SELECT factor, count(*) AS n, regr_slope(port - bench, x) AS beta, sum(x) AS mv, sum(port - bench) AS total FROM sreg GROUP BY factor)
    SELECT factor, n, round(beta * mv, 6) AS contribution, round(total, 6) AS total_active, round(total - beta * mv, 6) AS selection FROM b""")
def attribution(spark, sf_dir):
    """G12, G4."""
    long = sample(spark, sf_dir).unpivot(["date", "port", "bench"], V.FACTORS, "which", "x")
    return R.attribution(long, "port", "bench", ["x"], ["which"]).select(
        F.col("which").alias("factor"), "n", r6("contribution"), r6("total_active"), r6("selection"))


@query("weighted_beta", "ebeta holdings", """
    SELECT factor, round(sum(weight * beta) / (SELECT sum(weight) FROM holdings), 6) AS zero_filled,
           round(sum(weight * beta) / sum(weight), 6) AS renormalized FROM holdings JOIN ebeta USING (entity) GROUP BY factor""")
def weighted_beta(spark, sf_dir):
    """G16, both variants."""
    b, w = entity_betas(spark, sf_dir), V.holdings(spark, sf_dir)
    return (R.weighted_beta(b, w).select("factor", r6("beta", "zero_filled"))
            .join(R.weighted_beta(b, w, missing_as_zero=False).select("factor", r6("beta", "renormalized")), "factor"))


@query("whatif", "ebeta holdings", """
    , p AS (SELECT factor, sum(weight * beta) / sum(weight) AS before FROM holdings JOIN ebeta USING (entity) GROUP BY factor)
    SELECT entity, factor, round(before, 6) AS before, round(before * 0.95 + beta * 0.05, 6) AS after,
           round(before * 0.95 + beta * 0.05 - before, 6) + 0.0 AS delta FROM ebeta JOIN p USING (factor)
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY abs(before * 0.95 + beta * 0.05 - before) DESC, factor) <= 4""")
def whatif(spark, sf_dir):
    """G17."""
    out = R.largest_shifts(R.what_if(entity_betas(spark, sf_dir), V.holdings(spark, sf_dir), 0.05), 4)
    return out.select("entity", "factor", r6("before"), r6("after"), r6("delta"))


@query("versus_index", "ebeta sreg", """
    SELECT entity, factor, round(beta - i, 6) AS gap FROM ebeta JOIN (SELECT factor, regr_slope(bench, x) AS i FROM sreg GROUP BY factor) USING (factor)""")
def versus_index(spark, sf_dir):
    """G18."""
    return R.versus_index(entity_betas(spark, sf_dir), each_factor(sample(spark, sf_dir), "bench")).select("entity", "factor", r6("gap"))


@query("index_vs_active", "sreg", """
    SELECT factor, round(regr_slope(bench, x), 6) AS index_beta, round(regr_slope(port, x), 6) AS total_beta,
           round(regr_slope(port - bench, x), 6) AS active_beta FROM sreg GROUP BY factor""")
def index_vs_active(spark, sf_dir):
    """The three series are one fit with the series as group key."""
    d = sample(spark, sf_dir).withColumn("active", F.col("port") - F.col("bench"))
    long = d.unpivot(["date", *V.FACTORS], ["bench", "port", "active"], "series", "y")
    fits = each_factor(long, "y", ["series"])
    part = lambda n: fits.where(F.col("series") == n)
    return R.index_vs_active(part("bench"), part("port"), part("active")).select(
        "factor", r6("index_beta"), r6("total_beta"), r6("active_beta"))


@query("factor_contributors", "ebeta holdings", """
    , t AS (SELECT factor, sum(weight * beta) AS total FROM holdings JOIN ebeta USING (entity) GROUP BY factor)
    SELECT factor, entity, round(weight * beta, 6) AS weighted, round(weight * beta / total, 4) AS share, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY factor ORDER BY abs(weight * beta) DESC, entity) AS rank FROM holdings JOIN ebeta USING (entity) JOIN t USING (factor))
    WHERE rank <= 3""")
def factor_contributors(spark, sf_dir):
    """Shares of the summed weighted beta; every factor is taken for significant."""
    b, w = slopes(entity_betas(spark, sf_dir)).select("entity", "factor", "beta"), V.holdings(spark, sf_dir)
    total = b.join(w, "entity").groupBy("factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("beta")).withColumn("p_value", F.lit(0.0))
    out = R.contributors(b, w, total)
    return out.select("factor", "entity", r6("weighted"), (F.round("share", 4) + F.lit(0.0)).alias("share"), F.col("rank").cast("long").alias("rank"))


@query("significant_contributors", "ebeta sreg holdings", _hac("port", "x", "sreg", "factor") + """
    , sig AS (SELECT factor, b.beta AS total FROM b JOIN m USING (factor) WHERE b.n >= 30 AND abs(b.beta / (sqrt(m.meat) / b.sxx)) > 1.959963984540054),
    w AS (SELECT h.entity, e.factor, h.weight * e.beta AS weighted, sig.total FROM holdings h JOIN ebeta e USING (entity) JOIN sig ON sig.factor = e.factor),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY abs(weighted) DESC, entity) AS rank FROM w)
    SELECT factor, entity, round(weighted, 6) AS weighted, rank,
           CASE WHEN abs(total) < 1e-9 THEN 0 ELSE round(weighted / total, 4) + 0.0 END AS share FROM ranked WHERE rank <= 3""")
def significant_contributors(spark, sf_dir):
    """Factors that are significant in the portfolio's own fit, with its beta as total."""
    out = R.contributors(slopes(entity_betas(spark, sf_dir)), V.holdings(spark, sf_dir), slopes(each_factor(sample(spark, sf_dir), "port")))
    return out.select("factor", "entity", r6("weighted"), F.col("rank").cast("long").alias("rank"),
                      (F.round("share", 4) + F.lit(0.0)).alias("share"))


@query("beta_scale", "ebeta", """
    SELECT factor, round(greatest(max(m) FILTER (rn = pos + 1), 1e-6), 6) AS scale FROM (
      SELECT *, least(CAST(floor(0.95 * n) AS BIGINT), n - 1) AS pos FROM (
        SELECT factor, abs(beta) AS m, row_number() OVER (PARTITION BY factor ORDER BY abs(beta)) AS rn, count(*) OVER (PARTITION BY factor) AS n
        FROM ebeta WHERE abs(beta) > 0)) GROUP BY factor""")
def beta_scale(spark, sf_dir):
    """A27."""
    b = slopes(entity_betas(spark, sf_dir))
    return report.positive_scale(b).select("factor", r6("scale"))


@query("beta_pivot", "ebeta", "SELECT entity, " + ", ".join(
    f"round(max(beta) FILTER (factor = '{f}'), 6) AS {f}" for f in V.FACTORS) + " FROM ebeta GROUP BY entity")
def beta_pivot(spark, sf_dir):
    """O8."""
    return R.pivot_betas(entity_betas(spark, sf_dir), V.FACTORS).select("entity", *[r6(f) for f in V.FACTORS])


@query("beta_arrays", "ebeta", """
    SELECT entity, round_even(max(beta) FILTER (factor = 'A_F'), 4) AS b0, round_even(max(beta) FILTER (factor = 'N_F'), 4) AS b1,
           CAST(NULL AS DOUBLE) AS b2, CAST(3 AS BIGINT) AS size FROM ebeta GROUP BY entity""")
def beta_arrays(spark, sf_dir):
    """K5: fixed factor order, missing factors null, four decimals."""
    arr = sinks.beta_arrays(slopes(entity_betas(spark, sf_dir)), ["A_F", "N_F", "Z_Z"])
    return arr.select("entity", *[F.get("beta", F.lit(i)).alias(f"b{i}") for i in range(3)],
                      F.size("beta").cast("long").alias("size"))


@query("macro_summary", "sreg", """
    SELECT factor, count(*) AS n, round(regr_r2(port, x), 6) AS r2, round(regr_intercept(port, x) * 252, 6) AS alpha_annual,
           CAST(1 AS DOUBLE) AS max_vif FROM sreg GROUP BY factor""")
def macro_summary(spark, sf_dir):
    """T4."""
    fits = R.summary(each_factor(sample(spark, sf_dir), "port"), ["which"])
    return fits.select(F.col("which").alias("factor"), "n", r6("r2"), r6("alpha_annual"), r6("max_vif"))


@query("macro_summary_joint", "reg", """
    , c AS (SELECT count(*) AS n, corr(A_F, A_O) AS ab, corr(A_F, N_F) AS ac, corr(A_O, N_F) AS bc FROM reg)
    SELECT n, round(greatest(1 - ab * ab, 1 - ac * ac, 1 - bc * bc) / (1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc), 6) AS max_vif
    FROM c""")
def macro_summary_joint(spark, sf_dir):
    """Largest inflation of a joint fit; the oracle inverts the correlations of three factors by hand."""
    return R.summary(R.ols_hac(sample(spark, sf_dir), "port", XS)).select("n", r6("max_vif"))
