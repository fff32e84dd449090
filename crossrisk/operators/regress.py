"""Factor regressions: HAC OLS, residualized, per group, rolling, scenarios, attribution, what-if.

Groups (entity, timeframe, method) are key columns, so one plan fits all of them: one aggregate for the moments, one
for the score products, both partial; the solves run on one row per group.  Rows are unique per (group, date), so the
lag window of a group is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import (CONTROL_FACTORS, CURATED_FACTORS, FFILL_ROWS, MIN_OBS, SHOCKS, THREE_WAY_RULES, TWO_WAY_RULES,
                      factor_registry)
from ..functions import kernels, paths
from ..functions.expr import first_rule
from .gram import ONE, dealt, key_schema, keyed, moments, window_moments

EST = ("factor string, beta double, std_err double, t_stat double, p_value double, ci_low double, ci_high double, "
       "vif double, factor_move double, contribution double, n long, r2 double, adj_r2 double, resid_std double")


def _scoped(keys: Sequence[str], by: Sequence[str], df: DataFrame) -> DataFrame:
    return df if by else df.drop(ONE)


def _safe(xs: Sequence[str]) -> list[str]:
    return [f"_x{i}" for i in range(len(xs))]


def fit(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], min_obs: int) -> DataFrame:
    """Coefficients per group of at least ``min_obs`` complete rows."""
    m = moments(rows, [y, *xs], keys).where(F.col("n") >= min_obs)
    schema = (f"{key_schema(rows, keys)}, n long, beta array<double>, inv array<double>, r2 double, adj_r2 double, "
              "resid_std double, vif array<double>, means array<double>")
    return m.mapInPandas(kernels.solver(list(keys), len(xs)), schema)


def ols_hac(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), lags: int = 5, date: str = "date",
            min_obs: int = MIN_OBS) -> DataFrame:
    """OLS with intercept and Bartlett HAC errors, normal inference (G2, G3, G4); one row per (group, estimate).

    With s_t = x_t e_t and u_t = sum_l w_l s_{t-l}, the meat is the sum of s s' + s u' + u s', so the lags cost one
    window and no more products than the plain case.  Groups below ``min_obs`` complete rows have no estimates; a
    single fit (no ``by``) below it is an error.
    """
    rows, keys = keyed(df.dropna(subset=[y, *xs]), by)
    rows = rows.select(*keys, F.col(date).alias("_date"), F.col(y).alias("_y"),
                       *[F.col(f"`{x}`").cast("double").alias(a) for x, a in zip(xs, _safe(xs))])
    names = _safe(xs)
    if not by and (n := rows.limit(min_obs).count()) < min_obs:
        raise ValueError(f"{n} complete rows, at least {min_obs} are needed")
    coef = fit(rows, "_y", names, keys, min_obs)
    joined = rows.join(coef.select(*keys, F.col("beta").alias("_b")), keys)
    fitted = sum((F.col("_b")[i + 1] * F.col(x) for i, x in enumerate(names)), F.col("_b")[0])
    e = joined.withColumn("_e", F.col("_y") - fitted)
    s = e.select(*keys, "_date", F.col("_e").alias("_s0"),
                 *[(F.col(x) * F.col("_e")).alias(f"_s{i + 1}") for i, x in enumerate(names)])
    k = len(names) + 1
    if lags > 0:
        w = W.partitionBy(*keys).orderBy("_date")
        weight = [1.0 - lag / (lags + 1) for lag in range(1, lags + 1)]
        s = s.select("*", *[sum((F.coalesce(F.lag(f"_s{i}", lag).over(w), F.lit(0.0)) * weight[lag - 1]
                                 for lag in range(2, lags + 1)),
                                F.coalesce(F.lag(f"_s{i}", 1).over(w), F.lit(0.0)) * weight[0]).alias(f"_u{i}")
                            for i in range(k)])
    else:
        s = s.select("*", *[F.lit(0.0).alias(f"_u{i}") for i in range(k)])
    products = [F.sum(F.col(f"_s{i}") * F.col(f"_s{j}") + F.col(f"_s{i}") * F.col(f"_u{j}")
                      + F.col(f"_u{i}") * F.col(f"_s{j}")) for i in range(k) for j in range(i, k)]
    meat = s.groupBy(*keys).agg(F.array(*products).alias("meat"))
    out = coef.join(meat, keys).mapInPandas(kernels.sandwich(list(keys), list(xs)), f"{key_schema(rows, keys)}, {EST}")
    return _scoped(keys, by, out)


def one_factor_ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), lags: int = 5, date: str = "date",
                   min_obs: int = MIN_OBS, placed: bool = False) -> DataFrame:
    """``ols_hac`` of ``y`` on each of ``xs`` alone, the name of the regressor in ``which``.

    Rows are dealt by group once, as they are; a row is never copied to its factors, and moments, residuals and lags are taken in
    the same task.  Groups with a null key have no estimates, as in ``ols_hac``.  ``placed`` as in ``gram.dealt``.
    """
    rows, keys = keyed(df, by)
    names = dict(zip(xs, _safe(xs)))
    for c in [y, *keys]:
        rows = rows.where(F.col(f"`{c}`").isNotNull())
    rows = rows.select(
        *keys, F.col(date).alias("_date"), F.col(y).cast("double").alias("_y"),
        *[F.col(f"`{x}`").cast("double").alias(a) for x, a in names.items()])
    kernel = paths.by_entity(lambda part, who: paths.one_factor_fits(part, who, keys, "_y", names, lags, min_obs), keys)
    schema = f"{key_schema(rows, keys)}, which string"
    m = dealt(rows, keys, "_date", placed).mapInArrow(
        kernel, f"{schema}, n long, means array<double>, cov array<double>, meat array<double>")
    return _scoped(keys, by, m.mapInPandas(kernels.sandwiched([*keys, "which"], ["x"]), f"{schema}, {EST}"))


def estimates(fits: DataFrame, n_factors: int) -> DataFrame:
    """Slope rows with significance flags and the Bonferroni threshold."""
    limit = 0.05 / max(n_factors, 1)
    return (fits.where("factor <> 'const'")
            .withColumn("significant_05", F.col("p_value") < 0.05)
            .withColumn("significant_01", F.col("p_value") < 0.01)
            .withColumn("bonferroni_threshold", F.lit(limit)))


def residuals(df: DataFrame, controls: Sequence[str], xs: Sequence[str], by: Sequence[str] = (),
              extra: Sequence[str] = ()) -> DataFrame:
    """Complete rows with every ``xs`` replaced by its residual on [1, controls] (stage 1 of G5)."""
    rows, keys = keyed(df.dropna(subset=[*extra, *controls, *xs]), by)
    c, t = [f"_c{i}" for i in range(len(controls))], [f"_t{i}" for i in range(len(xs))]
    renamed = rows.select("*", *[F.col(f"`{a}`").cast("double").alias(b) for a, b in zip([*controls, *xs], [*c, *t])])
    gamma = moments(renamed, [*c, *t], keys).mapInPandas(
        kernels.projections(list(keys), len(c), len(t)), f"{key_schema(rows, keys)}, gamma array<double>")
    width = len(c) + 1
    joined = renamed.join(gamma, keys)
    out = {}
    for j, x in enumerate(xs):
        base = F.col("gamma")[j * width]
        out[x] = F.col(t[j]) - sum((F.col("gamma")[j * width + 1 + i] * F.col(a) for i, a in enumerate(c)), base)
    return _scoped(keys, by, joined.withColumns(out).drop("gamma", *c, *t))


def residualized(df: DataFrame, y: str, controls: Sequence[str], xs: Sequence[str], by: Sequence[str] = (),
                 lags: int = 5, min_obs: int = MIN_OBS) -> DataFrame:
    """Two-stage regression: factors residualized on the controls, then y on both with HAC errors.

    Contributions use the residual columns and are therefore zero up to rounding; attribution uses raw sums.
    """
    rows = residuals(df, controls, xs, by, [y])
    return ols_hac(rows, y, [*controls, *xs], by, lags, min_obs=min_obs)


def control_columns(available: Sequence[str], benchmark: str = "benchmark_excess") -> list[str]:
    """Benchmark plus those of volatility and credit that exist."""
    return [c for c in [benchmark, *CONTROL_FACTORS] if c in available]


def factor_panel(levels: DataFrame, meta: DataFrame | None = None, curated: Sequence[str] = CURATED_FACTORS) -> DataFrame:
    """Wide stationary factor panel from long level series (G1).

    Business-day calendar, bounded fill by publication frequency, transform, derived spreads, then only rows
    complete in the curated factors that are present.  ``levels`` is factor, date, value; ``meta`` as the registry.
    """
    from . import asof, returns
    spark = levels.sparkSession
    meta = meta if meta is not None else spark.createDataFrame(
        [{k: v for k, v in r.items() if k in ("factor", "transform", "frequency")} for r in factor_registry()],
        "factor string, transform string, frequency string")
    limit = F.coalesce(*[F.when(F.col("frequency") == f, F.lit(n)) for f, n in FFILL_ROWS.items()], F.lit(FFILL_ROWS["daily"]))
    tagged = levels.join(meta.select("factor", "transform", limit.alias("limit")), "factor")
    dense = asof.reindex_ffill(tagged, "factor", "value", F.col("limit"), max(FFILL_ROWS.values()), carry=["transform", "limit"])
    moved = returns.transform_by_kind(dense)
    # the result has a column for each registered factor with data, so their names are known to the caller anyway
    names = [r["factor"] for r in meta.join(levels.select("factor").distinct(), "factor", "left_semi")
             .select("factor").distinct().orderBy("factor").collect()]
    wide = moved.groupBy("date").agg(*[F.max(F.when(F.col("factor") == f, F.col("value"))).alias(f) for f in names])
    for r in factor_registry():
        if r["legs"] and all(leg in names for leg in r["legs"]):
            a, b = r["legs"]
            wide = wide.withColumn(r["factor"], F.col(f"`{a}`") - F.col(f"`{b}`"))
    present = [c for c in curated if c in wide.columns]
    return wide.dropna(subset=[f"`{c}`" for c in present]) if present else wide.dropna(how="all", subset=[
        f"`{c}`" for c in wide.columns if c != "date"])


def factor_validation(long: DataFrame) -> DataFrame:
    """Per factor: valid rows, percent missing, mean, deviation, extreme values, warnings."""
    stats = long.groupBy("factor").agg(
        F.count("value").alias("n_valid"), F.count(F.lit(1)).alias("_rows"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    z = F.abs((F.col("value") - F.col("mean")) / F.col("std"))
    out = (long.join(stats, "factor").groupBy("factor", "n_valid", "_rows", "mean", "std")
           .agg(F.count_if((F.col("std") > 0) & (z > 10)).alias("n_outliers"))
           .withColumn("pct_missing", 100 * (1 - F.col("n_valid") / F.col("_rows"))))
    return out.select("factor", "n_valid", "pct_missing", "mean", "std", "n_outliers", F.concat_ws(
        "; ",
        F.when(F.col("pct_missing") > 10, F.format_string("%.1f%% missing", F.col("pct_missing"))),
        F.when(F.col("std") == 0, F.lit("zero variance — broken")),
        F.when(F.col("n_outliers") > 0, F.concat(F.col("n_outliers").cast("string"), F.lit(" extreme outliers (|z|>10)"))),
    ).alias("warnings"))


# ---- comparisons ------------------------------------------------------------------------------

def _noted(rows: DataFrame, rules: list[tuple[str, str]], raw: str, res: str, p: str) -> DataFrame:
    """``rows`` with what the change between raw and residualized betas means."""
    named = rows.withColumns({"raw": F.col(raw), "res": F.col(res), "p": F.col(p)})
    return named.withColumn("interpretation", first_rule(rules)).drop("raw", "res", "p")


def compare_two(raw: DataFrame, res: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    a = raw.where("factor <> 'const'").select(*by, "factor", F.col("beta").alias("raw_beta"), F.col("p_value").alias("raw_p"))
    b = res.select(*by, "factor", F.col("beta").alias("residualized_beta"), F.col("p_value").alias("residualized_p"))
    both = a.join(b, [*by, "factor"], "left").withColumn("delta", F.col("residualized_beta") - F.col("raw_beta"))
    return _noted(both, TWO_WAY_RULES, "raw_beta", "residualized_beta", "residualized_p")


def compare_three(raw: DataFrame, v1: DataFrame, v2: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, "factor"]
    pick = lambda d, p: d.select(*keys, F.col("beta").alias(f"{p}_beta"), F.col("p_value").alias(f"{p}_p"))
    out = pick(raw.where("factor <> 'const'"), "raw").join(pick(v1, "v1"), keys, "left").join(pick(v2, "v2"), keys, "left")
    return _noted(out, THREE_WAY_RULES, "raw_beta", "v2_beta", "v2_p")


def index_vs_active(index: DataFrame, total: DataFrame, active: DataFrame) -> DataFrame:
    """Three estimates per factor side by side."""
    out = None
    for name, d in (("index", index), ("total", total), ("active", active)):
        part = d.where("factor <> 'const'").select("factor", F.col("beta").alias(f"{name}_beta"), F.col("p_value").alias(f"{name}_p"))
        out = part if out is None else out.join(part, "factor", "full_outer")
    return out


# ---- per entity, rolling ----------------------------------------------------------------------

def rolling_betas(df: DataFrame, y: str, xs: Sequence[str], window: int = 60, by: Sequence[str] = (),
                  date: str = "date", placed: bool = False) -> DataFrame:
    """Plain OLS over the last ``window`` complete rows, one row per date and factor.

    The windows' moments come from blocks as in ``window_moments``; only full windows are solved, all of a task's rows at once.
    ``placed`` as in ``gram.dealt``.
    """
    rows, keys = keyed(df.dropna(subset=[y, *xs]), by)
    names = _safe(xs)
    rows = rows.select(*keys, F.col(date).alias("date"), F.col(y).cast("double").alias("_y"),
                       *[F.col(f"`{x}`").cast("double").alias(a) for x, a in zip(xs, names)])
    kernel = paths.by_entity(lambda part, who: paths.rolled(part, who, [*keys, "date"], ["_y", *names], window), keys)
    solved = dealt(rows, keys, "date", placed).mapInArrow(kernel, f"{key_schema(rows, [*keys, 'date'])}, beta array<double>")
    labels = F.array(*[F.lit(x) for x in xs])
    long = solved.select(*keys, "date", F.posexplode(labels).alias("i", "factor"), "beta")
    return _scoped(keys, by, long.select(*keys, "date", "factor", F.get("beta", F.col("i") + 1).alias("beta")))


def rolling_beta(df: DataFrame, y: str, x: str, window: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Sample covariance over sample variance in full windows (W25); all-null rows are dropped first."""
    rows, keys = keyed(df.dropna(how="all", subset=[y, x]), by)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    masked = rows.withColumns({"_x": F.when(both, F.col(x)).cast("double"), "_y": F.when(both, F.col(y)).cast("double")})
    m = window_moments(masked, ["_x", "_y"], keys, window)
    beta = F.when((F.col("_n") == window) & (F.col("_cov")[0] > 0), F.col("_cov")[1] / F.col("_cov")[0])
    return _scoped(keys, by, m.withColumn("beta", beta).drop("_x", "_y", "_n", "_means", "_cov"))


def pivot_betas(long: DataFrame, factors: Sequence[str], value: str = "beta", key: str = "entity") -> DataFrame:
    """One column per factor of a fixed list."""
    return long.groupBy(key).agg(*[F.first(F.when(F.col("factor") == f, F.col(value)), ignorenulls=True).alias(f) for f in factors])


# ---- uses of betas ----------------------------------------------------------------------------

def shocks_table(spark, shocks=SHOCKS) -> DataFrame:
    return spark.createDataFrame(shocks, "factor string, label string, shock double")


def scenarios(betas: DataFrame, shocks: DataFrame) -> DataFrame:
    """impact = beta x shock, largest absolute impact first."""
    return (betas.where("factor <> 'const'").join(shocks, "factor")
            .withColumn("impact", F.col("beta") * F.col("shock")).orderBy(F.abs("impact").desc(), "factor"))


def attribution(df: DataFrame, portfolio: str, benchmark: str, xs: Sequence[str], by: Sequence[str] = (), lags: int = 5) -> DataFrame:
    """Active return per factor: beta x summed move, with totals (G12); selection contains the intercept."""
    active = df.withColumn("_active", F.col(portfolio) - F.col(benchmark))
    fits = ols_hac(active, "_active", xs, by, lags).where("factor <> 'const'")
    rows, keys = keyed(active.dropna(subset=["_active", *xs]), by)
    total = rows.groupBy(*keys).agg(F.sum("_active").alias("total_active"))
    fits, _ = keyed(fits, by)
    explained = fits.groupBy(*keys).agg(F.sum("contribution").alias("explained"))
    out = (fits.join(explained, keys).join(total, keys)
           .withColumn("selection", F.col("total_active") - F.col("explained"))
           .withColumn("significant_10", F.col("p_value") < 0.10))
    return _scoped(keys, by, out)


def weighted_beta(betas: DataFrame, weights: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """Portfolio beta from entity betas (G16): missing counts as zero, or is skipped with renormalized weights."""
    total = weights.agg(F.sum("weight")).scalar()
    joined = weights.join(betas.where("factor <> 'const' AND beta IS NOT NULL"), "entity")
    agg = joined.groupBy("factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("_wb"), F.sum("weight").alias("_w"))
    if missing_as_zero:
        return agg.withColumn("_t", total).select("factor", F.when(F.col("_t") > 0, F.col("_wb") / F.col("_t"))
                                                  .otherwise(F.lit(0.0)).alias("beta"))
    return agg.select("factor", F.when(F.col("_w") > 0, F.col("_wb") / F.col("_w")).alias("beta"))


def what_if(betas: DataFrame, weights: DataFrame, weight: float) -> DataFrame:
    """Exposure after adding each candidate at ``weight`` (G17): one row per candidate and factor."""
    before = weighted_beta(betas, weights, missing_as_zero=False).withColumnRenamed("beta", "before")
    cand = betas.where("factor <> 'const'").select("entity", "factor", F.col("beta").alias("candidate_beta"))
    after = F.col("before") * (1 - weight) + F.col("candidate_beta") * weight
    return (cand.join(before, "factor").withColumn("after", after)
            .withColumn("delta", F.col("after") - F.col("before")))


def largest_shifts(shifts: DataFrame, k: int = 6) -> DataFrame:
    from .scoring import top_k
    return top_k(shifts.where("delta IS NOT NULL"), ["entity"], [F.abs("delta").desc(), F.col("factor")], k)


def versus_index(betas: DataFrame, index: DataFrame) -> DataFrame:
    """Entity beta minus index beta."""
    ref = index.where("factor <> 'const'").select("factor", F.col("beta").alias("index_beta"))
    return (betas.where("factor <> 'const'").join(ref, "factor")
            .withColumn("gap", F.col("beta") - F.col("index_beta")))


def contributors(betas: DataFrame, weights: DataFrame, portfolio: DataFrame, k: int = 3) -> DataFrame:
    """Largest weighted betas per significant factor, with their share of the total."""
    from .scoring import top_k
    sig = portfolio.where("factor <> 'const' AND p_value < 0.05").select("factor", F.col("beta").alias("total"))
    rows = (betas.join(weights, "entity").join(sig, "factor")
            .withColumn("weighted", F.col("weight") * F.col("beta"))
            .withColumn("share", F.when(F.abs("total") < 1e-9, F.lit(0.0)).otherwise(F.col("weighted") / F.col("total"))))
    return top_k(rows, ["factor"], [F.abs("weighted").desc(), F.col("entity")], k)


def summary(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sample size, fit, annualized intercept and largest VIF (T4)."""
    alpha = F.max(F.when(F.col("factor") == "const", F.col("beta")))
    return fits.groupBy(*by).agg(F.max("n").alias("n"), F.max("r2").alias("r2"), F.max("adj_r2").alias("adj_r2"),
                                 (alpha * 252).alias("alpha_annual"), F.max("vif").alias("max_vif"))
