"""Principal components of feature cross-sections, of return panels and of factor libraries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import COMPONENT_RULES, FACTOR_MIN_COVERAGE, FRENCH_COLUMNS, N_PCS, PC_FAMILIES, SECTOR_LABEL_MIN, UNLABELLED
from ..functions import kernels
from ..functions.expr import first_rule
from ..session import cut_lineage
from . import regress
from .gram import ONE, key_schema, keyed, moments
from .scoring import top_k

VECTOR_CELLS = 1 << 22

MODEL = ("pc string, feature string, loading double, eigenvalue double, variance_ratio double, mean double, "
         "std double, n long")


def standardize(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """z-scores with population deviation per cross-section, zero deviation counts as one (M1)."""
    rows, keys = keyed(df, by)
    stats = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                                    *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    sd = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
    out = rows.join(stats, keys).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / sd(c) for c in cols})
    drop = [f"_{k}_{c}" for k in "ms" for c in cols]
    return out.drop(*drop) if by else out.drop(ONE, *drop)


def fit(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = N_PCS, ddof: int = 0,
        subsets: dict[str, list[str]] | None = None) -> DataFrame:
    """Model table ``by, pc, feature, loading, eigenvalue, variance_ratio, mean, std, n`` for every group (M2).

    All groups are reduced to co-moments by one aggregate; a matrix per group is decomposed on the executors.
    """
    rows, keys = keyed(df.dropna(subset=list(cols)), by)
    schema = f"{key_schema(rows, keys)}, {'config string, ' if subsets else ''}{MODEL}"
    out = moments(rows, cols, keys).mapInPandas(kernels.components(list(keys), list(cols), k, ddof, subsets), schema)
    return out if by else out.drop(ONE)


def explained(model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Variance ratio and its running total per component."""
    per = model.groupBy(*by, "pc").agg(F.max("variance_ratio").alias("variance_ratio"), F.max("eigenvalue").alias("eigenvalue"))
    w = W.partitionBy(*by).orderBy("pc").rowsBetween(W.unboundedPreceding, 0)
    return per.withColumn("cumulative", F.sum("variance_ratio").over(w))


def model_row(model: DataFrame, cols: Sequence[str], by: Sequence[str], pcs: Sequence[str]) -> DataFrame:
    """One row per model with means, deviations and loadings as arrays in feature order."""
    at = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    load = lambda p, f: F.max(F.when((F.col("feature") == f) & (F.col("pc") == p), F.col("loading")))
    return model.groupBy(*by).agg(
        F.array(*[at(f, "mean") for f in cols]).alias("_mean"), F.array(*[at(f, "std") for f in cols]).alias("_std"),
        *[F.array(*[load(p, f) for f in cols]).alias(f"_l_{p}") for p in pcs])


def project(df: DataFrame, model: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = N_PCS,
            keep: Sequence[str] = ("entity",)) -> DataFrame:
    """Scores of rows under a fitted scaler and loadings (M3); new rows use the fitted means.

    ``by`` are the model's keys found in ``df``; without them one model serves all rows.
    """
    pcs = [f"PC{i + 1}" for i in range(k)]
    rows, keys = keyed(df, by)
    source, _ = keyed(model, by)
    row = model_row(source, cols, keys, pcs)
    joined = rows.join(row if by else F.broadcast(row), keys)       # without keys: exactly one model row
    z = [(F.col(c) - F.col("_mean")[i]) / F.col("_std")[i] for i, c in enumerate(cols)]
    score = lambda p: sum((z[i] * F.col(f"_l_{p}")[i] for i in range(1, len(cols))), z[0] * F.col(f"_l_{p}")[0])
    return joined.select(*[c for c in dict.fromkeys([*by, *keep])], *[score(p).alias(p) for p in pcs])


def label_components(model: DataFrame, by: Sequence[str] = (), k: int = 4) -> DataFrame:
    """Family with most hits among the k largest absolute loadings; the first family wins ties (M4)."""
    top = top_k(model, [*by, "pc"], [F.abs("loading").desc(), F.col("feature")], k)
    hits = [F.count_if(F.col("feature").isin(members)) for _, members in PC_FAMILIES]
    agg = top.groupBy(*by, "pc").agg(
        F.array(*[F.struct(h.alias("h"), F.lit(-i).alias("o"), F.lit(name).alias("name"))
                  for i, ((name, _), h) in enumerate(zip(PC_FAMILIES, hits))]).alias("_f"),
        F.max(F.when(F.col("rank") == 1, F.col("feature"))).alias("_a"),
        F.max(F.when(F.col("rank") == 2, F.col("feature"))).alias("_b"))
    best = F.array_max("_f")
    mixed = F.concat(F.lit("Mixed ("), F.concat_ws(", ", "_a", "_b"), F.lit(")"))
    return agg.select(*by, "pc", F.when(best["h"] > 0, best["name"]).otherwise(mixed).alias("label"))


def top_bottom(loadings: DataFrame, k: int = 10, name: str = "entity") -> DataFrame:
    """k largest and k smallest loadings per component with their rank."""
    top = top_k(loadings, ["pc"], [F.col("loading").desc(), F.col(name)], k).withColumn("side", F.lit("top"))
    low = top_k(loadings, ["pc"], [F.col("loading").asc(), F.col(name)], k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


# ---- return space -----------------------------------------------------------------------------

def _calendar_days(returns: DataFrame) -> list[int]:
    """The distinct days; as many as the calendar has."""
    return [r["d"] for r in returns.select(F.unix_date("date").alias("d")).distinct().orderBy("d").collect()]


def _standard_vectors(returns: DataFrame, days: list[int]) -> DataFrame:
    """``entity, z``: one calendar-length vector per entity; an entity has at most one return per day.

    Partitions hold about VECTOR_CELLS days of vectors, so that the arrays of a task do not grow with the number of entities.
    """
    cells = F.collect_list(F.struct(F.unix_date("date").alias("d"), "ret"))
    n = returns.agg(F.approx_count_distinct("entity")).first()[0]
    parts = max(returns.sparkSession.sparkContext.defaultParallelism, -(-n * len(days) // VECTOR_CELLS))
    rows = (returns.where(F.col("ret").isNotNull()).repartition(parts, "entity").groupBy("entity").agg(cells.alias("_c"))
            .select("entity", F.col("_c.d").alias("day"), F.col("_c.ret").alias("ret")))
    kind = returns.schema["entity"].dataType.simpleString()
    return rows.mapInPandas(kernels.standard_vectors(days), f"entity {kind}, z array<double>")


def _leading(vectors: DataFrame, t: int, k: int, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenpairs of the sum of z z' over all vectors, by block Krylov steps.

    A step multiplies the sum with a few day vectors in one job: partial products per partition, added up by Spark.  The driver
    holds days x (a few columns per step), never the day x day matrix.  Steps go on until the pairs no longer move.
    """
    width = min(t, k + 8)

    def times(block: np.ndarray) -> np.ndarray:
        out = np.zeros(block.shape)
        cells = vectors.select("z").mapInPandas(kernels.gram_times(block), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        for r in cells.collect():                   # days x columns of the block
            out[r["i"], r["j"]] = r["v"]
        return out

    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((t, width)))[0]
    product = times(basis)
    last = product
    while True:
        small = basis.T @ product
        val, vec = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(val)[::-1][:min(k, t)]
        val, vec = val[top], vec[:, top]
        pairs = basis @ vec
        off = np.linalg.norm(product @ vec - pairs * val, axis=0)
        if off.max() <= tol * max(val[0], 1e-300) or basis.shape[1] >= t:
            return np.clip(val, 0, None), pairs
        for _ in range(2):                          # twice, for orthogonality to rounding
            last = last - basis @ (basis.T @ last)
        q, r = np.linalg.qr(last)
        q = q[:, np.abs(np.diag(r)) > 1e-12 * max(val[0], 1e-300)][:, :t - basis.shape[1]]
        if not q.shape[1]:
            return np.clip(val, 0, None), pairs
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        last = times(q)
        basis, product = np.hstack([basis, q]), np.hstack([product, last])


def corr_pca(returns: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Principal components of the entity correlation matrix: (loadings, scores, variance).

    Entities are many and days are few, so the leading day vectors are found first; the entity loadings follow from them as a
    distributed product.  Neither the entity x entity nor the day x day matrix exists.
    """
    spark = returns.sparkSession
    days = _calendar_days(returns)
    vectors = cut_lineage(_standard_vectors(returns, days))
    n_entities, t = vectors.count(), len(days)
    if k > n_entities:
        raise ValueError(f"{k} components asked of {n_entities} entities")
    val, vec = _leading(vectors, t, k)
    order = range(len(val))
    pcs = [f"PC{i + 1}" for i in range(len(order))]
    scale = np.where(val > 0, np.sqrt(np.where(val > 0, val, 1.0)), np.inf)
    kind = returns.schema["entity"].dataType.simpleString()
    raw = cut_lineage(vectors.mapInPandas(kernels.entity_loadings(vec / scale, pcs), f"entity {kind}, pc string, loading double"))
    sign = raw.groupBy("pc").agg(F.sign(F.max_by("loading", F.struct(F.abs("loading"), "entity"))).alias("_sign"))
    loadings = raw.join(sign, "pc").select("entity", "pc", (F.col("loading") * F.col("_sign")).alias("loading"))
    cells = [(d, p, float(vec[i, c] * np.sqrt(val[c]))) for i, d in enumerate(days) for c, p in enumerate(pcs)]
    scores = (spark.createDataFrame(cells, "day int, pc string, s double").join(sign, "pc")
              .select(F.date_from_unix_date("day").alias("date"), "pc", (F.col("s") * F.col("_sign")).alias("score")))
    sizes = [(p, float(v / (t - 1)), float(v / (t - 1) / n_entities)) for p, v in zip(pcs, val)]
    return loadings, scores, spark.createDataFrame(sizes, "pc string, eigenvalue double, variance_ratio double")


def marchenko_pastur(n: Column, t: Column) -> Column:
    """Largest eigenvalue of pure noise (R2)."""
    edge = 1 + F.sqrt(n / t)
    return edge * edge


def split_half(returns: DataFrame, k: int) -> DataFrame:
    """Absolute cosine of each component between the first n//2 dates and the rest."""
    days = returns.select("date").distinct()
    order = days.select("date", F.row_number().over(W.orderBy("date")).alias("_r"), F.count(F.lit(1)).over(W.partitionBy()).alias("_n"))
    cut = order.where(F.expr("_r <= _n div 2")).agg(F.max("date")).scalar()
    marked = returns.withColumn("_cut", cut)
    first, second = (marked.where(c).drop("_cut") for c in (F.col("date") <= F.col("_cut"), F.col("date") > F.col("_cut")))
    common = _varying(first).join(_varying(second), "entity", "left_semi")
    a = corr_pca(first.join(common, "entity", "left_semi"), k)[0].withColumnRenamed("loading", "_a")
    b = corr_pca(second.join(common, "entity", "left_semi"), k)[0].withColumnRenamed("loading", "_b")
    size = F.sqrt(F.sum(F.col("_a") * F.col("_a")) * F.sum(F.col("_b") * F.col("_b")))
    cos = F.try_divide(F.abs(F.sum(F.col("_a") * F.col("_b"))), size)
    return (a.join(b, ["entity", "pc"]).groupBy("pc").agg(cos.alias("cosine"))
            .withColumn("verdict", F.when(F.col("cosine") > 0.7, "robust").when(F.col("cosine") < 0.5, "noise").otherwise("weak")))


def _varying(returns: DataFrame) -> DataFrame:
    return returns.groupBy("entity").agg(F.stddev_samp("ret").alias("_s")).where("_s > 0").select("entity")


def factor_correlation(scores: DataFrame, factors: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every component with every factor on complete dates."""
    use = [c for c in cols if c != "RF"]
    rows = scores.join(factors.dropna(subset=use), "date")
    return rows.groupBy("pc").agg(*[F.corr("score", c).alias(c) for c in use])


def join_factors(french: DataFrame, sectors: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Outer union of the factor tables on date (J2); complete dates are chosen later."""
    return french.join(sectors, "date", "full_outer").join(benchmark, "date", "full_outer")


def label_by_factors(corr: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """Names of components from their correlations with the factor columns."""
    known = [*FRENCH_COLUMNS, "Benchmark"]
    filled = corr.select("*", F.struct(*[(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) if c in corr.columns else F.lit(0.0)).alias(c)
                                         for c in known]).alias("_known"))
    named = filled.select("pc", "_known.*").select("pc", first_rule(COMPONENT_RULES).alias("_rule"))
    options = [F.struct(F.abs(F.col(f"`{c}`")).alias("size"), F.col(f"`{c}`").alias("corr"), F.lit(c).alias("name"))
               for c in sectors if c in corr.columns]
    largest = F.array_max(F.array(*options)) if options else F.lit(None).cast("struct<size:double,corr:double,name:string>")
    sector = corr.select("pc", largest.alias("s")).select("pc", F.when(F.col("s.size") > SECTOR_LABEL_MIN, F.concat(
        F.lit("Sector: "), F.when(F.col("s.corr") > 0, "").otherwise("Short "), F.col("s.name"))).alias("_sector"))
    return (corr.join(named, "pc").join(sector, "pc")
            .withColumn("label", F.coalesce("_rule", "_sector", F.lit(UNLABELLED))).drop("_rule", "_sector"))


# ---- portfolio projection ---------------------------------------------------------------------

def align_weights(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """Weights of names in the universe, renormalized (R6); none in the universe is an error."""
    kept = weights.join(universe.select("entity").distinct(), "entity", "left_semi")
    if kept.isEmpty():
        raise ValueError("no weighted name is in the universe")
    total = kept.agg(F.sum("weight")).scalar()
    return kept.withColumn("_t", total).select("entity", (F.col("weight") / F.col("_t")).alias("weight"))


def active_exposure(loadings: DataFrame, weights: DataFrame) -> DataFrame:
    """Portfolio and equal-weight loading, their gap in cross-sectional deviations."""
    w = align_weights(weights, loadings)
    rows = loadings.join(w, "entity", "left")
    agg = rows.groupBy("pc").agg(F.coalesce(F.sum(F.col("weight") * F.col("loading")), F.lit(0.0)).alias("portfolio"),
                                 F.avg("loading").alias("universe"), F.stddev_samp("loading").alias("xs_std"))
    active = F.col("portfolio") - F.col("universe")
    z = F.when(F.col("xs_std") > 0, active / F.col("xs_std")).otherwise(F.lit(0.0))
    return (agg.withColumn("active", active).withColumn("active_z", z)
            .withColumn("tilt", F.when(F.col("active_z") > 1, "overweight").when(F.col("active_z") < -1, "underweight")
                        .otherwise("neutral")))


def variance_decomposition(loadings: DataFrame, variance: DataFrame, weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Share of portfolio variance per component and the rest.

    w'Cw is the variance of the weighted standardized returns, one pass instead of a matrix.
    """
    w = align_weights(weights, loadings)
    vec = _standard_vectors(returns, _calendar_days(returns)).join(w, "entity")
    cells = vec.select("weight", F.posexplode("z").alias("t", "z"))
    series = cells.groupBy("t").agg(F.sum(F.col("weight") * F.col("z")).alias("v"))
    total = series.agg(F.var_samp("v")).scalar()
    port = loadings.join(w, "entity").groupBy("pc").agg(F.sum(F.col("weight") * F.col("loading")).alias("l"))
    parts = (port.join(variance, "pc").withColumn("total", total)
             .select("pc", (F.col("l") * F.col("l") * F.col("eigenvalue")).alias("variance"), "total"))
    rest = parts.agg(F.lit("residual").alias("pc"),
                     F.greatest(F.max("total") - F.sum("variance"), F.lit(0.0)).alias("variance"), F.max("total").alias("total"))
    return parts.unionByName(rest).withColumn("share", F.when(F.col("total") > 0, F.col("variance") / F.col("total")))


def rolling_loadings(portfolio: DataFrame, scores: DataFrame, window: int = 60) -> DataFrame:
    """Rolling beta of the portfolio on every component score."""
    rows = scores.join(portfolio, "date")
    return regress.rolling_beta(rows, "ret", "score", window, ["pc"]).select("pc", "date", "beta")


# ---- factor library ---------------------------------------------------------------------------

def usable_factors(factors: DataFrame, candidates: Sequence[str], min_cov: float = FACTOR_MIN_COVERAGE) -> list[str]:
    """Columns with enough values and some variance (P8), from one aggregate row."""
    row = factors.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(candidates)],
                      *[F.stddev_samp(f"`{c}`").alias(f"s{i}") for i, c in enumerate(candidates)]).first()
    return [c for i, c in enumerate(candidates)
            if row["n"] and row[f"c{i}"] / row["n"] >= min_cov and (row[f"s{i}"] or 0.0) > 0]


def theme_candidates(registry: list[dict], columns: Sequence[str]) -> list[str]:
    """Registered columns except derived legs and monthly series."""
    legs = {leg for r in registry for leg in (r["legs"] or [])}
    return [r["factor"] for r in registry if r["factor"] in columns and r["factor"] not in legs
            and r["frequency"] != "monthly"]


def factor_pca(factors: DataFrame, series: DataFrame, candidates: Sequence[str], names: dict[str, str] | None = None,
               k: int = 6, lags: int = 5, min_obs: int = 60, min_factors: int = 4) -> dict[str, DataFrame] | None:
    """Themes of a factor library and the exposure of several return series to them.

    ``series`` is long (which, date, ret).  None when fewer than ``min_factors`` usable factors or ``min_obs`` rows.
    """
    cols = usable_factors(factors, candidates)
    if len(cols) < min_factors:
        return None
    rows = factors.select("date", *[F.col(f"`{c}`").alias(c) for c in cols]).dropna()
    if rows.limit(min_obs).count() < min_obs:
        return None
    k = min(k, len(cols))
    model = fit(rows, cols, (), k)
    scores = project(rows, model, cols, (), k, keep=["date"])
    pcs = [f"PC{i + 1}" for i in range(k)]
    spread = scores.agg(F.struct(*[F.stddev_pop(p).alias(p) for p in pcs])).scalar()
    unit = scores.withColumn("_s", spread).select("date", *[F.try_divide(F.col(p), F.col(f"_s.{p}")).alias(p) for p in pcs])
    fits = regress.ols_hac(series.join(unit, "date"), "ret", pcs, ["which"], lags)
    top2 = top_k(model, ["pc"], [F.abs("loading").desc(), F.col("feature")], 2)
    shown = F.create_map(*[F.lit(v) for kv in (names or {c: c for c in cols}).items() for v in kv])
    signed = F.concat(F.when(F.col("loading") < 0, F.lit("−")).otherwise(F.lit("+")), F.coalesce(shown[F.col("feature")], F.col("feature")))
    items = F.array_sort(F.collect_list(F.struct("rank", signed.alias("t"))))
    labels = top2.groupBy("pc").agg(F.array_join(F.transform(items, lambda s: s["t"]), " / ").alias("label"))
    return {"model": model, "scores": unit, "labels": labels, "fits": fits,
            "top_loadings": top_k(model, ["pc"], [F.abs("loading").desc(), F.col("feature")], 5)}


def hidden_themes(fits: DataFrame, which: str = "active") -> DataFrame:
    """Themes the active return loads on at ten percent."""
    return fits.where((F.col("which") == which) & (F.col("factor") != "const") & (F.col("p_value") < 0.10))
