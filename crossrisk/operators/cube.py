"""Period cube: the regressions of all named timeframes from one pass over the rows.

Timeframes end on the same day, so they are nested: a row's *period* is the number of timeframe starts after it, and a timeframe is
the sum of the periods inside it.  Rows are never copied to timeframes.  What is summed is additive:

* products of two of [1, x, y], from which coefficients and fit follow;
* for the HAC meat, products of those products with their Bartlett-weighted sums over the next ``lags`` rows.  A score is linear in
  them once the coefficients of a timeframe are known.  A pair of rows belongs to the period of its *older* row: the newer row is in
  every timeframe that holds the older one, so pairs that cross a start are left out exactly where they should be.

Columns are standardized by their group's own moments, which keeps the sums of products well scaled; results come back in the units
of the input.  One shuffle on the group keys serves standardization, leads, periods and timeframes.  A group has at most one row for
each day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import MIN_OBS, TIMEFRAMES
from ..functions import kernels
from .gram import key_schema, keyed
from .regress import EST, _scoped
from .returns import timeframes

FIT = ("n long, beta array<double>, inv array<double>, r2 double, adj_r2 double, resid_std double, vif array<double>, "
       "means array<double>, meat array<double>")


def period_sums(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], months: dict[str, int | None] = TIMEFRAMES,
                lags: int = 5, date: str = "date", last: Column | None = None) -> DataFrame:
    """``by, timeframe, center, scale, sums``: the additive sums of every timeframe that has rows.

    ``sums`` holds the products of two of [1, xs, y], then the upper triangle of the lagged products of all of these but y * y.
    Rows with a null in ``y`` or ``xs`` are left out; the timeframes end on ``last``, or the last date of ``df``, left-out rows included.
    """
    keys, cols = list(by), [*xs, y]
    names = [f"_z{i}" for i in range(len(cols))]
    starts = timeframes(df.agg(F.max(date)).scalar() if last is None else last, months)
    rows = df.dropna(subset=cols).select(*keys, F.col(date).alias("_date"), *[F.col(f"`{c}`").cast("double").alias(z) for c, z in zip(cols, names)])
    group, order = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_date")
    ends = ["", *[f"_{lag}" for lag in range(1, lags + 1)]]
    rows = rows.select("*", *[F.lead(z, lag).over(order).alias(f"{z}_{lag}") for lag in range(1, lags + 1) for z in names])
    sd = [F.stddev_pop(z).over(group) for z in names]
    rows = rows.select("*", F.array(*[F.avg(z).over(group) for z in names]).alias("center"),
                       F.array(*[F.when(s > 0, s).otherwise(1.0) for s in sd]).alias("scale"))
    rows = rows.withColumns({z + e: (F.col(z + e) - F.col("center")[i]) / F.col("scale")[i] for e in ends for i, z in enumerate(names)})

    pairs = [(i, j) for i in range(len(cols) + 1) for j in range(i, len(cols) + 1)]
    at = lambda i, end="": F.col(names[i - 1] + end) if i else F.lit(1.0)
    there = lambda lag: F.col(f"{names[-1]}_{lag}").isNotNull()
    later = lambda i, j: sum((F.when(there(lag), at(i, f"_{lag}") * at(j, f"_{lag}") * (1.0 - lag / (lags + 1))).otherwise(0.0)
                              for lag in range(1, lags + 1)), F.lit(0.0))
    p = len(pairs) - 1
    rows = rows.select(*keys, "_date", "center", "scale", *[(at(i) * at(j)).alias(f"_m{q}") for q, (i, j) in enumerate(pairs)],
                       *[later(i, j).alias(f"_v{q}") for q, (i, j) in enumerate(pairs[:-1])])
    m, v = (lambda q: F.col(f"_m{q}")), (lambda q: F.col(f"_v{q}"))
    terms = [m(q) for q in range(p + 1)] + [m(a) * m(b) + m(a) * v(b) + v(a) * m(b) for a in range(p) for b in range(a, p)]
    outside = F.size(F.filter("_starts", lambda s: s["start"] > F.col("_date")))
    periods = (rows.withColumn("_starts", starts).groupBy(*keys, outside.alias("_outside"))
               .agg(F.first("center").alias("center"), F.first("scale").alias("scale"),
                    *[F.sum(t).alias(f"_s{q}") for q, t in enumerate(terms)]))
    # a timeframe holds the periods with no more starts after them than lie after its own start
    holds = F.filter("_starts", lambda s: F.size(F.filter("_starts", lambda t: t["start"] > s["start"])) >= F.col("_outside"))
    return (periods.withColumn("_starts", starts).withColumn("timeframe", F.explode(F.transform(holds, lambda s: s["timeframe"])))
            .groupBy(*keys, "timeframe")
            .agg(F.first("center").alias("center"), F.first("scale").alias("scale"),
                 F.array(*[F.sum(f"_s{q}") for q in range(len(terms))]).alias("sums")))


def timeframe_fits(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), months: dict[str, int | None] = TIMEFRAMES,
                   lags: int = 5, date: str = "date", min_obs: int = MIN_OBS, controls: Sequence[str] = (),
                   last: Column | None = None) -> DataFrame:
    """``ols_hac`` for every group and timeframe, with ``timeframe`` after the keys; groups below ``min_obs`` rows have no estimates.

    With ``controls``, ``xs`` are residualized on them inside each timeframe first (G5): both stages follow from the same sums.
    Meant for a few regressors: their number k gives about (k + 2)^4 / 8 sums.
    """
    rows, keys = keyed(df, by)
    names = [*controls, *xs]
    sums = period_sums(rows, y, names, keys, months, lags, date, last)
    keyed_by = [*keys, "timeframe"]
    schema = f"{key_schema(rows, keys)}, timeframe string"
    fits = sums.where(F.col("sums")[0] >= min_obs).mapInPandas(
        kernels.cube_solver(keyed_by, len(names), len(controls)), f"{schema}, {FIT}")
    return _scoped(keys, by, fits.mapInPandas(kernels.sandwich(keyed_by, names), f"{schema}, {EST}"))
