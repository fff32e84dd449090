"""Return, momentum, volatility and calendar compounding operators on (entity, date) series.

Inputs hold one row per (entity, date), so per-entity windows are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import TRADING_DAYS
from ..functions import paths

def _by_date():
    return W.partitionBy("entity").orderBy("date")


def simple_returns(prices: DataFrame, pad: bool = False) -> DataFrame:
    """``entity, date, ret`` (W5): gaps are spanned; ``pad`` carries nulls forward first, giving zero returns there."""
    if pad:
        prices = prices.withColumn("adj_close", F.last("adj_close", ignorenulls=True).over(
            _by_date().rowsBetween(W.unboundedPreceding, 0)))
    else:
        prices = prices.where(F.col("adj_close").isNotNull())
    prev = F.lag("adj_close").over(_by_date())
    return (prices.select("entity", "date", (F.try_divide("adj_close", prev) - 1).alias("ret"))
            .where(F.col("ret").isNotNull()))


def transform(kind: str, value: str = "value", key: str = "factor") -> Column:
    """Stationarity transform of a level series."""
    x, prev = F.col(value), F.lag(value).over(W.partitionBy(key).orderBy("date"))
    if kind == "level_change":
        return x - prev
    if kind == "neg_level_change":
        return prev - x
    if kind == "log_return":
        return F.when((x > 0) & (prev > 0), F.ln(x / prev))
    if kind == "pct_change":
        return F.try_divide(x, prev) - 1
    raise ValueError(f"unknown transform {kind!r}")


def transform_by_kind(df: DataFrame, kind: str = "transform", value: str = "value", key: str = "factor") -> DataFrame:
    """All transforms at once, chosen per row by the series' ``kind`` column."""
    out = F.lit(None).cast("double")
    for name in ("level_change", "neg_level_change", "log_return", "pct_change"):
        out = F.when(F.col(kind) == name, transform(name, value, key)).otherwise(out)
    return df.withColumn(value, out)


def price_signals(prices: DataFrame) -> DataFrame:
    """Momentum (W7), annualized volatility (W8) and relative volume (W9) at every (entity, date).

    The last row at or before an as-of date carries the as-of value, so an as-of join gives point-in-time signals.
    Prices and volumes have no nulls here (rows without a close are dropped on ingest).  Rows are dealt by entity once; the
    trailing windows are sums over shifted columns of many entities at a time.
    """
    kind, yearly = prices.schema["entity"].dataType.simpleString(), TRADING_DAYS ** 0.5
    rows = (prices.select("entity", "date", F.col("adj_close").cast("double").alias("adj_close"), F.col("volume").cast("double").alias("volume"))
            .repartition("entity").sortWithinPartitions("entity", "date"))
    kernel = paths.by_entity(lambda part, who: paths.signals(part, who, yearly))
    return rows.mapInArrow(kernel, f"entity {kind}, date date, adj_close double, volume double, momentum_30d double, "
                                   "momentum_90d double, volatility_60d double, relative_volume double")


def week_ending(date: str = "date", anchor: str = "FRI") -> Column:
    """The anchor weekday on or after the date."""
    return F.next_day(F.date_sub(date, 1), anchor)


def _with_empty_weeks(weekly: DataFrame, key: str, value: str) -> DataFrame:
    span = weekly.groupBy(key).agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    spine = span.select(key, F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week"))
    return spine.join(weekly, [key, "week"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def weekly_returns(returns: DataFrame, key: str = "entity", anchor: str = "FRI", fill_empty: bool = False) -> DataFrame:
    """Compounded return per week (A17); empty weeks are absent unless ``fill_empty``."""
    out = (returns.groupBy(key, week_ending(anchor=anchor).alias("week"))
           .agg((F.product(1 + F.col("ret")) - 1).alias("ret")))
    return _with_empty_weeks(out, key, "ret") if fill_empty else out


def weekly_sums(changes: DataFrame, key: str = "factor", anchor: str = "FRI", fill_empty: bool = False) -> DataFrame:
    """Summed changes per week, nulls skipped, all-null weeks zero."""
    out = (changes.groupBy(key, week_ending(anchor=anchor).alias("week"))
           .agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")))
    return _with_empty_weeks(out, key, "value") if fill_empty else out


def min_observations(returns: DataFrame, n: int, key: str = "entity") -> DataFrame:
    """Keep entities with at least ``n`` returns."""
    enough = returns.groupBy(key).agg(F.count("ret").alias("_n")).where(F.col("_n") >= n).select(key)
    return returns.join(enough, key, "left_semi")


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted return per date (A16): weights renormalized over entities with data, missing returns count as zero."""
    present = returns.join(weights, "entity", "left_semi").select("entity").distinct()
    held = weights.join(present, "entity", "left_semi")
    total = held.agg(F.sum("weight")).scalar()
    calendar_rows = returns.groupBy("date").agg(F.lit(1).alias("_d")).drop("_d")
    earned = (returns.join(held, "entity")
              .groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("_wr")))
    return (calendar_rows.join(earned, "date", "left")
            .select("date", F.try_divide(F.coalesce("_wr", F.lit(0.0)), total).alias("ret")))


def excess_returns(returns: DataFrame, annual_pct: DataFrame, limit: int = 5) -> DataFrame:
    """Return minus the daily risk-free rate (G13): annual percent / 100 / 252, carried at most ``limit`` rows."""
    joined = returns.join(annual_pct.select("date", (F.col("value") / 100 / TRADING_DAYS).alias("_rf")), "date", "left")
    keys = [c for c in ("entity",) if c in returns.columns]
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(-limit, 0)
    rf = F.coalesce(F.last("_rf", ignorenulls=True).over(w), F.lit(0.0))
    return joined.withColumn("ret", F.col("ret") - rf).drop("_rf")


def timeframes(end: Column, months: dict[str, int | None]) -> Column:
    """Array of (timeframe, start) for an end date."""
    starts = []
    for name, m in months.items():
        start = (F.trunc(end, "year") if name == "ytd"
                 else F.lit("1900-01-01").cast("date") if m is None else F.add_months(end, -m))
        starts.append(F.struct(F.lit(name).alias("timeframe"), start.alias("start")))
    return F.array(*starts)


def by_timeframe(df: DataFrame, months: dict[str, int | None]) -> DataFrame:
    """Rows copied to every named window they fall in, with ``timeframe`` as a key column."""
    end = df.agg(F.max("date")).scalar()
    return (df.withColumn("_end", end)
            .withColumn("_tf", F.explode(timeframes(F.col("_end"), months)))
            .where(F.col("date") >= F.col("_tf.start"))
            .withColumn("timeframe", F.col("_tf.timeframe")).drop("_tf", "_end"))
