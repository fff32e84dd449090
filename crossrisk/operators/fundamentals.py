"""Fundamental, valuation and event features from long statements; column expressions only.

Statements are long (entity, statement, period_end, item, value).  Canonical items are pivoted to one row per
(entity, statement, quarter), which bounds every per-entity window by the number of quarters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import FEATURES, FINANCIAL_SECTORS, LINE_ITEMS, TRADING_DAYS  # noqa: F401
from ..functions.expr import clamp, first_non_empty
from . import asof

SHEETS: dict[str, list[str]] = {
    "balance": ["total_assets", "current_assets", "current_liabilities", "total_liabilities", "retained_earnings",
                "long_term_debt", "short_term_debt", "total_debt", "cash", "common_stock_shares"],
    "income": ["revenue", "gross_profit", "operating_income", "ebit", "ebitda", "net_income", "interest_expense",
               "depreciation_amortization"],
    "cashflow": ["operating_cash_flow", "capex"],
}


def canonical(stmt: DataFrame, aliases: dict[str, list[str]] = LINE_ITEMS) -> DataFrame:
    """One row per (entity, statement, period_end) with canonical items as columns (F1).

    The first non-null alias in priority order wins; one alias may serve several items.
    """
    present = stmt.where(F.col("value").isNotNull())
    picks = []
    for item, names in aliases.items():
        order = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, i)])[F.col("item")]
        picks.append(F.min_by("value", order).alias(item))
    return present.groupBy("entity", "statement", "period_end").agg(*picks)


def _ttm(col: Column, w) -> tuple[Column, Column, Column]:
    """Sum and count over the quarter and its three predecessors, and the sum scaled to four quarters."""
    total, n = F.sum(col).over(w), F.count(col).over(w)
    return total, n, F.when(n > 0, total * (4.0 / n))


def quarter_window():
    return W.partitionBy("entity").orderBy("period_end")


def income_measures(income: DataFrame) -> DataFrame:
    last4 = quarter_window().rowsBetween(-3, 0)
    quarter_ebitda = F.coalesce("ebitda", F.col("operating_income") + F.coalesce("depreciation_amortization", F.lit(0.0)))
    rows = income.withColumn("_e", quarter_ebitda)
    _, _, ebitda_ttm = _ttm(F.col("_e"), last4)
    ebit, n_ebit, _ = _ttm(F.col("ebit"), last4)
    interest, _, _ = _ttm(F.abs(F.col("interest_expense")), last4)
    ni, n_ni, _ = _ttm(F.col("net_income"), last4)
    return rows.select(
        "entity", "period_end", "ebit", "revenue", ebitda_ttm.alias("ebitda_ttm"), ebit.alias("ebit_4q"),
        n_ebit.alias("n_ebit"), interest.alias("interest_4q"), ni.alias("ni_4q"), n_ni.alias("n_ni"),
        F.count(F.lit(1)).over(last4).alias("income_quarters"))


def cashflow_measures(cashflow: DataFrame) -> DataFrame:
    last4 = quarter_window().rowsBetween(-3, 0)
    ocf, n_ocf, ocf_ttm = _ttm(F.col("operating_cash_flow"), last4)
    _, _, capex_ttm = _ttm(F.abs(F.col("capex")), last4)
    return cashflow.select(
        "entity", "period_end", ocf.alias("ocf_4q"), n_ocf.alias("n_ocf"),
        (ocf_ttm - F.coalesce(capex_ttm, F.lit(0.0))).alias("fcf_ttm"),
        F.count(F.lit(1)).over(last4).alias("cashflow_quarters"))


def yoy(col: str, lo: float, hi: float) -> Column:
    """Change against four quarters earlier, clamped; needs a positive base."""
    prior = F.lag(col, 4).over(quarter_window())
    return F.when((prior > 0) & (F.col(col) != 0), clamp((F.col(col) - prior) / prior, lo, hi))


def balance_measures(balance: DataFrame) -> DataFrame:
    return balance.withColumn("asset_growth_yoy", yoy("total_assets", -0.5, 1.0)) \
                  .withColumn("net_issuance_yoy", yoy("common_stock_shares", -0.3, 0.5))


def _positive_or_null(c: str) -> Column:
    return F.when(F.col(c) != 0, F.col(c))


def altman_z() -> Column:
    """Five weighted ratios, missing ones skipped, at least three needed; null for financial sectors (F2)."""
    ta, tl = F.col("total_assets"), F.col("total_liabilities")
    mcap = F.coalesce(_positive_or_null("market_cap"),
                      F.coalesce(_positive_or_null("current_price"), _positive_or_null("regular_price"))
                      * _positive_or_null("shares_outstanding"))
    parts = [F.try_divide(1.2 * (F.col("current_assets") - F.col("current_liabilities")), ta),
             F.try_divide(1.4 * F.col("retained_earnings"), ta), F.try_divide(3.3 * F.col("ebit"), ta),
             F.try_divide(0.6 * mcap, tl), F.try_divide("revenue", ta)]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    n = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return F.when(~F.col("is_financial") & (ta > 0) & (tl > 0) & (mcap != 0) & (n >= 3), total)


def current_ratio() -> Column:
    return F.when(F.col("current_liabilities") > 0, F.col("current_assets") / F.col("current_liabilities"))


def net_debt_to_ebitda() -> Column:
    """Null without debt, 20 when EBITDA is missing or not positive, clamped to ±20."""
    parts = F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0))
    some = (F.coalesce("long_term_debt", F.lit(0.0)) != 0) | (F.coalesce("short_term_debt", F.lit(0.0)) != 0)
    debt = F.coalesce(F.col("total_debt"), F.when(some, parts))
    ratio = F.try_divide(debt - F.coalesce("cash", F.lit(0.0)), "ebitda_ttm")
    return (F.when(debt.isNull(), F.lit(None).cast("double"))
            .when(F.col("ebitda_ttm").isNull() | (F.col("ebitda_ttm") <= 0), F.lit(20.0))
            .otherwise(clamp(ratio, -20.0, 20.0)))


def enterprise_value() -> Column:
    built = _positive_or_null("market_cap") + F.col("total_debt") - F.coalesce("cash", F.lit(0.0))
    return F.coalesce(_positive_or_null("enterprise_value"), built)


def fcf_yield() -> Column:
    ev = enterprise_value()
    return F.when(ev > 0, F.col("fcf_ttm") / ev)


def interest_coverage() -> Column:
    """50 without interest, clamped to ±50, null without EBIT."""
    return (F.when(F.coalesce("n_ebit", F.lit(0)) == 0, F.lit(None).cast("double"))
            .when(F.coalesce("interest_4q", F.lit(0.0)) <= 0, F.lit(50.0))
            .otherwise(clamp(F.col("ebit_4q") / F.col("interest_4q"), -50.0, 50.0)))


def _raw_pe() -> Column:
    price = F.coalesce(_positive_or_null("current_price"), _positive_or_null("regular_price"))
    return F.coalesce(F.col("trailing_pe"), price / _positive_or_null("trailing_eps"))


def pe_ratio() -> Column:
    return F.least(F.abs(_raw_pe()), F.lit(200.0) + 0 * _raw_pe())


def earnings_negative() -> Column:
    return F.coalesce(_raw_pe() < 0, F.lit(False))


def ev_to_ebitda() -> Column:
    """The given multiple, else EV over trailing EBITDA; not positive counts as 50, cap 50 (F8)."""
    given = F.col("ev_multiple")
    built = F.try_divide(_positive_or_null("enterprise_value"), "ebitda_ttm")
    capped = lambda c: F.when(c <= 0, F.lit(50.0)).otherwise(clamp(c, float("-inf"), 50.0))
    no_ev = _positive_or_null("enterprise_value").isNull() | F.col("ebitda_ttm").isNull()
    return (F.when(given.isNotNull(), capped(given)).when(no_ev, F.lit(None).cast("double"))
            .when(F.col("ebitda_ttm") <= 0, F.lit(50.0)).otherwise(clamp(built, float("-inf"), 50.0)))


def short_pct_float() -> Column:
    """Ratios up to 1 become percent."""
    return F.when(F.col("short_float") <= 1, F.col("short_float") * 100).otherwise(F.col("short_float"))


def accruals_ratio() -> Column:
    """OCF / NI over four quarters; both statements complete, two values each, |NI| at least a million."""
    ok = ((F.col("income_quarters") >= 4) & (F.col("cashflow_quarters") >= 4) & (F.col("n_ocf") >= 2)
          & (F.col("n_ni") >= 2) & (F.abs(F.col("ni_4q")) >= 1e6))
    return F.when(ok, clamp(F.col("ocf_4q") / F.col("ni_4q"), -1.0, 3.0))


def trailing_event_count(filings: DataFrame, known: DataFrame, dates: Column, days: int = 90, form: str = "8-K") -> DataFrame:
    """Events of one form in [as_of - days, as_of]; known entities without events get 0.

    Events are counted per day before anything is expanded, so a hot entity moves one row per day.
    """
    daily = filings.where(F.col("form") == form).groupBy("entity", "filed").agg(F.count(F.lit(1)).alias("k"))
    inside = asof.expand_dates(daily, dates, F.col("filed"), F.date_add("filed", days + 1))
    counts = inside.groupBy("entity", "as_of").agg(F.sum("k").alias("n"))
    spine = known.select("entity").withColumn("_d", dates).withColumn("as_of", F.explode("_d")).drop("_d")
    return spine.join(counts, ["entity", "as_of"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


INFO_DEFAULTS = ["market_cap", "current_price", "regular_price", "shares_outstanding", "enterprise_value",
                 "ev_multiple", "trailing_pe", "trailing_eps", "short_float"]


def statement_features(stmt: DataFrame, dates: Column) -> DataFrame:
    """Statement measures per (entity, as_of): the newest quarter of each statement on or before the date.

    Each statement is resolved by its own period_end; a date older than every quarter gives no row.
    """
    items = canonical(stmt)
    sheets = {
        "balance": balance_measures(items.where("statement = 'balance'").select("entity", "period_end", *SHEETS["balance"])),
        "income": income_measures(items.where("statement = 'income'").select("entity", "period_end", *SHEETS["income"])),
        "cashflow": cashflow_measures(items.where("statement = 'cashflow'")
                                      .select("entity", "period_end", *SHEETS["cashflow"])),
    }
    out = None
    for name, df in sheets.items():
        now = asof.features_asof(df, dates, date="period_end", src=f"{name}_end")
        out = now if out is None else out.join(now, ["entity", "as_of"], "full_outer")
    return out


def build_features(stmt: DataFrame, info: DataFrame, signals: DataFrame, events: DataFrame, dates: Column,
                   known: DataFrame | None = None) -> DataFrame:
    """Feature rows per (entity, as_of): metadata, 16 features and the negative-earnings flag.

    ``info`` is one row per entity with metadata and the vendor fields (missing ones are null), ``signals`` the
    output of ``returns.price_signals``, ``events`` the filings.  Entities of ``info`` define the rows.
    """
    for c in INFO_DEFAULTS:
        if c not in info.columns:
            info = info.withColumn(c, F.lit(None).cast("double"))
    for c in ("info_sector", "universe_sector", "long_name", "short_name", "universe_name", "industry"):
        if c not in info.columns:
            info = info.withColumn(c, F.lit(None).cast("string"))
    spine = info.withColumn("_d", dates).withColumn("as_of", F.explode("_d")).drop("_d")
    keys = ["entity", "as_of"]
    px = asof.features_asof(signals.drop("adj_close", "volume"), dates, src="px_date")
    counts = trailing_event_count(events, known if known is not None else events.select("entity").distinct(), dates)
    rows = (spine.join(statement_features(stmt, dates), keys, "left").join(px, keys, "left")
            .join(counts, keys, "left")
            .withColumn("sector", first_non_empty("info_sector", "universe_sector", default="Unknown"))
            .withColumn("name", first_non_empty("long_name", "short_name", "universe_name", "entity"))
            .withColumn("is_financial", F.col("sector").isin(FINANCIAL_SECTORS)))
    return rows.select(
        F.col("as_of").alias("date"), "entity", "name", "sector", "is_financial", "industry", "market_cap",
        earnings_negative().alias("earnings_negative"),
        altman_z().alias("altman_z"), current_ratio().alias("current_ratio"),
        net_debt_to_ebitda().alias("net_debt_to_ebitda"), fcf_yield().alias("fcf_yield"),
        interest_coverage().alias("interest_coverage"), accruals_ratio().alias("accruals_ratio"),
        "asset_growth_yoy", "net_issuance_yoy", short_pct_float().alias("short_pct_float"),
        "momentum_30d", "momentum_90d", "volatility_60d", "relative_volume",
        pe_ratio().alias("pe_ratio"), ev_to_ebitda().alias("ev_to_ebitda"),
        F.col("n").cast("double").alias("filing_count_90d"))
