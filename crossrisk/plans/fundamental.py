"""Fundamental feature queries over the order-based statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamentals as FU, returns
from . import views as V
from .registry import query, r6

V.SQL_VIEWS["income"] = (["stmt"], """
    SELECT entity, period_end, max(value) FILTER (item = 'Total Revenue') AS revenue, max(value) FILTER (item = 'EBITDA') AS ebitda,
           max(value) FILTER (item = 'Operating Income') AS operating_income FROM stmt WHERE statement = 'income' GROUP BY 1, 2""")
V.SQL_VIEWS["cash"] = (["stmt"], """
    SELECT entity, period_end, max(value) FILTER (item = 'Operating Cash Flow') AS ocf, max(value) FILTER (item = 'Capital Expenditure') AS capex
    FROM stmt WHERE statement = 'cashflow' GROUP BY 1, 2""")
V.SQL_VIEWS["ttm_income"] = (["income"], """
    SELECT *, sum(coalesce(ebitda, operating_income)) OVER w AS e4, count(coalesce(ebitda, operating_income)) OVER w AS ne,
           sum(operating_income) OVER w AS o4, count(operating_income) OVER w AS no
    FROM income WINDOW w AS (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
V.SQL_VIEWS["ttm_cash"] = (["cash"], """
    SELECT *, sum(ocf) OVER w AS c4, count(ocf) OVER w AS nc, sum(abs(capex)) OVER w AS x4, count(capex) OVER w AS nx
    FROM cash WINDOW w AS (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")


def income(spark, sf_dir):
    items = FU.canonical(V.stmt(spark, sf_dir)).where("statement = 'income'")
    return FU.income_measures(items.select("entity", "period_end", *FU.SHEETS["income"]))


def cashflow(spark, sf_dir):
    items = FU.canonical(V.stmt(spark, sf_dir)).where("statement = 'cashflow'")
    return FU.cashflow_measures(items.select("entity", "period_end", *FU.SHEETS["cashflow"]))


@query("canonical_items", "income", """
    SELECT entity, period_end, revenue, ebitda, coalesce(operating_income, NULL) AS ebit FROM income""")
def canonical_items(spark, sf_dir):
    """aliases in priority order."""
    return FU.canonical(V.stmt(spark, sf_dir)).where("statement = 'income'").select("entity", "period_end", "revenue", "ebitda", "ebit")


@query("ttm", "ttm_income", """
    SELECT entity, period_end, round(CASE WHEN ne > 0 THEN e4 * (CAST(4 AS DOUBLE) / ne) END, 6) AS ebitda_ttm FROM ttm_income""")
def ttm(spark, sf_dir):
    """W22."""
    return income(spark, sf_dir).select("entity", "period_end", r6("ebitda_ttm"))


@query("fcf_ttm", "ttm_cash", """
    SELECT entity, period_end, round(CASE WHEN nc > 0 THEN c4 * (CAST(4 AS DOUBLE) / nc) END
             - coalesce(CASE WHEN nx > 0 THEN x4 * (CAST(4 AS DOUBLE) / nx) END, 0), 6) AS fcf FROM ttm_cash""")
def fcf_ttm(spark, sf_dir):
    """Both flows scaled separately."""
    return cashflow(spark, sf_dir).select("entity", "period_end", r6("fcf_ttm", "fcf"))


@query("yoy", "income", """
    SELECT entity, period_end, round(CASE WHEN p > 0 AND revenue <> 0 THEN greatest(-0.5, least(1.0, (revenue - p) / p)) END, 6) AS growth
    FROM (SELECT *, lag(revenue, 4) OVER (PARTITION BY entity ORDER BY period_end) AS p FROM income)""")
def yoy(spark, sf_dir):
    """W23, F11, F12."""
    items = FU.canonical(V.stmt(spark, sf_dir)).where("statement = 'income'")
    return items.select("entity", "period_end", r6(FU.yoy("revenue", -0.5, 1.0), "growth"))


V.SQL_VIEWS["vendor"] = ([], """
    SELECT CAST(c_custkey AS VARCHAR) AS entity, c_acctbal * 100000 AS market_cap, c_mktsegment AS sector, c_custkey FROM customer""")
V.SQL_VIEWS["fund"] = (["vendor", "ttm_income", "ttm_cash"], """
    SELECT v.*, i.revenue, i.operating_income AS ebit, CASE WHEN ne > 0 THEN e4 * (CAST(4 AS DOUBLE) / ne) END AS ebitda_ttm, i.o4, i.no,
           k.c4, k.nc, CASE WHEN nc > 0 THEN c4 * (CAST(4 AS DOUBLE) / nc) END
             - coalesce(CASE WHEN nx > 0 THEN x4 * (CAST(4 AS DOUBLE) / nx) END, 0) AS fcf,
           CASE WHEN c_custkey % 3 <> 0 THEN 2e8 END AS total_debt, 5e7 AS cash_, 4e8 AS total_assets, 3e8 AS total_liabilities,
           CASE WHEN c_custkey % 4 <> 0 THEN 1e8 END AS current_assets, 8e7 AS current_liabilities
    FROM vendor v
    LEFT JOIN (SELECT * FROM ttm_income WHERE period_end <= DATE '2000-12-31' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) = 1) i USING (entity)
    LEFT JOIN (SELECT * FROM ttm_cash WHERE period_end <= DATE '2000-12-31' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period_end DESC) = 1) k USING (entity)""")


@V.stored
def features(spark, sf_dir):
    """Feature rows of all customers as of the end of 2000; the balance sheet is one synthetic quarter per customer."""
    c = V.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    sheet = F.array(*[F.struct(F.lit(n).alias("item"), v.alias("value")) for n, v in (
        ("Total Debt", F.when(key % 3 != 0, F.lit(2e8))), ("Cash", F.lit(5e7)), ("Total Assets", F.lit(4e8)),
        ("Total Liab", F.lit(3e8)), ("Total Current Assets", F.when(key % 4 != 0, F.lit(1e8))),
        ("Current Liabilities", F.lit(8e7)))])
    # customers lie in a few row groups; dealt anew, no task makes and sums the items of a whole one
    balance = c.select("c_custkey").repartition("c_custkey") \
        .select(key.cast("string").alias("entity"), F.lit("balance").alias("statement"),
                F.lit("2000-09-30").cast("date").alias("period_end"), F.explode(sheet).alias("s")) \
        .select("entity", "statement", "period_end", "s.item", "s.value")
    info = c.select(key.cast("string").alias("entity"), (F.col("c_acctbal") * 100000).alias("market_cap"),
                    F.col("c_mktsegment").alias("info_sector"), F.col("c_name").alias("long_name"),
                    F.when(key % 5 == 0, 0.12).otherwise(12.5).alias("short_float"), (F.col("c_acctbal") / 100).alias("trailing_pe"),
                    (F.col("c_acctbal") / 300 - 5).alias("ev_multiple"))
    days = F.array(F.lit("2000-12-31").cast("date"))
    return FU.build_features(V.stmt(spark, sf_dir).unionByName(balance), info, returns.price_signals(V.prices(spark, sf_dir)),
                             V.filings(spark, sf_dir), days)


@query("altman", "fund", """
    SELECT entity, CASE WHEN market_cap <> 0 AND CAST(current_assets IS NOT NULL AS INT) + CAST(ebit IS NOT NULL AS INT) + 1 + CAST(revenue IS NOT NULL AS INT) >= 3
      THEN round(coalesce(1.2 * (current_assets - current_liabilities) / total_assets, 0) + coalesce(3.3 * ebit / total_assets, 0)
             + 0.6 * market_cap / total_liabilities + coalesce(revenue / total_assets, 0), 6) END AS altman_z,
      round(current_assets / current_liabilities, 6) AS current_ratio FROM fund""")
def altman(spark, sf_dir):
    """F2, F3, P2."""
    return features(spark, sf_dir).select("entity", r6("altman_z"), r6("current_ratio"))


@query("net_debt_ebitda", "fund", """
    SELECT entity, round(CASE WHEN total_debt IS NULL THEN NULL WHEN ebitda_ttm IS NULL OR ebitda_ttm <= 0 THEN 20
             ELSE greatest(-20, least(20, (total_debt - cash_) / ebitda_ttm)) END, 6) AS net_debt_to_ebitda FROM fund""")
def net_debt_ebitda(spark, sf_dir):
    """F4."""
    return features(spark, sf_dir).select("entity", r6("net_debt_to_ebitda"))


@query("fcf_yield", "fund", """
    SELECT entity, round(CASE WHEN market_cap <> 0 AND market_cap + total_debt - cash_ > 0 THEN fcf / (market_cap + total_debt - cash_) END, 6) AS fcf_yield FROM fund""")
def fcf_yield(spark, sf_dir):
    """F5."""
    return features(spark, sf_dir).select("entity", r6("fcf_yield"))


@query("interest_coverage", "fund", """
    SELECT entity, CASE WHEN coalesce(no, 0) = 0 THEN NULL ELSE CAST(50 AS DOUBLE) END AS interest_coverage FROM fund""")
def interest_coverage(spark, sf_dir):
    """these statements carry no interest."""
    return features(spark, sf_dir).select("entity", r6("interest_coverage"))


@query("valuation", "fund", """
    SELECT entity, round(least(abs(market_cap / 100000 / 100), 200), 6) AS pe_ratio, market_cap / 100000 / 100 < 0 AS earnings_negative,
           round(CASE WHEN market_cap / 100000 / 300 - 5 <= 0 THEN 50 ELSE least(market_cap / 100000 / 300 - 5, 50) END, 6) AS ev_to_ebitda,
           round(CASE WHEN c_custkey % 5 = 0 THEN 12 ELSE 12.5 END, 6)::DOUBLE AS short_pct_float, sector FROM fund""")
def valuation(spark, sf_dir):
    """F7, F8, F9, F14, P3."""
    return features(spark, sf_dir).select("entity", r6("pe_ratio"), "earnings_negative", r6("ev_to_ebitda"), r6("short_pct_float"), "sector")




# ---- statements of suppliers, so that every branch has values -----------------------------------

V.SQL_VIEWS["supplier_quarter"] = ([], """
    SELECT CAST(l_suppkey AS VARCHAR) AS entity, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS revenue, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) * 100000 AS cash,
           CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 100000 AS interest, CAST(count(*) AS DOUBLE) AS shares
    FROM lineitem GROUP BY 1, 2""")


def supplier_statements(spark, sf_dir):
    """entity, statement, period_end, item, value of every supplier and quarter; every fifth supplier pays no interest."""
    end = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2))
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
    rows = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity"), end.alias("period_end")).agg(
        cents("l_extendedprice").alias("revenue"), (F.sum(F.col("l_quantity").cast("long")).cast("double") * 100000).alias("cash"),
        (cents("l_tax") * 100000).alias("interest"), F.count(F.lit(1)).cast("double").alias("shares"))
    pays = F.when(F.col("entity").cast("long") % 5 != 0, F.col("interest"))
    items = [("income", "Net Income", F.col("revenue")), ("income", "EBIT", F.col("cash")), ("income", "Interest Expense", -pays),
             ("cashflow", "Operating Cash Flow", F.col("cash")), ("balance", "Total Assets", F.col("revenue")),
             ("balance", "Ordinary Shares Number", F.col("shares"))]
    long = F.explode(F.array(*[F.struct(F.lit(s).alias("statement"), F.lit(i).alias("item"), v.alias("value")) for s, i, v in items]))
    return rows.select("entity", "period_end", long.alias("r")).select("entity", "r.statement", "period_end", "r.item", "r.value")


@query("accruals_growth", "supplier_quarter", """
    , q AS (SELECT *, sum(cash) OVER w AS ocf, sum(revenue) OVER w AS ni, count(*) OVER w AS n, lag(revenue, 4) OVER o AS ta4, lag(shares, 4) OVER o AS sh4
            FROM supplier_quarter WINDOW o AS (PARTITION BY entity ORDER BY period_end), w AS (o ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT entity, period_end, CASE WHEN n >= 4 AND abs(ni) >= 1e6 THEN round(greatest(-1, least(3, ocf / ni)), 6) END AS accruals_ratio,
           CASE WHEN ta4 > 0 AND revenue <> 0 THEN round(greatest(-0.5, least(1, (revenue - ta4) / ta4)), 6) + 0.0 END AS asset_growth_yoy,
           CASE WHEN sh4 > 0 AND shares <> 0 THEN round(greatest(-0.3, least(0.5, (shares - sh4) / sh4)), 6) + 0.0 END AS net_issuance_yoy FROM q""")
def accruals_growth(spark, sf_dir):
    """Every supplier and quarter."""
    items = FU.canonical(supplier_statements(spark, sf_dir))
    part = lambda s: items.where(F.col("statement") == s)
    rows = (FU.income_measures(part("income")).join(FU.cashflow_measures(part("cashflow")), ["entity", "period_end"])
            .join(FU.balance_measures(part("balance")).select("entity", "period_end", "asset_growth_yoy", "net_issuance_yoy"), ["entity", "period_end"]))
    return rows.select("entity", "period_end", r6(FU.accruals_ratio(), "accruals_ratio"), r6("asset_growth_yoy"), r6("net_issuance_yoy"))
