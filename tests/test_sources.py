import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from crossrisk.config import factor_registry
from crossrisk.functions import expr as X
from crossrisk.operators import regress
from crossrisk.sources import landed, schema, sinks, store

D = dt.date


def _store(spark, path, duplicate=False, bad_date=False):
    feats = [("2020-01-31", "a.b ", "S", 1.0), ("2020-01-31", "C", "S", 2.0)] + ([("2020-01-31", "A-B", "S", 1.0)] if duplicate else [])
    if bad_date:
        feats.append(("not a day", "x", "S", 1.0))
    spark.createDataFrame(feats, "date string, ticker string, Sector string, altman_z double").write.parquet(f"{path}/features.parquet")
    spark.createDataFrame([(D(2020, 1, 31), "c", 1.0), (D(2020, 2, 1), "c", None)], "date date, ticker string, adj_close double") \
        .write.parquet(f"{path}/prices.parquet")


def test_store_optional_tables_and_flag(spark, tmp_path):
    _store(spark, str(tmp_path))
    s = store.load_store(spark, str(tmp_path))
    assert not s.survivorship_safe and s.holdings is None and s.prices.count() == 1
    assert sorted(r["entity"] for r in s.features.collect()) == ["A-B", "C"]


def test_store_rejects_duplicates_dates_and_missing(spark, tmp_path):
    _store(spark, str(tmp_path / "dup"), duplicate=True)
    with pytest.raises(ValueError, match="duplicate"):
        store.load_store(spark, str(tmp_path / "dup"))
    _store(spark, str(tmp_path / "bad"), bad_date=True)
    with pytest.raises(ValueError, match="unparseable"):
        store.load_store(spark, str(tmp_path / "bad"))
    with pytest.raises(FileNotFoundError):
        store.load_store(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="missing columns"):
        schema.require_columns(spark.range(1), ["date"], "t")


def test_universe_csv(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text("Symbol,Security,GICS Sector,GICS Sub-Industry\nbrk.b,Berkshire,Fin,Ins\nBRK-B,Again,X,Y\nzz,Zed,Tech,Soft\n")
    u = {r["entity"]: r for r in landed.load_universe(spark, str(p), 2).collect()}
    assert set(u) == {"BRK-B", "ZZ"} and u["BRK-B"]["name"] == "Berkshire" and u["ZZ"]["industry"] == "Soft"
    with pytest.raises(ValueError):
        landed.load_universe(spark, str(p), 400)


def test_batch_and_manual_and_block(spark, tmp_path):
    b = tmp_path / "keys.txt"
    b.write_text("aa\n\n# note\n bb \n")
    assert sorted(r["entity"] for r in landed.batch_keys(spark, str(b)).collect()) == ["AA", "BB"]
    m = tmp_path / "m.csv"
    m.write_text(" Date ,VALUE\n2020-01-01,1.5\n2020-02-01,oops\n2020-03-01,2\n2020-04-01,3\n")
    assert [r["value"] for r in landed.read_manual(spark, str(m), "2020-01-01", "2020-03-31").orderBy("date").collect()] == [1.5, 2.0]
    f = tmp_path / "ff.txt"
    f.write_text("Some preamble\n\n,Mkt-RF,SMB\n20200102,  1.00, -0.50\n20200103, 2.00,x\n\n Annual\n20210101,9,9\n")
    out = sorted((r["date"], r["factor"], r["value"]) for r in landed.read_daily_block(spark, str(f)).collect())
    assert out == [(D(2020, 1, 2), "Mkt-RF", 0.01), (D(2020, 1, 2), "SMB", -0.005), (D(2020, 1, 3), "Mkt-RF", 0.02)]
    mom = spark.createDataFrame([(D(2020, 1, 2), "MOM", 0.3)], "date date, factor string, value double")
    wide = landed.merge_factor_files(landed.read_daily_block(spark, str(f)), mom, ["Mkt-RF", "SMB", "Mom"])
    assert wide.columns == ["date", "Mkt-RF", "SMB", "Mom"] and wide.count() == 1


def test_statements_and_filings(spark):
    doc = json.dumps({"columns": ["2020-03-31", "2019-12-31"], "index": ["EBIT"], "data": [[1.0, None]]})
    df = spark.createDataFrame([("a", doc, ""), ("b", "{broken", None)], "entity string, income string, balance string")
    out = landed.decode_statements(df, {"income": "income", "balance": "balance"}).collect()
    assert [(r["entity"], r["statement"], r["period_end"], r["item"], r["value"]) for r in out] == [("a", "income", D(2020, 3, 31), "EBIT", 1.0)]
    pay = json.dumps({"filings": {"recent": {"form": ["8-K", "10-Q", "8-K"], "filingDate": ["2020-01-02", "2020-01-03", "??"]}}})
    got = landed.decode_filings(spark.createDataFrame([("a", pay)], "entity string, payload string")).collect()
    assert sorted((r["form"], r["filed"]) for r in got) == [("10-Q", D(2020, 1, 3)), ("8-K", D(2020, 1, 2))]
    ids = landed.id_map(spark.createDataFrame([(json.dumps({"0": {"ticker": "ab", "cik_str": 12}}),)], "payload string")).first()
    assert (ids["entity"], ids["filer_id"]) == ("AB", "0000000012")


def test_freshness_and_refresh(spark):
    px = spark.createDataFrame([("a", D(2020, 1, 10), 1.0), ("b", D(2020, 1, 1), 1.0)], "entity string, date date, adj_close double")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    row = landed.freshness(px, wanted, F.lit("2020-01-12").cast("date")).first()
    assert (row["wanted"], row["fresh"]) == (3, 1)
    with pytest.raises(ValueError):
        landed.freshness_gate(px, wanted, F.lit("2020-01-12").cast("date"))
    with pytest.raises(ValueError):
        landed.merge_refresh(px, px.limit(0))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(D(2020, 1, 1), float("nan"), "x"), (D(2020, 1, 2), 1.5, None)], "date date, v double, s string")
    recs = [json.loads(r["json"]) for r in sinks.to_records(df).collect()]
    assert recs[0] == {"date": "2020-01-01", "v": None, "s": "x"} and recs[1]["s"] is None
    sinks.write_parquet(df, str(tmp_path / "p"), ["date"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert sinks.tail(df, 1).first()["date"] == D(2020, 1, 2)
    b = spark.createDataFrame([("a", "f1", 0.123456, 0.01)], "entity string, factor string, beta double, p_value double")
    assert sinks.beta_maps(b, ["f1", "f2"], "beta", 0.0).first()["beta"] == {"f1": 0.123456, "f2": 0.0}
    assert sinks.beta_arrays(b, ["f2", "f1"]).first()["beta"] == [None, 0.1235]


def test_labels(spark):
    row = spark.createDataFrame([("pe_ratio(92); odd part; momentum_90d(81)", "In Line", 46.5)], "d string, t string, p double").select(
        X.humanize_drivers("d").alias("h"), X.combined_label("t", "p").alias("c"), X.normalize_key(F.lit(" brk.b")).alias("k")).first()
    assert row["h"] == "P/E 92nd pct · odd part · Mom 90d 81st pct" and row["c"] == "In Line · 46th pct" and row["k"] == "BRK-B"


def test_factor_panel_spread_and_frequency(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    rows = [("growth_XLI", d, 100.0 + i) for i, d in enumerate(days)] + [("growth_XLP", d, 50.0) for d in days]
    rows += [("financial_conditions_NFCI", days[0], 1.0), ("financial_conditions_NFCI", days[7], 2.0)]
    out = regress.factor_panel(spark.createDataFrame(rows, "factor string, date date, value double")).orderBy("date").collect()
    assert all(r["growth_CYCDEF"] == pytest.approx(r["growth_XLI"]) for r in out)
    assert [r["financial_conditions_NFCI"] for r in out if r["date"] == days[7]] == [1.0]
    assert len([r for r in factor_registry() if r["curated"]]) == 12


@pytest.mark.parametrize("header, names", [(",A,B,C,D", ["A", "B", "C"]), (",A,B,C", ["A", "B", "C"]), (",A,B", ["F0", "F1", "F2"]), ("A,B,C", ["F0", "F1", "F2"])])
def test_daily_block_headers_of_other_widths(spark, tmp_path, header, names):
    f = tmp_path / "block.txt"
    f.write_text(f"Preamble\n{header}\n20200102,1,2,3\n20200103,4,5,6\n")
    rows = landed.read_daily_block(spark, str(f)).where("date = '2020-01-02'").collect()
    assert sorted((r["factor"], round(r["value"], 4)) for r in rows) == [(n, (i + 1) / 100) for i, n in enumerate(names)]


def test_store_keeps_the_last_price_of_a_day(spark, tmp_path):
    from crossrisk.sources.store import load_store
    schema_ = "entity string, date date, adj_close double, volume double"
    px = spark.createDataFrame([("A", D(2020, 1, 2), 1.0, 1.0), ("A", D(2020, 1, 2), 2.0, 1.0), ("A", D(2020, 1, 3), 3.0, 1.0)], schema_)
    px.coalesce(1).write.parquet(str(tmp_path / "prices.parquet"))
    spark.createDataFrame([("A", D(2020, 1, 2), "s")], "entity string, date date, sector string").write.parquet(
        str(tmp_path / "features.parquet"))
    got = {r["date"]: r["adj_close"] for r in load_store(spark, str(tmp_path)).prices.collect()}
    assert got == {D(2020, 1, 2): 2.0, D(2020, 1, 3): 3.0}
