"""Queries over all cross-sections: every date is there, and each one's rows are those of its own rows alone."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crossrisk.plans import screen as SC, views as V
from crossrisk.session import cut_lineage

from test_entry import SMALL, _clean, _duck

WITH_SQL = ["zscores_by_date", "cluster_profile_by_date", "cluster_risk_rank_by_date", "cluster_top_sectors_by_date",
            "pca_total_variance_by_date"]
WITHOUT = ["cluster_styles", "kmeans_sweep", "selected_k", "stability", "ablation"]


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_clean(r[c]) for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", WITH_SQL)
def test_every_date_matches_its_oracle(spark, name):
    df = entry.queries()[name](spark, SMALL)
    rel = _duck(SMALL).sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    want = sorted((tuple(_clean(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert _rows(df) == want


def _over(spark, days, names):
    """Results of queries whose cleaned table holds the given dates only."""
    rows = cut_lineage(SC.screened(spark, SMALL).where(F.col("date").isin(days)))
    with pytest.MonkeyPatch.context() as patch:
        V.forget_stored()
        patch.setattr(SC, "screened", lambda *_: rows)
        try:
            return {name: entry.queries()[name](spark, SMALL).collect() for name in names}
        finally:
            V.forget_stored()


def test_no_date_is_dropped_and_each_is_as_it_is_alone(spark):
    days = sorted(r["date"] for r in SC.screened(spark, SMALL).select("date").distinct().collect())
    few = [days[len(days) // 2], days[-1]]
    both = _over(spark, few, [*WITHOUT, "diagnostics"])
    for name in WITHOUT:
        assert sorted({r["date"] for r in both[name]}) == few, name
    assert {r["date"] for r in both["diagnostics"]} <= set(few)
    for name, rows in _over(spark, few[:1], ["cluster_styles", "stability"]).items():
        assert sorted(rows, key=str) == sorted((r for r in both[name] if r["date"] == few[0]), key=str)
