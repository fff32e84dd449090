"""Candidate assessment: neighbours, distance from the portfolio, risk context, recommendation.

A batch of candidates is one table; every step is a join or an aggregate over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import whole
from . import knn, pca, scoring


def similarity(held: Column, former: Column) -> Column:
    return (F.when(held >= 3, "highly similar to existing portfolio")
            .when((held >= 1) | (former >= 2), "moderately overlaps with portfolio thesis ground")
            .otherwise("differentiated from current portfolio"))


def neighbour_table(points: DataFrame, candidates: DataFrame, holdings: DataFrame, history: DataFrame | None,
                    pcs: Sequence[str], k: int = 5) -> DataFrame:
    """Nearest names per candidate with held and formerly-held flags."""
    near = knn.nearest(points, candidates, pcs, k)
    held = holdings.select(F.col("entity").alias("neighbour"), F.lit(True).alias("is_held")).distinct()
    out = near.join(held, "neighbour", "left").withColumn("is_held", F.coalesce("is_held", F.lit(False)))
    if history is None:
        return out.withColumn("is_former", F.lit(False))
    past = history.select(F.col("entity").alias("neighbour"), F.lit(True).alias("_p")).distinct()
    return (out.join(past, "neighbour", "left")
            .withColumn("is_former", F.coalesce("_p", F.lit(False)) & ~F.col("is_held")).drop("_p"))


def neighbour_summary(near: DataFrame) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "distance", "is_held", "is_former")))
    held, former = F.count_if("is_held"), F.count_if("is_former")
    return near.groupBy("entity").agg(items.alias("neighbours"), held.alias("n_held"), former.alias("n_former")) \
        .withColumn("similarity", similarity(F.col("n_held"), F.col("n_former")))


def deviations(points: DataFrame, candidates: DataFrame, holdings: DataFrame, pcs: Sequence[str]) -> DataFrame:
    """Distance of each candidate from the weighted portfolio centre in universe deviations (sample deviation)."""
    w = pca.align_weights(holdings, points)
    centre = points.join(w, "entity").agg(F.struct(*[F.sum(F.col("weight") * F.col(p)).alias(p) for p in pcs])).scalar()
    spread = points.agg(F.struct(*[F.stddev_samp(p).alias(p) for p in pcs])).scalar()
    rows = candidates.select("entity", *pcs).withColumn("_c", centre).withColumn("_s", spread)
    sd = lambda p: F.when(F.col(f"_s.{p}") > 0, F.col(f"_s.{p}")).otherwise(F.lit(1.0))
    dev = {p: (F.col(p) - F.col(f"_c.{p}")) / sd(p) for p in pcs}
    rows = rows.select("entity", *[dev[p].alias(f"dev_{p}") for p in pcs])
    mean = sum((F.abs(f"dev_{p}") for p in pcs[1:]), F.abs(f"dev_{pcs[0]}")) / len(pcs)
    note = lambda p: F.when(F.abs(f"dev_{p}") > 1, F.concat(
        F.lit(f"{p}: "), F.format_string("%.1f", F.abs(f"dev_{p}")), F.lit("σ "),
        F.when(F.col(f"dev_{p}") > 0, F.lit("above")).otherwise(F.lit("below")), F.lit(" portfolio mean")))
    return (rows.withColumn("diversification", F.least(F.lit(100.0), mean * 50))
            .withColumn("significant", F.array_compact(F.array(*[note(p) for p in pcs]))))


def flags() -> Column:
    """Concerns in order: tier, overlap or low difference, sector (texts are fixed values)."""
    return F.array_compact(F.array(
        F.when(F.col("risk_tier") == "Elevated", F.concat(
            F.lit("risk screener places it in the Elevated tier ("), whole(F.col("score_percentile")),
            F.lit("th percentile of the universe)"))),
        F.when(F.col("n_held") >= 4, F.lit("nearly identical to existing holdings — limited diversification"))
        .when(F.col("diversification") < 15, F.lit("very low statistical differentiation from portfolio")),
        F.when(F.col("sector_delta") > 15, F.lit("substantially riskier than sector peers"))))


def recommendation() -> Column:
    n = F.size("flags")
    return (F.when(F.col("score_percentile") > 90, "AVOID").when(n >= 2, "QUESTION THESIS")
            .when(n == 1, "PROCEED WITH CAVEATS").otherwise("PROCEED"))


def rationale() -> Column:
    """Fixed texts per recommendation."""
    joined = F.array_join("flags", "; ")
    return (F.when(F.col("recommendation") == "AVOID",
                   F.concat(F.lit("Statistical risk indicators are at extreme levels. "), joined))
            .when(F.col("recommendation") == "QUESTION THESIS",
                  F.concat(F.lit("Multiple concerns require explicit address: "), joined))
            .when(F.col("recommendation") == "PROCEED WITH CAVEATS",
                  F.concat(F.lit("Single concern to acknowledge: "), joined))
            .otherwise("No statistical red flags. Standard fundamental due diligence applies."))


def bullets() -> Column:
    """Summary lines (fixed texts)."""
    held = F.transform(F.filter("neighbours", lambda n: n["is_held"]), lambda n: n["neighbour"].cast("string"))
    first3 = F.transform(F.slice("neighbours", 1, 3), lambda n: n["neighbour"].cast("string"))
    similar = F.when(F.size(held) > 0, F.concat(
        F.lit("Statistically similar to "), F.size(held).cast("string"), F.lit(" current holding(s): "), F.array_join(held, ", "),
        F.lit(". "), F.upper(F.substring("similarity", 1, 1)), F.expr("substring(similarity, 2)"), F.lit("."))).otherwise(F.concat(
            F.lit("Nearest neighbors in universe: "), F.array_join(first3, ", "),
            F.lit(". None currently held — adds genuinely new statistical exposure.")))
    apart = F.when(F.size("significant") > 0, F.concat(
        F.lit("Deviation from portfolio centroid: "), F.array_join(F.slice("significant", 1, 2), "; "))).otherwise(
            "Sits within 1σ of portfolio centroid on all retained PCs — limited statistical differentiation")
    pct = whole(F.col("score_percentile"))
    risk = F.when(F.col("risk_tier") == "Elevated", F.concat(
        F.lit("⚠ Risk screener: Elevated tier — "), pct, F.lit("th percentile of the universe. Top risk drivers: "),
        F.coalesce(F.col("drivers"), F.lit("")))).otherwise(F.concat(
            F.lit("Risk screener: "), F.col("risk_tier"), F.lit(" ("), pct, F.lit("th percentile) — no elevated statistical risk signals")))
    sector = F.concat(F.lit("Sector: "), F.coalesce("sector", F.lit("Unknown")), F.lit(", "), F.col("sector_label"))
    return F.array(similar, apart, risk, sector)


def assess(requested: DataFrame, points: DataFrame, scores: DataFrame, ranks: DataFrame, holdings: DataFrame,
           pcs: Sequence[str], history: DataFrame | None = None, k: int = 5) -> DataFrame:
    """One row per requested entity; unknown ones get status ``not in universe``.

    ``points`` (entity, PCs), ``scores`` (date, entity, sector, composite_score, score_percentile, risk_tier) and
    ``ranks`` hold one cross-section.
    """
    asked = requested.select("entity").distinct()
    cand = points.join(asked, "entity", "left_semi").select("entity", *pcs)
    near = neighbour_summary(neighbour_table(points, cand, holdings, history, pcs, k))
    peers = scoring.sector_comparison(scores, ["date"])
    text = scoring.driver_text(scoring.drivers(ranks.join(asked, "entity", "left_semi"), ["date"]), ["date"]).select("entity", "drivers")
    out = (asked.join(near, "entity", "left").join(deviations(points, cand, holdings, pcs), "entity", "left")
           .join(peers, "entity", "left").join(text, "entity", "left")
           .withColumn("status", F.when(F.col("composite_score").isNull() | F.col("neighbours").isNull(), "not in universe")
                       .otherwise("ok")))
    known = F.col("status") == "ok"
    return (out.withColumn("flags", F.when(known, flags()))
            .withColumn("recommendation", F.when(known, recommendation()))
            .withColumn("rationale", F.when(known, rationale()))
            .withColumn("bullets", F.when(known, bullets())))


