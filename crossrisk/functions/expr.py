"""Scalar column expressions; everything stays in generated code, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import FEATURE_LABELS, WILSON_Z


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.trim(c) != "", c)


def first_non_empty(*cols: str | Column, default: str | None = None) -> Column:
    """First non-blank value."""
    last = [F.lit(default)] if default is not None else []
    return F.coalesce(*[blank_to_null(c) for c in cols], *last)


def normalize_key(c: str | Column) -> Column:
    """Listing form of an entity key: trimmed, upper case, dots as dashes."""
    return F.translate(F.upper(F.trim(col(c))), ".", "-")


def compact_key(c: str | Column) -> Column:
    """Alternate form without separators."""
    return F.translate(F.upper(F.trim(col(c))), ".-", "")


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Null-keeping clamp."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(c, F.lit(hi))))


def finite(c: str | Column) -> Column:
    """NaN and infinities become null (K3)."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def wilson(events: str | Column, n: str | Column, z: float = WILSON_Z) -> tuple[Column, Column, Column]:
    """Rate with Wilson interval clamped to [0, 1]; null for n = 0 (A5)."""
    k, n = col(events).cast("double"), col(n).cast("double")
    p = k / n
    denom = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    ok = n > 0
    return (F.when(ok, p), F.when(ok, F.greatest(mid - half, F.lit(0.0))), F.when(ok, F.least(mid + half, F.lit(1.0))))


def stars(p: str | Column) -> Column:
    """Significance stars (F16)."""
    p = col(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def bonferroni(n: Column | int) -> Column:
    """.05 / max(n, 1)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.lit(0.05) / F.greatest(n.cast("double"), F.lit(1.0))


def whole(c: Column) -> Column:
    """Half-even rounding to text without decimals."""
    return F.bround(c, 0).cast("long").cast("string")


def combined_label(tier: str | Column, pct: str | Column) -> Column:
    """Tier and percentile in one label."""
    return F.concat(col(tier), F.lit(" · "), whole(col(pct)), F.lit("th pct"))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    last = n % 10
    suffix = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def feature_label(c: str | Column) -> Column:
    """Label of a feature code, the code itself when unknown."""
    labels = F.create_map(*[F.lit(v) for kv in FEATURE_LABELS.items() for v in kv])
    return F.coalesce(labels[col(c)], col(c))


def humanize_drivers(text: str | Column) -> Column:
    """``name(92); other(88)`` as labelled ordinals joined by dots (F18); unparsable parts stay as they are."""
    part = r"^([A-Za-z0-9_]+)\((\d+)\)$"

    def one(raw):
        item = F.trim(raw)
        number = F.regexp_extract(item, part, 2).cast("int")
        named = F.concat(feature_label(F.regexp_extract(item, part, 1)), F.lit(" "), ordinal(number), F.lit(" pct"))
        return F.when(item.rlike(part), named).otherwise(item)

    return F.coalesce(F.array_join(F.transform(F.split(col(text), ";"), one), " · "), F.lit(""))


def percent_text(c: Column, digits: int = 1) -> Column:
    """Percent string, null-safe."""
    return F.coalesce(F.format_string(f"%.{digits}f%%", c * 100), F.lit("n/a"))




def first_rule(rules: list[tuple[str, str]]) -> Column:
    """The text of the first rule whose SQL condition on the columns at hand holds, null if none does."""
    return F.coalesce(*[F.when(F.expr(condition), F.lit(text)) for condition, text in rules])
