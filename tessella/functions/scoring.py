"""Scores, bands and hints as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import config as C


def rounded(v: Column, digits: int = 6) -> Column:
    """v to so many decimals as SQL rounds a double: the nearest whole number to v * 10**digits. Spark's round takes the
    decimal text of v instead, and so differs from it at some halves."""
    scale = F.lit(10.0**digits)
    return F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale


def brand_agreement(a: Column, b: Column) -> Column:
    """1 for the same brand, 0 for another, 0.5 where one is unknown."""
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.5).when(F.upper(a) == F.upper(b), 1.0).otherwise(0.0)


def aspect_agreement(a: Column, b: Column) -> Column:
    relative = F.abs(a - b) / F.greatest(a, b)
    return F.coalesce(F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), 1 - relative / C.ASPECT_TOLERANCE)), F.lit(0.5))


def code_bonus(a: Column, b: Column) -> Column:
    """For normalised codes: the same, or two edits apart at most."""
    near = F.levenshtein(a, b, C.CODE_DISTANCE) >= 0
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, C.CODE_EXACT).when(near, C.CODE_FUZZY).otherwise(0.0)


def fused(geometric: Column, tier1: Column, brand: Column, aspect: Column, bonus: Column) -> Column:
    return C.W_GEOMETRIC * geometric + C.W_TIER1 * tier1 + C.W_BRAND * brand + C.W_ASPECT * aspect + bonus


def band(top: Column, margin: Column, n: Column) -> Column:
    tied = (n > 1) & (margin <= C.TIE_MARGIN) & (top > C.LOW_SCORE)
    return (
        F.when(tied, "low")
        .when((top > C.HIGH_SCORE) & (margin > C.HIGH_MARGIN), "high")
        .when(top > C.MEDIUM_SCORE, "medium")
        .when(top > C.LOW_SCORE, "low")
        .otherwise("none")
    )


def sweep_band(top: Column, margin: Column) -> Column:
    """The band without the rule for ties, as threshold sweeps use it."""
    return F.when((top > C.HIGH_SCORE) & (margin > C.HIGH_MARGIN), "high").when(top > C.MEDIUM_SCORE, "medium").when(top > C.LOW_SCORE, "low").otherwise("none")


def hint(top: Column, margin: Column, n: Column, code: Column, buttons: Column, quality: Column) -> Column:
    """What to ask the user for; null if nothing."""
    kind = band(top, margin, n)
    tied = (n > 1) & (margin <= C.TIE_MARGIN) & (top > C.LOW_SCORE)
    good = (buttons >= C.RESHOOT_BUTTONS) & (quality >= C.RESHOOT_QUALITY)
    none = F.coalesce(kind, F.lit("none")) == "none"
    return F.when(none & good, "not_in_catalog").when(none, "reshoot").when(tied, "tied").when((kind != "high") & code.isNull(), "photograph_back")


def extraction_quality(n: Column, aspect: Column, confidence: Column, votes: Column, orientation: Column, labelled: Column) -> Column:
    """n buttons; mean colour confidence; mean of min(votes, 3) / 3; labelled buttons."""
    count = F.when((n < 6) | (n > 70), 0.2).when(n.between(14, 50), 1.0).otherwise(0.65)
    shape = F.when(aspect.between(2.0, 6.5), 1.0).otherwise(0.5)
    recall = F.coalesce(F.try_divide(labelled, n), F.lit(0.0))
    return 0.32 * count + 0.13 * shape + 0.22 * confidence + 0.13 * votes + 0.10 * orientation + 0.10 * F.least(recall / 0.35, F.lit(1.0))


def index_quantile(values: Column, fraction: float) -> Column:
    """s[min(n - 1, int(f * n))] of the ascending values; upper median at 0.5."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(n - 1, F.floor(n * F.lit(fraction)).cast("int")))
