"""Exact order statistics of a column without a task or a driver that holds the column.

The values are cut at approximate quantiles, the parts are counted, and only the parts that hold a wanted
rank are cut again, until a part has few distinct values; their counts come to the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS, FEW = 100, 2000


def values_at(rows: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0) of the ascending non-null values of a column of numbers."""
    v = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    return _values_at(v, sorted(set(ranks)))


def _values_at(v: DataFrame, ranks: list[int]) -> dict[int, float]:
    if not ranks:
        return {}
    counts = v.groupBy("v").count()
    if counts.limit(FEW + 1).count() <= FEW:
        found, place, out = sorted(tuple(r) for r in counts.collect()), 0, {}
        for x, n in found:
            out |= {k: x for k in ranks if place <= k < place + n}
            place += n
        return out
    bounds = sorted(set(v.approxQuantile("v", [k / SPLITS for k in range(1, SPLITS)], 0.5 / SPLITS)))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("v")))
    sizes = {r["part"]: r["count"] for r in v.groupBy(part.alias("part")).count().collect()}
    out, place = {}, 0
    for k in range(len(bounds) + 1):
        n = sizes.get(k, 0)
        inside = F.lit(True)
        if k:
            inside &= F.col("v") > bounds[k - 1]
        if k < len(bounds):
            inside &= F.col("v") <= bounds[k]
        wanted = [x - place for x in ranks if place <= x < place + n]
        out |= {x + place: y for x, y in _values_at(v.where(inside), wanted).items()}
        place += n
    return out


def percentile(rows: DataFrame, value: str, fraction: float) -> float | None:
    """The continuous percentile: between the two values around fraction * (n - 1)."""
    n = rows.where(F.col(value).isNotNull()).count()
    if not n:
        return None
    at = fraction * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    found = values_at(rows, value, [low, high])
    return found[low] + (found[high] - found[low]) * (at - low)
