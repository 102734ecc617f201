"""Global row order without a global sort: quantile ranges as a column.

An unpartitioned window brings all rows to one task.  Here the range of
values is cut at approximate quantiles (driver: the cut points only), the
range number is an ordinary expression, and windows run per range; what a
range needs from its neighbour is its first or last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIX = 64


def quantile_cuts(df: DataFrame, column: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` ascending cut points of a numeric column.

    One aggregation over that column alone; nulls are ignored.  Only the
    sizes of the ranges depend on the approximation.
    """
    if ranges <= 1:
        return []
    at = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(column, at, max(10_000, 20 * ranges)).alias("q")).first()["q"]
    return sorted(set(found or []))


def range_number(value: Column, cuts: list[int]) -> Column:
    """How many cuts lie below ``value`` (null: 0), by a search of radix 64."""
    if not cuts:
        return F.lit(0).cast("long")
    points = F.array(*[F.lit(c) for c in cuts]) if len(cuts) <= RADIX else F.lit(cuts)
    steps = [1]
    while steps[-1] * RADIX < len(cuts):
        steps.append(steps[-1] * RADIX)
    number = F.lit(0).cast("long")
    for step in reversed(steps):
        marks = F.lit([cuts[k] for k in range(step - 1, len(cuts), step)]) if step > 1 else points
        part = F.slice(marks, (F.floor(number / step) + 1).cast("int"), RADIX)
        number = number + F.size(F.filter(part, lambda c: c < value)) * step
    return F.coalesce(number, F.lit(0)).cast("long")
