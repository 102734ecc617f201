"""Quantile ranges (operators.ranges)."""

import bisect

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.ranges import quantile_cuts, range_number


@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 130, 4097, 5000])
def test_range_number_is_the_number_of_cuts_below(spark, count):
    cuts = [3 * k for k in range(count)]
    values = [None, -5, 0, 1, 189, 190, 3 * count // 2, 3 * count, 10**9, *range(180, 200)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [(r["v"], r["n"]) for r in df.select("v", range_number(F.col("v"), cuts).alias("n")).collect()]
    assert got == [(v, 0 if v is None else bisect.bisect_left(cuts, v)) for v in values]


def test_cuts_balance_the_ranges(spark):
    df = spark.range(0, 3000).selectExpr("id * id as v")
    cuts = quantile_cuts(df, "v", 30)
    assert cuts == sorted(set(cuts)) and len(cuts) == 29
    sizes = [r["count"] for r in df.groupBy(range_number(F.col("v"), cuts)).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 130
    assert quantile_cuts(df.where("false"), "v", 30) == [] == quantile_cuts(df, "v", 1)
