"""Stored partials with sketches (A11) against the exact statistics."""

import os
import random
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlens.operators.aggregates import summary_stats
from ledgerlens.sources import period_sketches as PS

SCHEMA = "ProcessingDateKey int, Region string, LineofBusinessId string, BankID string, CommitmentAmt decimal(18,2)"
EXACT = ["total_records", "unique_months", "earliest_date", "latest_date", "total_commitment", "avg_commitment"]


def rows_of(n, seed, months=(20240131, 20240229, 20240331)):
    rnd = random.Random(seed)
    return [(rnd.choice(months), rnd.choice(["N", "S", None]), rnd.choice(["1", "12", None]), rnd.choice([None, *[f"b{k}" for k in range(40)]]),
             rnd.choice([None, Decimal(rnd.randrange(10_000)) / 100])) for _ in range(n)]


def same(spark, path, rows):
    """Few values: the sketches are exact too."""
    got = PS.stats(PS.read_partials(spark, path)).first()
    want = summary_stats(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.asDict() == pytest.approx(want.asDict())


def files(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("period=")}


def test_late_rows_and_reloaded_months_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "partials")
    base, late = rows_of(300, 1) + [(None, "N", "1", "lost", Decimal(3))], rows_of(50, 2, (20240229, 20240430)) + [(None, "W", "1", "b1", Decimal(4))]
    PS.build_partials(spark.createDataFrame(base, SCHEMA), path)
    same(spark, path, base)
    before = files(path)
    PS.add_rows(spark.createDataFrame(late, SCHEMA), path)
    same(spark, path, base + late)
    after = files(path)
    assert {m for m in before if before[m] != after[m]} == {"period=20240229", "period=__HIVE_DEFAULT_PARTITION__"}
    fixed = [r for r in base + late if r[0] != 20240331] + rows_of(20, 3, (20240331,))
    PS.reload_months(spark.createDataFrame(fixed, SCHEMA), [20240331, 20240331], path)
    same(spark, path, fixed)
    gone = [r for r in fixed if r[0] != 20240131]
    PS.reload_months(spark.createDataFrame(gone, SCHEMA), [20240131, 20250131], path)
    same(spark, path, gone)
    PS.reload_months(spark.createDataFrame(gone, SCHEMA), [], path)
    PS.add_rows(spark.createDataFrame([], SCHEMA), path)
    same(spark, path, gone)


def test_empty_tape(spark, tmp_path):
    path = str(tmp_path / "partials")
    PS.build_partials(spark.createDataFrame([], SCHEMA), path)
    same(spark, path, [])
    PS.add_rows(spark.createDataFrame(rows_of(30, 4), SCHEMA), path)
    same(spark, path, rows_of(30, 4))


@pytest.mark.parametrize("lg_k", [10, 12, 14])
def test_error_is_within_the_stated_one(spark, tmp_path, lg_k):
    """200,000 banks, each in many of 24 months: the united sketches."""
    path = str(tmp_path / f"partials{lg_k}")
    tape = spark.range(800_000).selectExpr(
        "cast(20240100 + id % 24 as int) ProcessingDateKey", "'N' Region", "cast(id % 30000 as string) LineofBusinessId",
        "concat('bank', id % 200000) BankID", "cast(1 as decimal(18,2)) CommitmentAmt")
    PS.build_partials(tape, path, lg_k)
    got = PS.stats(PS.read_partials(spark, path)).first()
    assert [got[c] for c in ("total_records", "unique_months", "unique_regions")] == [800_000, 24, 1]
    for name, true in (("unique_banks", 200_000), ("unique_lobs", 30_000)):
        assert abs(got[name] - true) <= 3 * PS.standard_error(lg_k) * true, name


def test_sketches_of_other_sizes_are_refused(spark, tmp_path):
    path = str(tmp_path / "partials")
    PS.build_partials(spark.createDataFrame(rows_of(50, 5), SCHEMA), path)
    before = files(path)
    with pytest.raises(PySparkException):
        PS.add_rows(spark.createDataFrame(rows_of(50, 6), SCHEMA), path, lg_k=10)
    assert files(path) == before


def test_some_months_only(spark, tmp_path):
    path, rows = str(tmp_path / "partials"), rows_of(200, 7)
    PS.build_partials(spark.createDataFrame(rows, SCHEMA), path)
    got = PS.stats(PS.read_partials(spark, path).where(F.col("period") >= 20240229)).first()
    want = summary_stats(spark.createDataFrame([r for r in rows if r[0] >= 20240229], SCHEMA)).first()
    assert got.asDict() == pytest.approx(want.asDict())
