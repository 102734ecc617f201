"""The stored period table against full rebuilds, and the long bank panel."""

import os
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import composite as C
from ledgerlens.sources import period_table as PT
from ledgerlens.sources.files import aggregated_analytics

SCHEMA = "ProcessingDateKey int, CommitmentAmt decimal(18,2), OutstandingAmt decimal(18,2)"


def tape(spark, rows):
    return spark.createDataFrame([(k, None if c is None else Decimal(c), None if o is None else Decimal(o)) for k, c, o in rows], SCHEMA)


def table(spark, path):
    columns = [c for c in PT.COLUMNS if c != PT.PERIOD]
    return sorted(map(tuple, PT.read_periods(spark, path).select(*columns).collect()), key=str), columns


def same(spark, path, rows):
    got, columns = table(spark, path)
    assert got == sorted(map(tuple, aggregated_analytics(tape(spark, rows)).select(*columns).collect()), key=str)


def files(path, month):
    return sorted(os.listdir(f"{path}/period={month}"))


BASE = [(20240131, 10, 5), (20240131, 4, None), (20240229, 20, 8), (20240331, None, 3), (20240331, 30, 9), (20240531, 7, 7),
        (20240630, 5, 5), (None, 2, 1)]


def test_late_rows_equal_a_full_rebuild(spark, tmp_path):
    path = str(tmp_path / "periods")
    PT.build_periods(tape(spark, BASE), path)
    same(spark, path, BASE)
    untouched = {m: files(path, m) for m in (20240131, 20240531, 20240630)}
    late = [(20240229, 1, None), (20240229, 2, 2)]
    assert PT.add_rows(tape(spark, late), path) == [20240229, 20240331]
    same(spark, path, BASE + late)
    assert {m: files(path, m) for m in untouched} == untouched
    between = [(20240430, 3, 1), (20231231, 9, 9), (None, 4, 4), (20240630, None, 6)]    # new months, and a row that doesn't count
    assert PT.add_rows(tape(spark, between), path) == [None, 20231231, 20240131, 20240430, 20240531]
    same(spark, path, BASE + late + between)
    assert PT.add_rows(tape(spark, []), path) == []
    same(spark, path, BASE + late + between)


def test_months_counted_again(spark, tmp_path):
    path = str(tmp_path / "periods")
    PT.build_periods(tape(spark, BASE), path)
    fixed = [r for r in BASE if r[0] != 20240229] + [(20240229, 50, 1)]
    assert PT.reload_months(tape(spark, fixed), [20240229], path) == [20240229, 20240331]
    same(spark, path, fixed)
    assert PT.reload_months(tape(spark, fixed), [20240229], path) == [20240229, 20240331]          # again: the same table
    same(spark, path, fixed)
    fewer = [r for r in fixed if r[0] != 20240331]
    PT.reload_months(tape(spark, fewer), [20240331], path)
    same(spark, path, fewer)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "periods")
    PT.build_periods(tape(spark, []), path)
    assert table(spark, path)[0] == []
    assert PT.add_rows(tape(spark, BASE), path)[1] == 20240131
    same(spark, path, BASE)


def panel_rows(spark, banks, months):
    """A tape of ``banks`` banks with some gaps."""
    rows = spark.range(banks * months).select(
        (F.col("id") % banks).cast("string").alias("BankID"), F.floor(F.col("id") / banks).cast("int").alias("m"))
    rows = rows.where("(BankID + m) % 7 <> 0")
    amount = (F.col("BankID").cast("int") % 13 + 1 + F.col("m")).cast("decimal(18,2)")
    return rows.select("BankID", (F.lit(20240101) + F.col("m") * 100).alias("ProcessingDateKey"),
                       amount.alias("CommitmentAmt"), (amount / 2).cast("decimal(18,2)").alias("OutstandingAmt"))


def test_panel_of_many_banks(spark):
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    parts = C.composite_parts(C.cells(panel_rows(spark, 5000, 3)))
    long = C.panel_long(parts)
    assert len(jobs.getJobIdsForGroup(None)) == before                       # nothing ran so far
    got = long.groupBy("metric").agg(F.count("*").alias("n"), F.count_distinct("bank_pos").alias("banks"),
                                     F.max("bank_pos").alias("top")).collect()
    assert {r["metric"] for r in got} == {"ca", "oa", "deals"}
    assert all(r["banks"] == 5000 and r["top"] == 5000 and r["n"] == panel_rows(spark, 5000, 3).count() for r in got)


def test_panel_long_holds_the_wide_panel(spark):
    parts = C.composite_parts(C.cells(panel_rows(spark, 12, 4)))
    rows = C.panel_long(parts).collect()
    order = sorted({r["BankID"] for r in rows}, key=lambda b: (len(b), b))
    assert {(r["BankID"], r["bank_pos"]) for r in rows} == {(b, i + 1) for i, b in enumerate(order)}
    for metric in ("ca", "oa", "deals"):
        by_key = {(r["ProcessingDateKey"], r["BankID"]): r for r in rows if r["metric"] == metric}
        for w in C.wide_panel(parts, order, metric).collect():
            for b in order:
                r = by_key.get((w["ProcessingDateKey"], b))
                assert w[f"{b}_inc"] == bool(r and r["inc"])
                assert w[b] == (r and r["value"]) and w[f"{b}_mod"] == (r and r["mod"])
                assert w[f"{b}_perc_diff_raw"] == (r and r["perc_diff_raw"]) and w[f"{b}_perc_diff"] == (r and r["perc_diff"])
                if r:
                    assert (r["lim_max"], r["lim_min"], r["composite"]) == (w["lim_max"], w["lim_min"], w["perc_diff"])
