"""Input and templates that are wrong in part: the rest is unchanged, and
what was set aside is reported with its reason."""

import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators import aggregates as AG
from ledgerlens.plans import templates as TP
from ledgerlens.sources import files as FS
from ledgerlens.sources.tape import tape_from_tables

LINES = [
    "20240131\t10.5\tPacific\t7\t1",
    "20240131\t11\tPacific\t7",                       # too few
    "20240131\t12\tPacific\t7\t1\textra",             # too many
    "\t13\tPacific\t7\t1",                            # no date
    "20240229\tabc\tPacific\t8\tx1",                  # strict integer
    "20240229\tabc\tPacific\t9\t2",                   # lenient amount
    "20240229\t14\tPacific\t9\t2.5",                  # no integer
]


@pytest.fixture()
def lines_file():
    with tempfile.TemporaryDirectory() as tmp:
        path = os.path.join(tmp, "tape.tsv")
        with open(path, "w") as fh:
            fh.write("\n".join(["ProcessingDateKey\tCommitmentAmt\tRegion\tBankID\tsize_SortOrder", *LINES]) + "\n")
        yield path


def test_bad_lines_are_reported_and_nothing_is_lost(spark, lines_file):
    kept = FS.read_tape(spark, lines_file).collect()
    assert sorted((r["BankID"], r["CommitmentAmt"] is None) for r in kept) == [("7", False), ("9", True)]
    bad = {r["line"]: r["reason"] for r in FS.rejected_lines(spark, lines_file).collect()}
    assert bad == {LINES[1]: "malformed line", LINES[2]: "malformed line", LINES[3]: "no processing date",
                   LINES[4]: "no integer: size_SortOrder", LINES[6]: "no integer: size_SortOrder"}
    assert len(kept) + len(bad) == len(LINES)


def test_a_malformed_template_leaves_the_others(spark):
    tape = tape_from_tables(spark, SF_SMALL)
    good = {k: TP.TEMPLATES[k] for k in ("template1", "template3")}
    bad = {"dates": {"name": "bad dates", "filters": {"date_filters": [5]}}, "shape": {"name": "x", "filters": [1]}, "none": 7}
    every = {"dates": bad["dates"], **good, "shape": bad["shape"], "none": bad["none"]}
    rows = lambda t: sorted(map(str, TP.run_templates(tape, t).collect()))
    assert rows(every) == rows(good)
    scopes, causes = TP.compile_templates(tape, every)
    assert [k for k, _ in scopes] == list(good) and set(causes) == set(bad)
    report = {r["template_id"]: r for r in TP.run_report(TP.run_templates(tape, every), TP.template_frame(spark, every), causes).collect()}
    assert {k for k, r in report.items() if r["status"] == "FAILED"} >= set(bad)
    assert all(report[k]["cause"] == causes[k] for k in bad)
    assert all(report[k]["cause"] is None for k in good if report[k]["status"] == "SUCCESS")
    with pytest.raises(Exception):
        TP.run_custom(tape, {"date_filters": [5]})
    dropped = tape.drop("RiskGroupDesc")
    _, causes = TP.compile_templates(dropped, {"template1": TP.TEMPLATES["template1"], "template2": TP.TEMPLATES["template2"]})
    assert set(causes) == {"template2"}


def test_a_source_that_fails_late_falls_back(spark):
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") > 900, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("x"))
    got = FS.load_tape(lambda: bad, lambda: spark.range(3)).collect()
    assert len(got) == 3 and {r["source"] for r in got} == {"csv_fallback"}
    missing = FS.load_tape(lambda: spark.read.parquet("/tmp/no-such-folder-of-tapes"), lambda: spark.range(2))
    assert {r["source"] for r in missing.collect()} == {"csv_fallback"}
    with pytest.raises(AnalysisException):
        FS.load_tape(lambda: spark.range(3).select("no_such_column"), lambda: spark.range(3))


def test_a_zero_limit_returns_all_rows(spark):
    tape = tape_from_tables(spark, SF_SMALL)
    assert AG.detail_query(tape, limit=0).count() == AG.detail_query(tape).count() > 5
    series = tape.groupBy("ProcessingDateKey").count()
    assert AG.analytics_series(series, 0).count() == series.count() > 2 and AG.analytics_series(series, 2).count() == 2


def test_reloading_a_month_leaves_the_others(spark, tmp_path):
    tape = tape_from_tables(spark, SF_SMALL)
    path = str(tmp_path / "tape")
    FS.write_tape(tape, path)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("tape/*/*.parquet")}
    before, total = files(), tape.count()
    months = sorted(r[0] for r in tape.select("ProcessingDateKey").distinct().collect())
    month, n = months[1], tape.where(F.col("ProcessingDateKey") == months[1]).count()
    late = tape.where(F.col("ProcessingDateKey") == month)
    assert FS.replace_months(late.unionAll(late.limit(2)), path) == {month: n + min(2, n)}
    after = files()
    other = lambda found: {k: v for k, v in found.items() if f"ProcessingDateKey={month}" not in k}
    assert other(after) == other(before) and after != before
    assert FS.read_stored_tape(spark, path).count() == total + min(2, n)
    assert FS.replace_months(late.limit(0), path) == {} and files() == after
    with pytest.raises(ValueError):
        FS.replace_months(late.withColumn("ProcessingDateKey", F.lit(None).cast("int")), path)
    broken = late.withColumn("BankID", F.when(F.rand(1) >= 0, F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception):
        FS.replace_months(broken, path)
    assert files() == after
