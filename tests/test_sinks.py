"""Result sinks and views (S6-S9, S11) on the smallest fixture."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.plans import report as R
from ledgerlens.plans import templates as TP
from ledgerlens.sources import files as FS
from ledgerlens.sources.tape import tape_from_tables


@pytest.fixture(scope="module")
def tape(spark):
    return tape_from_tables(spark, SF_SMALL)


def _metadata(tmp, ts):
    folder = os.path.join(tmp, "metadata", ts)
    return [json.loads(l) for f in os.listdir(folder) if f.endswith(".json") for l in open(os.path.join(folder, f))]


def test_write_results_and_metadata(spark, tape):
    res = TP.run_templates(tape)
    tdf = TP.template_frame(spark)
    with tempfile.TemporaryDirectory() as tmp:
        meta = {r["template_id"]: r for r in TP.write_results(res, tdf, tmp, "20240101_000000").collect()}
        lines = _metadata(tmp, "20240101_000000")
        assert len(lines) == len(meta) == len(TP.TEMPLATES)
        want = {r["template_id"]: r["count"] for r in res.groupBy("template_id").count().collect()}
        for l in lines:
            assert l["row_count"] == want.get(l["template_id"], 0)
            if not l["row_count"]:
                assert "output_file" not in l and l["status"] == "FAILED"
                continue
            back = spark.read.option("header", True).csv(os.path.join(tmp, l["output_file"]))   # the path it names
            assert back.count() == l["row_count"] and back.columns == l["columns"]
            keys = [int(r["ProcessingDateKey"]) for r in back.collect()]
            assert keys == sorted(keys)
        with pytest.raises(Exception):                      # the same run again
            TP.write_results(res, tdf, tmp, "20240101_000000")
        TP.write_results(res, tdf, tmp, "20240102_000000")  # another run leaves the first alone
        assert sorted(os.listdir(os.path.join(tmp, "results"))) == ["20240101_000000", "20240102_000000"]
        assert _metadata(tmp, "20240101_000000") == lines


def test_templates_that_share_a_name(spark, tape):
    both = {k: {"name": "Same name", "filters": {"sba_classification": c}} for k, c in (("a", "SBA"), ("b", "Non-SBA"))}
    with tempfile.TemporaryDirectory() as tmp:
        rows = TP.write_results(TP.run_templates(tape, both), TP.template_frame(spark, both), tmp, "t").collect()
    assert len(rows) == 2 and len({r["output_file"] for r in rows}) == 2


def test_no_templates_run_none(spark, tape):
    assert TP.template_frame(spark, {}).count() == 0


def test_report_counts_success(spark, tape):
    rep = TP.run_report(TP.run_templates(tape), TP.template_frame(spark))
    tot = TP.report_totals(rep).collect()[0]
    assert tot["total_count"] == 8 and 0 < tot["success_count"] <= 8


def test_results_table_types(spark, tape):
    res = TP.with_run_metadata(TP.run_templates(tape), TP.template_frame(spark), "20240101_000000")
    out = TP.to_results_table(res)
    types = dict(out.dtypes)
    assert types["commitmentamt"] == "decimal(20,2)" and types["ca_diff"] == "decimal(10,6)"
    assert types["deals"] == "bigint" and types["processingdatekey"] == "bigint"
    assert "created_at" in types


def test_bundle_and_views(spark, tape):
    bundle = R.dashboard_bundle(tape)
    with tempfile.TemporaryDirectory() as tmp:
        FS.write_bundle(bundle, tmp)
        assert sorted(os.listdir(tmp)) == ["analytics_data", "filter_options", "raw_data", "summary"]
        assert spark.read.json(os.path.join(tmp, "summary")).count() == 1
        assert spark.read.json(os.path.join(tmp, "raw_data")).count() == tape.count()
    FS.register_views(spark, tape)
    n = spark.sql("SELECT COUNT(*) AS n FROM aggregated_analytics").collect()[0]["n"]
    assert n == tape.select("ProcessingDateKey").distinct().count()
    assert spark.sql("SELECT SUM(Deals) AS d FROM analytics_summary").collect()[0]["d"] == \
        tape.filter(F.col("CommitmentAmt").isNotNull()).count()


def test_tape_query_limit_and_required(spark, tape):
    df = R.tape_query(tape, limit=10)
    assert df.count() <= 10 and "SBA_Classification" in df.columns
    with pytest.raises(ValueError):
        R.tape_query(tape, columns=["Region"], limit=5)   # required columns missing


def test_stored_files_keep_the_filter_order(spark, tape):
    with tempfile.TemporaryDirectory() as tmp:
        FS.write_tape(tape, os.path.join(tmp, "tape"))
        stored = spark.read.parquet(os.path.join(tmp, "tape"))
        rows = (stored.select(*FS.SORT_COLUMNS, F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
                .orderBy("file", "at").collect())
    files = {}
    for r in rows:
        files.setdefault(r["file"], []).append(tuple((r[c] is not None, r[c] or "") for c in FS.SORT_COLUMNS))
    assert len(files) > 20 and all(v == sorted(v) for v in files.values())
