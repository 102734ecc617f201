"""Invariants on the driver tables."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.config import CapConfig
from ledgerlens.operators import composite as C
from ledgerlens.operators.filters import FilterSpec
from ledgerlens.plans import templates as TP
from ledgerlens.plans.analysis import cap_sensitivity, capped_vs_uncapped
from ledgerlens.sources.tape import tape_from_tables


@pytest.fixture(scope="module")
def tape(spark):
    return tape_from_tables(spark, SF_SMALL).cache()


def test_cap_keeps_total_and_bounds_share(spark, tape):
    capped = C.cap_max_proportion(C.long_panel(C.cells(tape)))
    g = capped.groupBy("metric", "ProcessingDateKey").agg(
        F.sum("Capped").alias("c"), F.first("Sum").alias("s"), F.max("Capped").alias("mx"), F.count("*").alias("n"))
    for r in g.collect():
        assert r["c"] == pytest.approx(r["s"], rel=1e-9)
        if r["n"] > 1 and r["s"]:
            assert r["mx"] / r["s"] <= 0.5 + 1e-9


def test_clamped_change_within_limits(spark, tape):
    p = C.composite_parts(C.cells(tape))
    j = p["chain"].join(p["limits"], ["metric", "ProcessingDateKey"]).filter(F.col("inc"))
    bad = j.filter((F.col("perc_diff") > F.col("lim_max") + 1e-12) | (F.col("perc_diff") < F.col("lim_min") - 1e-12))
    assert bad.count() == 0


def test_permutation_and_repartition_invariance(spark, tape):
    a = sorted(tuple(r) for r in capped_vs_uncapped(tape).collect())
    shuffled = tape.orderBy(F.rand(7)).repartition(5)
    b = sorted(tuple(r) for r in capped_vs_uncapped(shuffled).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:8] == y[:8]
        for u, v in zip(x[8:], y[8:]):
            assert (u is None and v is None) or u == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_template_equals_custom_run(spark, tape):
    key = "template3"
    batch = TP.run_templates(tape).filter(F.col("template_id") == key).drop("template_id")
    one = capped_vs_uncapped(tape, FilterSpec.from_template(TP.TEMPLATES[key]["filters"]))
    a = sorted(tuple(r) for r in batch.collect())
    b = sorted(tuple(r) for r in one.collect())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x[:8] == y[:8]
        for u, v in zip(x[8:], y[8:]):
            assert (u is None and v is None) or u == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_scoped_cells_equal_filtered_cells(spark, tape):
    scopes = TP.template_scopes(TP.TEMPLATES)
    sc = C.scoped_cells(tape, scopes)
    for key, pred in scopes[:3]:
        a = sorted(tuple(r) for r in sc.filter(F.col("template_id") == key).drop("template_id").collect())
        b = sorted(tuple(r) for r in C.cells(tape.filter(pred)).collect())
        assert a == b


def test_fixture_facts_sf001(spark):
    """Facts FIXTURES.md states for the sf0.01 tape."""
    t = tape_from_tables(spark, "/root/testdata/sf0.01")
    sba = t.filter(F.col("LineofBusinessId") == "12")
    assert C.cells(t).count() == 1975
    assert sba.count() == 1074 and C.cells(sba).count() == 797
    assert t.filter(F.col("CommitmentAmt").isNull()).count() == 8598
    assert t.filter(F.col("CurrentMaturityDateKey").isNull()).count() == 1175

    def fired(df):
        cap = C.cap_max_proportion(C.long_panel(C.cells(df))).filter("metric = 'ca'")
        return cap.filter((F.col("Max") > 0.5) & (F.col("Max") < 1.0)).select("ProcessingDateKey").distinct().count()
    assert fired(t) == 1 and fired(sba) == 2


def test_empty_selection(spark, tape):
    """A contradictory filter yields empty results, not errors."""
    none = FilterSpec.of(sba=["SBA"], lob=["1", "2"])
    assert capped_vs_uncapped(tape, none).count() == 0
    assert TP.run_custom(tape, {"sba_classification": "SBA", "line_of_business_ids": ["1"]}).count() == 0


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_composite_spreads_over_dates_and_banks_in_one_scan(spark, tmp_path):
    """One scan of the rows; every exchange of the panel has a date or a bank in its key."""
    rows = [(d, f"b{b}", float(b * d % 97)) for d in range(1, 7) for b in range(300)]
    path = str(tmp_path / "tape")
    spark.createDataFrame(rows, "ProcessingDateKey int, BankID string, x double").selectExpr(
        "ProcessingDateKey", "BankID", "cast(x as decimal(18,2)) as CommitmentAmt", "cast(x as decimal(18,2)) as OutstandingAmt"
    ).write.parquet(path)
    tape = spark.read.parquet(path)
    for df in (capped_vs_uncapped(tape), capped_vs_uncapped(tape, None, CapConfig(missing="nan")), cap_sensitivity(tape, (0.05, 0.1))):
        plan = _final_plan(df)
        assert plan.count("FileScan parquet") == 1
        for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan):
            assert "ProcessingDateKey" in keys or "PrevDateKey" in keys or "BankID" in keys, keys


def test_building_a_plan_runs_nothing(spark, tmp_path):
    tape = spark.range(1).selectExpr("raise_error('evaluated') as BankID", "1 as ProcessingDateKey",
                                     "cast(1 as decimal(18,2)) as CommitmentAmt", "cast(1 as decimal(18,2)) as OutstandingAmt")
    capped_vs_uncapped(tape)
    cap_sensitivity(tape, (0.1,))
