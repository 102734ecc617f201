"""Golden values hand-computed from the formulas (FIXTURES.md §2, §3)."""

from decimal import Decimal

import pytest

from ledgerlens.config import CapConfig
from ledgerlens.operators import composite as C
from ledgerlens.plans.analysis import capped_vs_uncapped

SEED = [
    (20240131, 1000000, 800000, "Rocky Mountain", "11", "B001"),
    (20240131, 500000, 450000, "Pacific", "12", "B002"),
    (20240229, 1200000, 900000, "Rocky Mountain", "11", "B001"),
    (20240229, 400000, 350000, "Pacific", "12", "B002"),
    (20240331, 1500000, 950000, "Rocky Mountain", "11", "B001"),
    (20240331, 450000, 380000, "Pacific", "12", "B002"),
]
SEED_SCHEMA = ("ProcessingDateKey int, CommitmentAmt decimal(18,2), OutstandingAmt decimal(18,2), "
               "Region string, LineofBusinessId string, BankID string")

GAP = {1: {"A": 100, "B": 90, "C": 80, "D": 70}, 2: {"A": 105, "B": 95, "C": 100, "D": 72},
       3: {"A": 130, "B": 97, "D": 75}, 4: {"A": 120, "B": 60, "C": 90, "D": 74}}


def seed_df(spark):
    return spark.createDataFrame([(d, Decimal(c), Decimal(o), r, l, b) for d, c, o, r, l, b in SEED], SEED_SCHEMA)


def gap_parts(spark, missing):
    rows = [(p, Decimal(v), Decimal(v), b) for p, d in GAP.items() for b, v in d.items()]
    df = spark.createDataFrame(rows, "ProcessingDateKey int, CommitmentAmt decimal(18,2), "
                                     "OutstandingAmt decimal(18,2), BankID string")
    return C.composite_parts(C.cells(df), (), CapConfig(cell_weight=1.0, missing=missing))


def test_seed_capped_vs_uncapped(spark):
    rows = {r["ProcessingDateKey"]: r for r in capped_vs_uncapped(seed_df(spark)).collect()}
    assert [rows[d]["Deals"] for d in sorted(rows)] == [2, 2, 2]
    assert rows[20240131]["ProcessingDateKeyPrior"] == 0
    assert rows[20240131]["ca_diff"] is None and rows[20240131]["ca_model_diff"] is None
    assert rows[20240229]["ca_diff"] == pytest.approx(0.066667, abs=1e-6)
    assert rows[20240229]["ca_model_diff"] == pytest.approx(0.066667, abs=1e-6)
    assert rows[20240331]["ca_diff"] == pytest.approx(0.21875)
    assert rows[20240331]["oa_diff"] == pytest.approx(0.064)
    # both banks grow 21.9 %: 100 % breach -> the high limit 20 % applies
    assert rows[20240331]["ca_model_diff"] == pytest.approx(0.2)
    assert rows[20240331]["oa_model_diff"] == pytest.approx(0.064)
    assert rows[20240331]["deals_model_diff"] == pytest.approx(0.0)


@pytest.mark.parametrize("missing,upper,comp", [
    ("exclude", [0.1, 0.1, 0.1, 0.1], [None, 0.058824, 0.056985, -0.018498]),
    ("nan", [0.2, 0.1, 0.2, 0.1], [None, 0.058824, None, None]),
])
def test_gap_panel(spark, missing, upper, comp):
    p = gap_parts(spark, missing)
    lim = {r["ProcessingDateKey"]: r for r in p["limits"].filter("metric = 'ca'").collect()}
    assert [lim[t]["lim_max"] for t in (1, 2, 3, 4)] == pytest.approx(upper)
    assert [lim[t]["lim_min"] for t in (1, 2, 3, 4)] == pytest.approx([-0.1 / 1.1] * 4)
    ch = {(r["BankID"], r["ProcessingDateKey"]): r for r in p["chain"].filter("metric = 'ca'").collect()}
    a3 = 126.0 if missing == "nan" else 115.5
    assert [ch[("A", t)]["mod"] for t in (1, 2, 3, 4)] == pytest.approx([100, 105, a3, 120])
    assert [ch[("B", t)]["mod"] for t in (1, 2, 3, 4)] == pytest.approx([90, 95, 97, 88.181818], abs=1e-5)
    assert [ch[("C", t)]["mod"] for t in (1, 2, 4)] == pytest.approx([80, 88, 90])
    assert ("C", 3) not in ch
    assert [ch[("C", t)]["inc"] for t in (1, 2, 4)] == [False, True, False]
    got = {r["ProcessingDateKey"]: r["perc_diff"] for r in p["composite"].filter("metric = 'ca'").collect()}
    for t, want in zip((1, 2, 3, 4), comp):
        if want is None:
            assert got[t] is None
        else:
            assert got[t] == pytest.approx(want, abs=1e-6)
