"""W13 record-level change across many ranges against a sequential pass."""

import bisect
import random
import uuid
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.series import _cuts_below, attach_by_position, join_prior, positions, record_pop, with_ranges


def brute(rows):
    out, prev = {}, None
    for i, (k1, k2, x) in enumerate(sorted(rows)):
        if i == 0:
            out[(k1, k2)] = 0.0
        elif prev is None or x is None:
            out[(k1, k2)] = None
        elif prev == 0:
            out[(k1, k2)] = 0.0
        else:
            out[(k1, k2)] = (x - prev) / prev
        prev = x
    return out


@pytest.mark.parametrize("size", [1000, 40, 3])
def test_record_pop_matches_sequential(spark, size):
    rnd = random.Random(size)
    rows = [(rnd.choice([1, 2, 2, 2, 3]), i, rnd.choice([None, 0.0, 5.0, 10.0, rnd.uniform(1, 100)]))
            for i in range(300)]                      # key 2 is a hot group
    df = spark.createDataFrame(rows, "k1 int, k2 int, x double")
    got = {(r["k1"], r["k2"]): r["x_perc_diff"] for r in record_pop(df, ["k1", "k2"], ["x"], size).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g is None) == (w is None), k
        if w is not None:
            assert g == pytest.approx(w, rel=1e-12, abs=1e-12), k


def test_hot_period_is_split(spark):
    rows = [(1 if i % 3 else 2, i, float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k1 int, k2 int, x double")
    sizes = [r["count"] for r in with_ranges(df, ["k1", "k2"], 50).groupBy("_range").count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 120


def test_positions_of_a_record_level_series(spark):
    rows = [(1 if i % 3 else 2, (i * 37) % 600) for i in range(600)]
    got = {(r["k1"], r["k2"]): r["_pos"] for r in
           positions(spark.createDataFrame(rows, "k1 int, k2 int"), ["k1", "k2"]).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(rows))}


def test_attach_pads_and_cuts(spark):
    left = spark.createDataFrame([(10,), (20,), (30,)], "d int")
    short = spark.createDataFrame([(5, "a"), (7, "b")], "s int, v string")
    got = [(r["d"], r["v"]) for r in attach_by_position(left, "d", short, "s", ["v"]).orderBy("d").collect()]
    assert got == [(10, "a"), (20, "b"), (30, None)]
    got = [(r["s"], r["d"]) for r in attach_by_position(short, "s", left, "d", ["d"]).orderBy("s").collect()]
    assert got == [(5, 10), (7, 20)]


def test_join_prior_keeps_the_scope_of_first_periods(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 1, 7)], "g string, ProcessingDateKey int, x int")
    got = sorted(((r["g"], r["ProcessingDateKey"], r["xPrior"]) for r in join_prior(df, ["g"], metrics=["x"]).collect()), key=str)
    assert got == sorted([("a", 1, None), ("a", 2, 5), (None, 1, None)], key=str)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 8, 63, 64, 65, 300])
def test_cuts_below(spark, count):
    cuts = [3 * k for k in range(count)]
    keys = [-1, 0, 1, 3 * count // 2, 3 * count, *range(180, 200)]
    df = spark.createDataFrame([(cuts, v) for v in keys], "cuts array<int>, key int")
    got = [r["n"] for r in df.select(_cuts_below(F.struct("cuts", "key")).alias("n")).collect()]
    assert got == [bisect.bisect_left(cuts, v) for v in keys]


def hot_rows(n=1200):
    """Two thirds share one (period, key) pair; string keys, nulls, decimals."""
    rnd = random.Random(5)
    return [(20240131, "bank" if i % 3 else rnd.choice([None, "", "a", "z"]), Decimal(rnd.randrange(10_000)) / 100, i) for i in range(n)]


def test_hot_pair_is_split_by_the_next_column(spark):
    df = spark.createDataFrame(hot_rows(), "d int, k string, amt decimal(12,2), id long")
    ranged = with_ranges(df, ["d", "k", "amt", "id"], 50).collect()
    sizes = Counter(r["_range"] for r in ranged)
    assert len(sizes) >= 16 and max(sizes.values()) <= 130
    assert len({r["_range"] for r in ranged if r["k"] == "bank"}) >= 8
    rank = lambda r: (r["d"], r["k"] is not None, r["k"] or "", r["amt"], r["id"])
    numbers = [r["_range"] for r in sorted(ranged, key=rank)]
    assert numbers == sorted(numbers)


def test_ranges_do_not_depend_on_the_layout(spark):
    df = spark.createDataFrame(hot_rows(), "d int, k string, amt decimal(12,2), id long")
    ranges = lambda x: {r["id"]: r["_range"] for r in with_ranges(x, ["d", "k", "amt", "id"], 40).collect()}
    assert ranges(df.repartition(7)) == ranges(df.coalesce(1).orderBy(F.desc("id")))


def jobs(spark, run):
    """What ``run`` gives, and how many jobs it started."""
    group = f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_job_runs_while_the_plan_is_built(spark):
    df = spark.createDataFrame(hot_rows(90), "d int, k string, amt decimal(12,2), id long").repartition(3)
    for build in (lambda: record_pop(df, ["d", "k", "id"], ["amt"], 10), lambda: positions(df, ["d", "k"]),
                  lambda: attach_by_position(df, "d", df.withColumnRenamed("amt", "b"), "d", ["b"])):
        out, started = jobs(spark, build)
        assert started == 0
        assert jobs(spark, out.count)[1] > 0 and out.count() == 90


def test_the_plan_carries_no_cut_points(spark):
    df = spark.createDataFrame(hot_rows(90), "d int, k string, amt decimal(12,2), id long")
    plan = with_ranges(df, ["d", "k", "id"], 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _cuts" not in plan and "scalar-subquery" in plan


def test_string_keys_and_ties_match_a_sequential_pass(spark):
    rows = [(d, k, x) for d, k, x, _ in hot_rows(400)] + [(20240131, "bank", None), (None, "q", Decimal("0.00")), (None, None, Decimal(1))] * 2
    df = spark.createDataFrame(rows, "d int, k string, amt decimal(12,2)")
    got = Counter((r["d"], r["k"], r["amt"], r["amt_perc_diff"] if r["amt_perc_diff"] is None else round(r["amt_perc_diff"], 9))
                  for r in record_pop(df, ["d", "k"], ["amt"], 25).collect())
    rank = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    want, prev = Counter(), "first"
    for d, k, x in sorted(rows, key=rank):
        change = 0.0 if prev == "first" else None if prev is None or x is None else 0.0 if prev == 0 else round(float(x - prev) / float(prev), 9)
        want[(d, k, x, change)] += 1
        prev = x
    assert got == want


def test_positions_in_a_scope_with_hot_ties_and_repeated_rows(spark):
    rows = [("s" if i % 3 else None, 1 if i % 5 else 2, i // 2, {"m": i}) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, d int, v int, extra map<string,int>")
    got = positions(df, "d", ["g"], rows=20).collect()
    for g in ("s", None):
        mine = sorted((r["_pos"], r["d"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1))
        assert [d for _, d in mine] == sorted(d for _, d in mine)
    assert sum(r["v"] for r in got) == sum(v for _, _, v, _ in rows)


def test_empty_series(spark):
    df = spark.createDataFrame([], "d int, x double")
    assert record_pop(df, ["d"], ["x"]).collect() == [] == positions(df, "d").collect()
