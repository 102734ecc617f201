"""Fill-in-the-middle: cuts against a plain split into units, round trips."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import fim

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_way(text, doc_id):
    """The output by slices of the list of units."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexa = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexa[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(rnd, count):
    alphabet = "abcXYZ  \n\x00.é😀ı<PSM>"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 2, 9, 80, 2_000]))) for _ in range(count)]


@pytest.mark.parametrize("slice_chars", [1, 7, 1 << 20])
def test_boundaries_are_reached_exactly(monkeypatch, slice_chars):
    monkeypatch.setattr(fim, "SLICE_CHARS", slice_chars)
    for text in texts(random.Random(slice_chars), 60):
        ends = list(itertools.accumulate(len(u) for u in UNIT.findall(text)))
        assert list(fim.unit_ends(text)) == ends
        lanes = fim.SkipList(fim.unit_ends(text))
        assert [lanes.point(r) for r in range(len(ends) + 1)] == [0, *ends]
    with pytest.raises(IndexError):
        lanes.point(len(ends) + 1)


def test_lanes_carry_the_whole_width_and_thin_out():
    text = "word é " * 30_000
    lanes = fim.SkipList(fim.unit_ends(text)).lanes
    sizes = [len(units) for units, _, _ in lanes]
    assert len(lanes) >= 5 and all(b < a / 4 for a, b in zip(sizes, sizes[1:], strict=False) if a > 1_000)
    for (units, points, _), (upper, upper_points, below) in itertools.pairwise(lanes):
        ends = below[1:]                                   # a link's widths are the sum of those underneath
        assert list(upper) == [int(units[a:b].sum()) for a, b in itertools.pairwise([*below[:1], *ends])]
        assert int(upper_points.sum()) == int(points[:below[-1]].sum())


def test_spark_equals_the_plain_way_and_restores(spark):
    rnd = random.Random(13)
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts(rnd, 300))] + [(5, None), (5, None), (8, "<M>"), (9, "Long é " * 60_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, output string")
    found = fim.fill_in_middle(docs)
    got = [tuple(r) for r in found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()]
    assert sorted((g[:6] for g in got), key=str) == sorted((plain_way(t, i) for i, t in rows), key=str)
    assert sorted(g[6] for g in got) == sorted(t or "" for _, t in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_parameters(spark):
    docs = spark.createDataFrame([(k, "one two three") for k in range(200)], "doc_id long, text string")
    forms = lambda **kw: {r["form"] for r in fim.fill_in_middle(docs, **kw).collect()}
    assert forms(rearranged=0) == {"plain"} and forms(rearranged=100, suffix_first=100) == {"spm"}
    other = {tuple(r) for r in fim.fill_in_middle(docs, seed=2).collect()}
    assert other != {tuple(r) for r in fim.fill_in_middle(docs).collect()}
