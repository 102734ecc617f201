"""The composite against a brute-force dense-pivot computation on random
sparse panels (zeros, equal shares, gaps), both missing-value modes.
All random panels run as scopes of ONE Spark plan."""

import random
from decimal import Decimal
from fractions import Fraction
from functools import cache

import pytest

from ledgerlens.config import CapConfig
from ledgerlens.operators import composite as C


def brute(cells, missing):
    """The definitions in exact fractions, each value asked for by period and
    bank: {(date, bank): Decimal} -> (limits, chain, composite) dicts."""
    dates, banks = sorted({d for d, _ in cells}), sorted({b for _, b in cells})
    before = dict(zip(dates[1:], dates))
    one, cap = Fraction(1), Fraction(1, 2)
    high, low = (Fraction(1, 10), Fraction(1, 5)), (Fraction(-1, 11), Fraction(-1, 6))     # usual, wide

    @cache
    def capped(d, b):
        amounts = {x: Fraction(cells[d, x]) for x in banks if (d, x) in cells}
        total = sum(amounts.values())
        top = max(amounts.values()) / total if total else None
        if b not in amounts or top is None or not cap < top < one:
            return amounts.get(b)
        return total * cap if amounts[b] / total == top else amounts[b] * (one - cap) / (one - top)

    @cache
    def change(d, b):
        new, old = capped(d, b), capped(before[d], b) if d in before else None
        return None if new is None or not old else new / old - 1

    @cache
    def limits(d):
        known = [c for c in (change(d, b) for b in banks) if c is not None]
        absent = len(banks) - len(known) if missing == "nan" else 0
        counted = len(known) + absent
        up, down = sum(c > high[0] for c in known) + absent, sum(c < low[0] for c in known)
        return high[2 * up >= counted > 0], low[2 * down >= counted > 0]

    @cache
    def clamped(d, b):
        """Value of a bank's chain; it starts anew where it has no predecessor."""
        if not included(d, b):
            return capped(d, b)
        top, bottom = limits(d)
        old = clamped(before[d], b)
        return old * (one + sorted((bottom, capped(d, b) / old - 1, top))[1])

    @cache
    def included(d, b):
        return capped(d, b) is not None and d in before and bool(clamped(before[d], b))

    def composite(d):
        members = [b for b in banks if included(d, b)]
        gap = any(capped(x, b) is None for x in (d, before.get(d)) for b in banks) if d in before else True
        prior = sum(clamped(before[d], b) for b in members)
        if not prior or (missing == "nan" and gap):
            return None
        return float(sum(clamped(d, b) for b in members) / prior - 1)

    chain = {(d, b): (float(clamped(d, b)), included(d, b)) for d, b in cells}
    return ({d: tuple(map(float, limits(d))) for d in dates}, chain, {d: composite(d) for d in dates})


def panels(k=40):
    out = {}
    for seed in range(k):
        rnd = random.Random(seed)
        nb, nd = rnd.randint(1, 5), rnd.randint(2, 8)
        cells = {}
        for d in range(1, nd + 1):
            for b in range(nb):
                if rnd.random() < 0.78:
                    cells[(d, f"b{b}")] = Decimal(rnd.choice([0, 50, 100, 100, 104, 111, 130, 200, 900,
                                                              rnd.randint(1, 1000)]))
        if cells:
            out[seed] = cells
    return out


@pytest.mark.parametrize("missing", ["exclude", "nan"])
def test_composite_matches_bruteforce(spark, missing):
    ps = panels()
    rows = [(s, d, a, a, b) for s, cells in ps.items() for (d, b), a in cells.items()]
    df = spark.createDataFrame(rows, "seed int, ProcessingDateKey int, CommitmentAmt decimal(18,2), "
                                     "OutstandingAmt decimal(18,2), BankID string")
    parts = C.composite_parts(C.cells(df, ["seed"]), ["seed"], CapConfig(missing=missing))
    lims = {(r["seed"], r["ProcessingDateKey"]): (r["lim_max"], r["lim_min"])
            for r in parts["limits"].filter("metric = 'ca'").collect()}
    chain = {(r["seed"], r["ProcessingDateKey"], r["BankID"]): (r["mod"], r["inc"])
             for r in parts["chain"].filter("metric = 'ca'").collect()}
    comp = {(r["seed"], r["ProcessingDateKey"]): r["perc_diff"]
            for r in parts["composite"].filter("metric = 'ca'").collect()}
    for s, cells in ps.items():
        blim, bchain, bcomp = brute(cells, missing)
        for d, want in blim.items():
            assert lims[(s, d)] == pytest.approx(want), (s, d)
        for (d, b), (m, f) in bchain.items():
            got_m, got_f = chain[(s, d, b)]
            assert got_f == f, (s, d, b)
            assert got_m == pytest.approx(m, rel=1e-12, abs=1e-9), (s, d, b)
        for d, want in bcomp.items():
            got = comp[(s, d)]
            assert (got is None) == (want is None), (s, d, got, want)
            if want is not None:
                assert got == pytest.approx(want, rel=1e-9, abs=1e-12), (s, d)
