"""Personal data: fixed patterns against plain regular expressions, the field
against enumeration and on altered spellings, awkward rows."""

import itertools
import math
import random
import re

import pytest

from ledgerlens.llm import personal as P
from ledgerlens.llm import queries

SF = "/root/testdata/sf0.01"
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_way(text):
    count = lambda m: len(re.sub("[^0-9]", "", m.group()))
    found = [(m.start(), m.end(), 0) for m in MAIL.finditer(text)]
    found += [(m.start(), m.end(), 1) for m in ADDRESS.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), m.end(), 2) for m in CARD.finditer(text)
              if 14 <= count(m) <= 19 and passes_luhn(re.sub("[^0-9]", "", m.group()))]
    found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= count(m) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_patterns_on_random_texts():
    rnd = random.Random(3)
    for alphabet in ("aZ09.%_+- @()é٣\n12345", "12345678 -", "a.@-b", "0125.3"):
        for _ in range(8_000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(45)))
            assert P.base_spans(text) == plain_way(text), text


def test_best_segmentation_and_probabilities_by_enumeration():
    rnd = random.Random(4)
    for _ in range(200):
        spans = {tuple(sorted(rnd.sample(range(7), 2))) + (rnd.randrange(4),) for _ in range(rnd.randrange(1, 7))}
        segments = [P.Segment(*s) for s in sorted(spans)]
        scores = [rnd.uniform(-2, 3) for _ in segments]
        touch = [[rnd.uniform(-2, 0) for _ in range(4)] for _ in range(4)]
        totals = {}
        for size in range(len(segments) + 1):
            for chosen in itertools.combinations(range(len(segments)), size):
                order = sorted(chosen, key=lambda k: segments[k].start)
                if any(segments[a].end > segments[b].start for a, b in itertools.pairwise(order)):
                    continue
                totals[tuple(order)] = sum(scores[k] for k in order) + sum(
                    touch[segments[a].kind][segments[b].kind] for a, b in itertools.pairwise(order) if segments[a].end == segments[b].start)
        lattice = P.Lattice(segments)
        best = lattice.best(scores, touch)
        assert math.isclose(totals[tuple(best)], max(totals.values()), abs_tol=1e-9)
        norm = sum(math.exp(v) for v in totals.values())
        for k, p in enumerate(lattice.marginals(scores, touch)):
            assert math.isclose(p, sum(math.exp(v) for c, v in totals.items() if k in c) / norm, abs_tol=1e-9)


def test_decoding_in_groups_equals_one_lattice(model):
    rnd = random.Random(6)
    for _ in range(150):
        text = " ".join(rnd.choice(["(415) 555-2671", "4111 1111 1111 1111", "10[.]0[.]0[.]1", "a at b dot com", "und", "7", "2023-01-31"])
                        for _ in range(rnd.randrange(1, 6)))
        segments = [s for lo, hi in P.windows(text) for s in P.candidates(text, lo, hi)]
        scores = [model.score(text, s) - P.SURE for s in segments]
        value = lambda chosen: sum(scores[segments.index(s)] for s in chosen)
        whole = [segments[k] for k in P.Lattice(segments).best(scores, model.touch)] if segments else []
        got = [next(s for s in segments if (s.start, s.end, s.kind) == g) for g in P.decode(text, model)]
        assert math.isclose(value(whole), value(got), abs_tol=1e-6)


def test_field_finds_the_patterns_spans_and_altered_ones(spark, model):
    """On windows it was not fitted on: sf0.01."""
    rnd = random.Random(9)
    texts = [r["text"] for r in documents(spark).where("text is not null").collect()]
    plain = [(t, P.base_spans(t)) for t in texts]
    plain = [(t, s) for t, s in plain if s]
    for examples, recall in ((plain, 0.95), ([P.altered(t, s, rnd) for t, s in plain * 10], 0.85)):
        hit = found = true = 0
        for text, spans in examples:
            got = set(P.decode(text, model))
            hit, found, true = hit + len(got & set(spans)), found + len(got), true + len(set(spans))
        assert true >= 20 and hit >= recall * true and hit >= 0.95 * found


def test_spellings_that_the_patterns_miss(model):
    got = lambda t: [(t[s:e], P.KINDS[k]) for s, e, k, base in P.spans_of(t, model) if not base]
    assert got("call (415) 555-2671 today") == [("(415) 555-2671", "phone")]
    assert got("pay 7 4111 1111 1111 1111 now") == [("4111 1111 1111 1111", "card")]      # the digit before hid it
    assert got("host 10[.]0[.]0[.]1 is down") == [("10[.]0[.]0[.]1", "ip")]
    for clean in ("in 2023-01-31 at 10:30:00, pages 1999-2004, 3.14", "order 1234567890123456", "isbn 978-3-16-148410-0", "look at this"):
        assert got(clean) == []


def test_clean_documents_stay_clean(spark, model):
    rows = [r["text"] or "" for r in documents(spark).collect()]
    added = sum(any(not s[3] for s in P.spans_of(t, model)) for t in rows if not P.base_spans(t))
    assert added <= 0.002 * len(rows)


def test_awkward_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "+1 (268) 555-6289"), (None, "+1 (268) 555-6289"), (5, "x " * 200_000 + "a@b.co"), (6, "😀 a@b.co")]
    docs = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, spans int, kind string")
    got = sorted(((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in P.personal_spans(docs, model).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (None, [("phone", 0, 17, True)]), (None, [("phone", 0, 17, True)]),
                          (5, [("email", 400_000, 400_006, True)]), (6, [("email", 2, 8, True)])], key=str)
    assert P.personal_spans(docs.limit(0)).count() == 0


def test_query_counts_and_spans(spark):
    got = {r["doc_id"]: r for r in queries.op12_personal(spark, SF).collect()}
    import hashlib
    for r in documents(spark).collect():
        base = plain_way(r["text"] or "")
        row = got[r["doc_id"]]
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(s[2] == k for s in base) for k in range(4)]
        names = [f"{P.KINDS[k]}:{s}:{e}" for s, e, k in base]
        assert row["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(row["spans"].split(",")) | {""}
