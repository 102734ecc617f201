"""Quality rules and fingerprints against plain Python, and native plans."""

import collections
import hashlib
import random
import re

import pytest
import xxhash

from ledgerlens.llm import fingerprints as FP
from ledgerlens.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [(8, None, None, None), (2, "", "en", "s"), (5, "\n\n \t", None, "s"), (None, "one", "en", None), (9, "a b\na b\n c", "en", "s"),
           (9, "a b\na b\n c", "en", "s"), (4, "ÉÀ %$ " * 20_000, "fr", "s"), (1, "\x1f\x85 nbsp x", "en", "s")]


def frame(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    covered = {x for v in at.values() if len(v) > 1 for i in v for x in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_match_plain_python(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(["a ", "b ", "cc\n", "a b c d e ", "#%", "\t", "é"]) for _ in range(rnd.randint(0, 60))), "en", "s")
            for i in range(150)]
    out = Q.base_counts(frame(spark, rows + AWKWARD)).collect()
    want = sorted(((i is None, i or 0), *counts(t)) for i, t, _, _ in rows + AWKWARD)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), *(r[c] for c in COUNTS)) for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_outliers_are_junk_and_clean_stays(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality_rules(docs)
    rows = out.join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.6 * len(bad)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_estimate_withstands_contamination(spark):
    """A fifth of the rows far away doesn't move the centre."""
    rnd = random.Random(5)
    rows = [tuple(["all"] + [(8.0 if i % 5 == 0 else 0.0) + rnd.gauss(0, 1) for _ in Q.STATS]) for i in range(1500)]
    found = Q.robust_estimates(spark.createDataFrame(rows, ["grp", *Q.STATS])).first()
    assert all(abs(found[f"m_{i}"]) < 0.25 for i in range(len(Q.STATS)))
    assert all(0.5 < found[f"s_{i}_{i}"] - Q.FLOOR[i] ** 2 < 1.7 for i in range(len(Q.STATS)))


def test_consistency_factor():
    assert Q.consistency(5, 0.9999) == pytest.approx(1.0, abs=0.01)
    assert 1.2 < Q.consistency(5, 0.75) < 1.6


def test_rules_on_awkward_and_empty_tables(spark):
    out = Q.quality_rules(frame(spark)).collect()
    assert len(out) == len(AWKWARD) and sum(r["doc_id"] == 9 for r in out) == 2
    assert Q.quality_rules(frame(spark, [])).count() == 0


def edited(rows):
    """Rows in descending doc_id (null last), each with its edited text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    texts = [r[1] or "" for r in order]
    for k, (i, _, _, _) in enumerate(order):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        yield i, t, t[:len(t) - len(t) // 3] + n[:len(t) // 3], n


@pytest.mark.parametrize("per_range", [1, 3, 100])
def test_edited_texts_and_neighbours(spark, monkeypatch, per_range):
    monkeypatch.setattr(FP, "ROWS_PER_RANGE", per_range)
    out = FP.fingerprints(frame(spark)).collect()
    want = sorted(((i is None, i or 0), len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edited(AWKWARD))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_chars"], r["edited_sha256"]) for r in out) == want
    assert FP.fingerprints(frame(spark, [])).count() == 0
    one = FP.fingerprints(frame(spark, [(3, "a b c d e f g h i", "en", "s")])).first()
    assert one["near_next"] == 1.0


def test_fingerprints_estimate_containment(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(4000)]
    rows = [(4, " ".join(words), "en", "s"), (3, " ".join(words[:1000]), "en", "s"), (2, " ".join(words), "en", "s"), (1, "x y z", "en", "s"),
            (5, " ".join(f"v{i}" for i in range(4000)), "en", "s")]
    r = {x["doc_id"]: x for x in FP.fingerprints(frame(spark, rows)).collect()}
    assert r[4]["fingerprint"] == r[2]["fingerprint"] and r[4]["near_next"] > 0.97 and r[3]["near_next"] > 0.97
    assert r[2]["near_next"] == 0.0 and 0.6 < r[5]["near_edited"] < 0.75 and r[5]["near_next"] == 0.0
    hashes = [r[4]["fingerprint"][i:i + 16] for i in range(0, len(r[4]["fingerprint"]), 16)]
    assert hashes == sorted(set(hashes)) and 850 < len(hashes) < 1150 and all(h < "4" for h in hashes)


def shingle_hashes(text):
    """Spark's xxhash64 of the words of every shingle, one after another."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    found = set()
    for k in range(max(len(words) - 4, 1) if words else 0):
        h = 42
        for w in words[k:k + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        found.add(h)
    return found


def brute_sketch(hashes):
    return {h for h in hashes if h < 2 ** (64 - FP.SCALE)} or set([min(hashes, key=signed)] if hashes else [])


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def brute_text(sketch):
    return "".join(f"{h:016X}" for h in sorted(sketch, key=signed))


def brute_likeness(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / min(len(a), len(b))


@pytest.mark.parametrize("table", ["awkward", "documents"])
def test_fingerprints_and_likenesses_against_brute_force(spark, table):
    docs = frame(spark) if table == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None, None) for r in docs.select("doc_id", "text").collect()]
    want = collections.Counter()
    for i, t, e, n in edited(rows):
        own, other, after = (brute_sketch(shingle_hashes(x)) for x in (t, e, n))
        want[(i, brute_text(own), brute_text(other), brute_likeness(own, other), brute_likeness(own, after))] += 1
    columns = ["doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert collections.Counter(map(tuple, FP.fingerprints(docs).select(*columns).collect())) == want


def test_merged_sketches_are_those_of_both_texts(spark):
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randrange(60)}"
    texts = ["", "one", "two words", "a b c d e", "a b c d f"] + [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    pairs = [(a, b) for a, b in zip(texts, texts[1:] + texts[:1])] + [("", ""), ("one", "one"), ("x", "")]
    df = FP.with_sketch(FP.with_sketch(spark.createDataFrame(pairs, "a string, b string"), "a", "s"), "b", "t")
    for r in df.withColumn("m", FP.merge("s", "t")).withColumn("n", FP.merge("t", "s")).collect():
        both = brute_sketch(shingle_hashes(r["a"]) | shingle_hashes(r["b"]))
        assert r["m"] == r["n"] == sorted(map(signed, both))


def test_fingerprint_plan_is_native(spark):
    plan = FP.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def ordinary(rnd, n=60):
    """Lower-case lines, a capital at the start of each."""
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(6 * n)]
    return "\n".join(" ".join(words[6 * i:6 * i + 6]).capitalize() for i in range(n))


def test_each_statistic_rejects_alone(spark):
    rnd = random.Random(8)
    rows = [(i, ordinary(rnd), "en", "s") for i in range(400)]
    lines = ordinary(rnd).split("\n")
    odd = {"long words": " ".join(lines).replace(" ", "").lower(), "capitals": "\n".join(lines).upper(),
           "bars": "\n".join(x.replace(" ", " | ") for x in lines), "equal lines": "\n".join(x + "\nread on" for x in lines),
           "all lines equal": "\n".join(["Read on here now and then"] * 60)}
    odd["long words"] = " ".join(odd["long words"][i:i + 24] for i in range(0, 1400, 24))
    words = ordinary(rnd, 265).split()                            # 19.6 % repeated, the base rule begins at 20 %
    odd["repeats"] = " ".join(x for i in range(0, 1590, 25) for x in [*words[i:i + 25], *"read on here now and then".split()])
    rows += [(1000 + k, t, "en", "s") for k, t in enumerate(odd.values())]
    got = {r["doc_id"]: r for r in Q.quality_rules(frame(spark, rows)).collect()}
    assert {name: got[1000 + k]["kept"] for k, name in enumerate(odd)} == dict.fromkeys(odd, False)
    assert not any(got[1000 + k]["base_failed"] for k, name in enumerate(odd) if name != "all lines equal")
    assert sum(got[i]["kept"] for i in range(400)) >= 396


def test_small_sources_are_judged_by_the_whole_language_or_corpus(spark):
    rnd = random.Random(9)
    bars = lambda: ordinary(rnd).replace(" ", " | ")
    rows = [(i, ordinary(rnd), "en", "big") for i in range(700)]
    rows += [(1000, bars(), "en", "lone"), (1001, ordinary(rnd), "en", "lone too"), (1002, bars(), None, "lone"), (1003, bars(), "xx", None)]
    rows += [(2000 + i, bars(), "en", "spam") for i in range(150)]
    got = {r["doc_id"]: r["kept"] for r in Q.quality_rules(frame(spark, rows)).collect()}
    assert {i: k for i, k in got.items() if i >= 1000} == {1000: False, 1001: True, 1002: False, 1003: False} | {2000 + i: False for i in range(150)}
    assert sum(got[i] for i in range(700)) >= 693
