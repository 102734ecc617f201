"""Packing, tokens and mixing against brute force and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import mixing as M
from ledgerlens.llm import packing as P
from ledgerlens.llm.tokens import encoder

SF = "/root/testdata/sf0.01"
TEXTS = ["", " a", "a ", "a  b", "a\n\nb", "x \n y", "\ttab", "é à\xa0b", "don't I'll 12 3a4", "<|endoftext|> hi", "   ", "\n", "a\n",
         " \n", "日本 語", "a b\nc d", "Plain words, here.\nAnd there"]


def test_ids_are_those_of_the_vocabulary(spark):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = encoder()
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    for t in texts:
        assert np.frombuffer(ids(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, t[:40]
    assert ids(None) == b""


def optimum(sizes, cap):
    best = [len(sizes)]

    def go(rest, rooms):
        if len(rooms) >= best[0]:
            return
        if not rest:
            best[0] = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= rest[0]:
                go(rest[1:], rooms[:i] + [room - rest[0]] + rooms[i + 1:])
        go(rest[1:], rooms + [cap - rest[0]])
    go(sorted(sizes, reverse=True), [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 9))]
        bins = P.bin_completion(sizes, 20)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= 20 for b in bins)
        assert len(bins) == optimum(sizes, 20)
        assert len(bins) <= len(P.best_fit(sorted(sizes, reverse=True), 20))


def test_completion_beats_best_fit():
    sizes = [6, 6, 5, 5, 4, 4, 4, 3, 3]              # 40 = 4 x 10
    assert len(P.bin_completion(sizes, 10)) == 4


def test_completion_tries_every_filling():
    sizes = [50, 49, 48, 32, 30, 26, 24, 21, 20]     # 50 + 26 + 24, 49 + 30 + 21, 48 + 32 + 20
    assert len(P.best_fit(sizes, 100)) == 4 and sorted(map(sum, P.bin_completion(sizes, 100))) == [100] * 3
    rnd = random.Random(6)
    for _ in range(40):                              # full bins of three large pieces
        sizes = [x for _ in range(4) for a in [rnd.randint(35, 50)] for b in [rnd.randint(20, 40)] for x in (a, b, 100 - a - b)]
        assert len(P.bin_completion(sizes, 100, nodes=200_000)) == 4


def test_lower_bound():
    """Never over the least number of bins, never under the tokens' bound."""
    rnd = random.Random(11)
    above = 0
    for _ in range(150):
        sizes = [rnd.randint(1, 20) for _ in range(rnd.randint(0, 9))]
        bound = P.lower_bound(sizes, 20)
        least = optimum(sizes, 20)
        assert -(-sum(sizes) // 20) <= bound <= least
        above += bound > -(-sum(sizes) // 20)
    assert above > 10
    assert P.lower_bound([11] * 7, 20) == 7 and P.lower_bound([11] * 3 + [10, 10, 9, 9, 9], 20) == 4
    assert P.lower_bound([15, 14, 12, 9, 9, 9], 20) == 5


def test_search_to_the_end_is_optimal():
    rnd = random.Random(12)
    for _ in range(40):
        sizes = [rnd.randint(3, 14) for _ in range(rnd.randint(1, 8))]
        assert len(P.bin_completion(sizes, 20, nodes=None)) == optimum(sizes, 20), sizes


def test_repeated_rows_are_dealt_to_all_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 100)
    rows = [(7, "one and the same text")] * 900 + [(None, None)] * 300
    out = P.pack(spark.createDataFrame(rows, "doc_id long, text string"), nodes=100).collect()
    check_packing(out, rows)
    pieces = Counter(r["sequence_id"] >> 32 for r in out)
    assert len(pieces) == 12 and max(pieces.values()) < 170


def check_packing(rows, docs, capacity=2048):
    ids_of = encoder()
    want = {}
    for i, text in docs:
        ids = ids_of(text) + b"\0\0\0\0"
        want.setdefault(i, []).append(ids)
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = next(x for x in want[r["doc_id"]] if zlib.crc32(x[4 * r["start"]:4 * (r["start"] + r["length"])]) == r["ids_crc32"])
        assert 4 * (r["start"] + r["length"]) <= len(ids)
        assert r["length"] == capacity or r["piece"] == 0
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 for v in want.values() for x in v)
    return len(at), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    used, bound = check_packing(P.pack(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert used <= bound + 1


def test_packing_awkward_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (4, "word " * 30_000), (5, "x" * 5_000)]
    check_packing(P.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def fill(budget, kids):
    """Weighted water filling by hand: (capacity, weight) -> amounts."""
    out, left = [0.0] * len(kids), budget
    open_ = [i for i, (c, w) in enumerate(kids) if w > 0]
    while open_ and left > 1e-9:
        total = sum(kids[i][1] for i in open_)
        full = [i for i in open_ if kids[i][0] - out[i] <= left * kids[i][1] / total + 1e-12]
        if not full:
            for i in open_:
                out[i] += left * kids[i][1] / total
            return out
        for i in full:
            left -= kids[i][0] - out[i]
            out[i] = kids[i][0]
        open_ = [i for i in open_ if i not in full]
    return out


def test_budgets_match_water_filling(spark):
    rnd = random.Random(8)
    leaves = [(d, g, f"s{s}", rnd.randint(0, 400)) for d in ("web", "news", "books") for g in ("en", "de", "fr") for s in range(3)]
    weights = M.WEIGHTS
    for share, epochs in ((0.3, 1), (0.95, 1), (1.8, 2), (9.0, 3)):
        budget = share * sum(x[3] for x in leaves)
        got = {tuple(r)[:3]: r["alloc"] for r in M.budgets(
            spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), budget, weights, epochs).collect()}
        cap = lambda *k: float(epochs * sum(x[3] for x in leaves if x[:len(k)] == k))
        domains = sorted({x[0] for x in leaves})
        for d, b in zip(domains, fill(budget, [(cap(d), weights["domain"][d]) for d in domains])):
            langs = sorted({x[1] for x in leaves if x[0] == d})
            for g, c in zip(langs, fill(b, [(cap(d, g), weights["lang"][g]) for g in langs])):
                names = sorted({x[2] for x in leaves if x[:2] == (d, g)})
                for s, amount in zip(names, fill(c, [(cap(d, g, s), 1.0) for s in names])):
                    assert got[d, g, s] == pytest.approx(amount, abs=1e-6)


def test_leaves_take_epochs_and_a_prefix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leaf = {(r["domain"], r["lang"], r["source"]): r for r in M.plan(docs, 0.9, 3).collect()}
    rows = M.mix(docs, 0.9, 3).select("doc_id", "lang", "source", "mix_domain", "mix_epoch", "mix_tokens", "mix_take").collect()
    every = docs.select("doc_id", "lang", "source", M.domain_of().alias("domain"), F.expr(M.TOKENS).alias("n")).collect()
    for key, plan in leaf.items():
        mine = [r for r in rows if (r["mix_domain"], r["lang"], r["source"]) == key]
        assert sum(r["mix_take"] for r in mine) == plan["alloc"]
        want, left = set(), plan["rest"]
        members = [r for r in every if (r["domain"], r["lang"], r["source"]) == key and r["n"] > 0]
        for e in range(plan["whole"]):
            want |= {(r["doc_id"], e) for r in members}
        digest = lambda r: hashlib.md5(f"{M.SEED}:{plan['whole']}:{r['doc_id']}".encode()).hexdigest()  # noqa: B023,E731
        for r in sorted(members, key=digest):
            if left <= 0:
                break
            want.add((r["doc_id"], plan["whole"]))
            left -= r["n"]
        assert {(r["doc_id"], r["mix_epoch"]) for r in mine} == want


def test_mixing_awkward_rows(spark):
    rows = [(1, None, "en", "src1", 0), (2, "a b c", None, None, 0), (None, "a b", "en", "src1", 0), (4, "a " * 50, "xx", "odd", 0),
            (4, "a " * 50, "xx", "odd", 0), (6, "", "de", "src99999999999", 0)]
    schema = "doc_id long, text string, lang string, source string, mix_extra int"
    out = M.mix(spark.createDataFrame(rows, schema), 1.0, 1)
    assert sorted((r["doc_id"] or 0, r["mix_take"]) for r in out.collect()) == [(0, 2), (2, 3), (4, 50), (4, 50)]
    assert M.mix(spark.createDataFrame([], schema), 1.0, 1).count() == 0


def test_mixing_keeps_columns_named_like_the_plans(spark):
    rows = [(i, "a b c", "en", "src1", f"w{i}", f"c{i}", i, "own", i) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, whole string, cut string, tokens int, domain string, mix_digest int"
    out = M.mix(spark.createDataFrame(rows, schema), 0.5, 1)
    got = out.collect()
    assert out.columns == [c.split()[0] for c in schema.split(", ")] + ["mix_domain", "mix_tokens", "mix_epoch", "mix_take"]
    assert sum(r["mix_take"] for r in got) == 60 and {tuple(r)[:9] for r in got} <= set(rows)
