"""Lexical search: the ball tree against brute force, awkward rows."""

import math
import random
import re

import numpy as np
import pytest

from ledgerlens.llm import lexical as X

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top=10):
    """(item row, rank, doc_id, score) from the formula, every pair."""
    split = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = {}
    for _, words in split:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    found = []
    for k, (item, text) in enumerate(items):
        rows = []
        for i, words in split:
            if not words:
                continue
            m = 100 - 90 + (90 * len(words) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * ((1_000_000_000 * words.count(w)) // (1000 * words.count(w) + 8 * m))
                        for w in set(terms(text)) if w in words)
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        found += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(found, key=str)


def corpus(rnd, n, words=60):
    vocabulary = [f"w{k}" for k in range(words)] + ["Été", "naïve", "ÑU", "x1"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([1, 3, 8, 30]))) for _ in range(n)]
    return [(rnd.randrange(10 * n) if rnd.random() < 0.9 else None, rnd.choice(texts)) for _ in range(n)]


def searched(spark, docs, items, **kw):
    got = X.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"),
                           spark.createDataFrame(items, "item_id long, text string"), **kw).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(11)
    docs = corpus(rnd, 400) + [(9001, None), (9002, ""), (9003, "--- !!"), (9004, "w1 " * 40_000)]
    items = [(k, docs[k][1]) for k in range(12)] + [(50, None), (51, "nowhere"), (52, "W1, w2;w3-ÑU.Été été"), (None, "w5 w6")]
    assert searched(spark, docs, items) == brute(docs, items)


def test_repeated_rows_and_ties(spark):
    docs = [(7, "alpha beta gamma")] * 8 + [(None, "alpha beta gamma")] * 3 + [(3, "alpha beta gamma"), (2, "delta"), (1, "epsilon")]
    items = [(5, "alpha beta"), (6, "delta delta")]
    got = searched(spark, docs, items)
    assert got == brute(docs, items)
    assert [g[2] for g in sorted(got) if g[0] == 5] == [3] + [7] * 8 + [None]
    assert searched(spark, docs, items, top=2) == brute(docs, items, 2)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rnd = random.Random(12)
    docs = corpus(rnd, 150)
    items = [(k, rnd.choice(docs)[1]) for k in range(30)] * 2          # repeated items rank on their own
    whole = searched(spark, docs, items)
    monkeypatch.setattr(X, "BLOCK_ITEMS", 7)
    assert searched(spark, docs, items) == whole == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 5)], "doc_id long, text string, item_id string, rank int")
    items = spark.createDataFrame([(4, "two", 9, 8, 7)], "item_id long, text string, block long, doc_id int, score int")
    more = docs.unionByName(docs.selectExpr("2 as doc_id", "'three' as text", "item_id", "rank"))
    assert [tuple(r)[:3] for r in X.lexical_search(more, items).collect()] == [(4, 1, 1)]
    for a, b in ((docs.limit(0), items), (docs, items.limit(0))):
        got = X.lexical_search(a, b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def vectors(rnd, n, width):
    rows = [sorted(rnd.sample(range(width), rnd.randrange(1, 6))) for _ in range(n)]
    values = [[rnd.choice([0, 1, 10 ** 9, rnd.randrange(10 ** 6)]) for _ in r] for r in rows]
    return rows, values


@pytest.mark.parametrize("n", [1, 5, 300])
def test_bounds_hold_and_prune(n):
    rnd = random.Random(n)
    rows, values = vectors(rnd, n, 40)
    tree = X.BallTree(np.array(sum(rows, [])), np.array(sum(values, []), np.int64),
                      np.concatenate([[0], np.cumsum([len(r) for r in rows])]), leaf=4)
    for _ in range(30):
        query = np.array(sorted(rnd.sample(range(40), rnd.randrange(1, 8))))
        wanted = np.zeros(40, bool)
        wanted[query] = True
        exact = [sum(v for t, v in zip(r, x, strict=True) if wanted[t]) for r, x in zip(rows, values, strict=True)]
        for node, (lo, hi, child) in enumerate(tree.nodes):
            below = [exact[k] for k in tree.order[lo:hi]]
            assert max(below) <= tree.bound(node, query)
            if not child:
                assert list(tree.scores(node, wanted)) == below
        best = []
        tree.search(query, wanted, np.arange(n), best, 3)
        assert sorted(best, reverse=True) == sorted(((s, -k) for k, s in enumerate(exact) if s > 0), reverse=True)[:3]


def test_far_subtrees_are_not_read():
    rows = [[k % 2] for k in range(4_000)]
    values = [[1_000_000 if k % 2 == 0 else 10] for k in range(4_000)]
    tree = X.BallTree(np.array(sum(rows, [])), np.array(sum(values, []), np.int64), np.arange(4_001), leaf=50)
    best = []
    read = tree.search(np.array([0]), np.array([True, False]), np.arange(4_000), best, 5)
    leaves = sum(not child for *_, child in tree.nodes)
    assert len(best) == 5 and read < 0.7 * leaves


def test_terms_are_those_of_the_pattern():
    rnd = random.Random(1)
    for _ in range(2_000):
        text = "".join(rnd.choice("aZ09 _-.\x00\x7f\x80éİıß😀\t") for _ in range(rnd.randrange(30)))
        assert [w.decode() for w in X.terms_of(text.encode())] == terms(text)
