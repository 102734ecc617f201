"""Near-duplicate groups against brute force, and the awkward rows."""

import random
import re
import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import near_dedup as N
from ledgerlens.llm.textops import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    k = min(5, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(rows):
    """doc_id -> (set size, smallest reachable id) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def corpus(seed=3):
    """Chains of edited copies (so groups hold pairs under the threshold),
    exact copies, short texts, shared passages."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    texts = []
    for _ in range(12):
        text = [word() for _ in range(rnd.randint(60, 140))]
        texts.append(" ".join(text))
        for _ in range(rnd.randint(0, 14)):
            text = list(text)
            for _ in range(rnd.randint(1, 3)):
                text[rnd.randrange(len(text))] = word()
            texts.append(" ".join(text))
    passage = " ".join(word() for _ in range(40))
    texts += [passage + " " + " ".join(word() for _ in range(rnd.randint(5, 80))) for _ in range(25)]
    texts += [texts[0]] * 7 + [texts[5].upper(), texts[5].replace(" ", "\n\t")]
    texts += ["one two three", "one two three", "One  two three", "", "   ", None, "solo", "é ü ß", "É ü ß"]
    rnd.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_groups_match_brute_force(spark):
    rows = corpus()
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_index_finds_every_pair_under_the_distance():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**16, N.SYMBOLS).astype(np.uint16)
    keys = set(N.chunk_keys(base[None])[0].tolist())
    for _ in range(300):
        other = base.copy()
        at = rng.permutation(N.SYMBOLS)[:2 * N.CHUNKS - 1]
        other[at] += 1
        assert keys & set(N.chunk_keys(other[None])[0].tolist())


def test_awkward_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7, text, "x"), (7, text, "x"), (None, text, "y"), (9, None, None), (3, text + " end", "z"), (None, None, None)]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert len(out) == 6 and out[0].__fields__ == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in out) == sorted(
        [(7, 3, False), (7, 3, False), (-1, 3, False), (9, 9, True), (3, 3, True), (-1, -1, True)])


def test_different_texts_under_one_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, one), (5, two), (3, one + " end"), (2, two + " end"), (8, two), (5, "solo text")]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == [
        (2, 57, 2, True), (3, 57, 3, True), (5, 1, 5, True), (5, 56, 2, False), (5, 56, 3, False), (8, 56, 2, False)]


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    out = N.near_duplicates(spark.createDataFrame([(1, text), (2, text + " end"), (3, text[:900_000])], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == sorted(
        [(1, 199_996, 1), (2, 199_997, 1), (3, len(text[:900_000].split()) - 4, brute([(1, text), (3, text[:900_000])])[3][1])])


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 5])
def test_signature_of_few_shingles(n):
    assert N.signature(np.arange(1, n + 1, dtype=np.uint64)).shape == (N.SYMBOLS,)


def test_workers_get_bounded_batches(spark, monkeypatch):
    """A partition of long texts comes in parts, in every step that reads texts or sets."""
    limit, key = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

    def bounded(step):
        def check(batches):
            for batch in batches:
                assert batch.nbytes <= limit, batch.nbytes
                yield from step(iter([batch]))
        return check

    for name in ("_sign", "_sets", "_confirm"):
        monkeypatch.setattr(N, name, bounded(getattr(N, name)))
    rows = [(i, " ".join(f"{i // 2}w{j}" for j in range(12_000)) + " end" * (i % 2)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    own = spark.conf.get(key)
    got = N.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 2 * 2 for i, _ in rows}
    assert spark.conf.get(key) == own


def test_session_limit_returns_after_an_error(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(N, "_near_duplicates", lambda docs: 1 // 0)
    spark.conf.set(key, "5m")
    try:
        with pytest.raises(ZeroDivisionError):
            N.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
        assert spark.conf.get(key) == "5m"
    finally:
        spark.conf.unset(key)


def test_blocks_are_bounded_by_their_shingles(spark, monkeypatch):
    """Texts that share a passage, and so buckets, but no link: all are compared, in small blocks."""
    compare = N._compare_blocks

    def checked(table):
        assert sum(len(v) // 8 for v in table.column("shingles").to_pylist()) <= 6400
        return compare(table)

    monkeypatch.setattr(N, "BLOCK_SHINGLES", 800, raising=False)
    monkeypatch.setattr(N, "_compare_blocks", checked)
    passage = " ".join(f"p{j}" for j in range(60))
    rows = [(i, passage + "".join(f" {i}w{j}" for j in range(30))) for i in range(200)]
    rows += [(i + 200, t + " end") for i, t in rows[::20]]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_compared_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch, tmp_path):
    """Large groups whose members share buckets but few links: a passage in texts of their
    own, and copies that each link with their base alone."""
    compare, folder = N._compare_blocks, str(tmp_path)

    def counted(table):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(table.num_rows))
        return compare(table)

    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "_compare_blocks", counted)
    passage, base = " ".join(f"p{j}" for j in range(60)), [f"b{j}" for j in range(100)]
    texts = [passage + "".join(f" {i}w{j}" for j in range(30)) for i in range(250)]
    texts += [" ".join(base[:4 + i % 91] + [f"new{i}"] + base[5 + i % 91:]) for i in range(250)]
    rows = [(i, t) for i, t in enumerate([*texts, " ".join(base)])]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 2 * len(rows)


def test_prefixes_keep_every_link_between_groups(spark):
    """Linked sets of two groups meet in a bucket whose bounds allow the link."""
    rnd = random.Random(4)
    sets = []
    for _ in range(20):
        base = [rnd.getrandbits(62) for _ in range(rnd.choice([1, 3, 7, 20, 60, 101]))]
        sets += [set(rnd.sample(base, rnd.randint(-(-8 * len(base) // 10), len(base)))) | {rnd.getrandbits(62) for _ in range(rnd.randint(0, 1 + len(base) // 20))}
                 for _ in range(12)]
    frame = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)], "rep long, shingles binary")
    comp = {i: i - i % 3 for i in range(len(sets))}
    rows = N._prefixes(frame, spark.createDataFrame(list(comp.items()), "rep long, comp long")).cache()
    open_rows = {(r["key"], r["rep"]) for r in N._open(rows).collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r["rep"], {})[r["key"]] = r
    links = [(a, b) for a in comp for b in range(a) if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) > 100
    for a, b in links:
        met = [k for k in by[a].keys() & by[b].keys() if 17 * (by[a][k]["slack"] + by[b][k]["slack"]) <= 3 * min(by[a][k]["rest"], by[b][k]["rest"])]
        assert any((k, a) in open_rows and (k, b) in open_rows for k in met), (a, b)


def test_scratch_of_shingle_sets_is_small():
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(300)) for i in range(2000)])
    tracemalloc.start()
    for _ in shingle_sets(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20, peak
