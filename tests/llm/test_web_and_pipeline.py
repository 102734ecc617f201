"""Revisits, licenses and the pipeline against brute force."""

import random
import time

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import captures as C
from ledgerlens.llm import licenses as L
from ledgerlens.llm import queries as Q
from ledgerlens.llm import revisits as R
from ledgerlens.llm.licenses import TEMPLATES
from ledgerlens.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.01"
RECORD = ("record_id long, warc_type string, profile string, target_uri string, warc_date timestamp, status int, "
          "headers map<string,string>, payload string")


@pytest.mark.parametrize(("url", "key"), [
    ("HTTP://user@WWW.Example.com:80/a//?b=2&a=1&utm_source=x#f", "example.com/a?a=1&b=2"),
    ("https://example.com", "example.com"), ("https://example.com/", "example.com"), ("https://example.com:8080/x?", "example.com:8080/x"),
    ("example.com/?sid=1", "example.com"), ("", ""), (None, None)])
def test_canonical_urls(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(R.canonical_url(F.col("u")).alias("k")).first()["k"] == key


def test_revisits_match_a_sequential_pass(spark):
    records = C.capture_records(spark.read.parquet(f"{SF}/pages.parquet"))
    rows = records.withColumn("key", R.canonical_url(F.col("target_uri"))).withColumn("t", F.col("warc_date").cast("long")).collect()
    got = {r["record_id"]: r for r in R.resolve_revisits(records).collect()}
    full = [r for r in rows if r["warc_type"] == "response"]
    outcomes = set()
    for r in (x for x in rows if x["warc_type"] == "revisit"):
        earlier = [x for x in full if x["key"] == r["key"] and x["t"] < r["t"]]
        last = max(earlier, key=lambda x: (x["t"], x["record_id"]), default=None)
        mine = got.pop(r["record_id"])
        outcomes.add(mine["outcome"])
        assert mine["response_id"] == (last and last["record_id"])
        if last is None:
            assert mine["outcome"] == "no_response" and mine["payload"] is None
            continue
        tags = [x["headers"].get("etag") for x in (r, last)]
        days = [x["headers"].get("last-modified") for x in (r, last)]
        agrees = (tags[0].removeprefix("W/") == tags[1].removeprefix("W/") if None not in tags
                  else days[0] == days[1] if None not in days else None)
        assert mine["outcome"] == {True: "resolved", False: "changed", None: "unverified"}[agrees]
        if agrees:
            fresh = {k: v for k, v in r["headers"].items() if k not in R.KEPT_FIELDS}
            assert mine["headers"] == {**last["headers"], **fresh} and mine["payload"] == last["payload"]
            assert mine["headers"]["content-length"] == last["headers"]["content-length"]
    assert not got and outcomes == {"resolved", "changed", "unverified", "no_response"}


def test_revisit_awkward_rows(spark):
    at = lambda s: time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(1_700_000_000 + s))
    p = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    rows = [(1, "response", None, "http://a.b/", at(0), 200, {"etag": '"x"', "connection": "close", "x": "1"}, "body"),
            (2, "response", None, "http://a.b/", at(0), 200, {"etag": '"y"'}, "later id of the same second"),
            (3, "response", None, "http://a.b/", at(5), 404, {"etag": '"z"'}, "not full"),
            (4, "revisit", p, "https://www.a.b", at(0), 304, {"etag": '"y"'}, None),
            (5, "revisit", p, "https://www.a.b", at(9 * 86_400), 304, {"etag": 'W/"y"', "connection": "x-hop", "x-hop": "1", "age": "3"}, None),
            (6, "revisit", p, None, at(9), 304, None, None), (7, "revisit", p, "http://a.b", None, 304, None, None),
            (8, "revisit", "identical-payload-digest", "http://a.b", at(9), 200, None, None), (9, "revisit", p, "http://a.b", at(9), 304, None, None)]
    df = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in rows], RECORD)
    dates = spark.createDataFrame([(r[0], r[4]) for r in rows], "record_id long, d string")
    df = df.drop("warc_date").join(dates, "record_id").withColumn("warc_date", F.to_timestamp("d")).withColumn("url", F.lit("clash"))
    got = {r["record_id"]: r for r in R.resolve_revisits(df).collect()}
    assert {k: (v["response_id"], v["outcome"]) for k, v in got.items()} == {
        4: (None, "no_response"), 5: (2, "resolved"), 6: (None, "no_response"), 7: (None, "no_response"), 9: (2, "unverified")}
    assert got[5]["headers"] == {"etag": 'W/"y"', "age": "3"}
    assert R.resolve_revisits(df.where("false")).count() == 0


def test_revisits_within_a_second(spark):
    p = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    rows = [(9, "response", None, "2023-11-14 22:13:20.25", 200, "a"), (2, "response", None, "2023-11-14 22:13:20.5", 200, "b"),
            (3, "revisit", p, "2023-11-14 22:13:20.25", 304, None), (4, "revisit", p, "2023-11-14 22:13:20.3", 304, None),
            (5, "revisit", p, "2023-11-14 22:13:20.75", 304, None), (6, "revisit", p, "2023-11-20 00:00:00", 304, None)]
    df = spark.createDataFrame(rows, "record_id long, warc_type string, profile string, d string, status int, payload string")
    df = df.withColumns({"warc_date": F.to_timestamp("d"), "target_uri": F.lit("http://a.b/"), "headers": F.create_map(F.lit("etag"), F.lit("x"))})
    got = {r["record_id"]: (r["response_id"], r["payload"]) for r in R.resolve_revisits(df).collect()}
    assert got == {3: (None, None), 4: (9, "a"), 5: (2, "b"), 6: (2, "b")}


def test_repeated_responses_resolve_a_revisit_once(spark):
    from ledgerlens.llm.revisits import resolve_revisits
    schema = ("record_id long, warc_type string, profile string, target_uri string, warc_date timestamp, status int, "
              "headers map<string,string>, payload string, row int, found string")
    from datetime import datetime
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    profile = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    response = (1, "response", "", "http://a.b/", at(1), 200, {"etag": '"x"'}, "body " * 100_000, 0, "f")
    revisit = (2, "revisit", profile, "http://A.b", at(5), 304, {"etag": '"x"', "age": "1"}, None, 0, "f")
    alone = (3, "revisit", profile, None, None, 304, None, None, 0, "f")
    got = resolve_revisits(spark.createDataFrame([response, response, revisit, revisit, alone], schema)).collect()
    assert sorted((r["record_id"], r["response_id"], r["outcome"], len(r["payload"] or "")) for r in got if r["record_id"] == 2) == \
        [(2, 1, "resolved", 500_000)] * 2
    assert [(r["response_id"], r["outcome"], r["headers"]) for r in got if r["record_id"] == 3] == [(None, "no_response", None)]


def test_license_scan_matches_containment(spark):
    rnd = random.Random(9)
    filler = lambda n: " ".join(f"x{rnd.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(120):
        _, _, t = rnd.choice(TEMPLATES)
        words = t.split()
        if rnd.random() < 0.5 and len(words) > 20:            # a word or two changed
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = "changed"
        rows.append((i, f"{filler(rnd.randint(0, 400))}\n{' '.join(words)}\n{filler(rnd.randint(0, 400))}"))
    index = L.build()
    sets = [set(s.tolist()) for s in index.sets]
    got = {(r["doc_id"], r["license"], r["template"]): r for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, *index.names[k]) for i, t in rows for k, s in enumerate(sets)
            if len(s & set(L._shingles(t).tolist())) >= L.CONTAINMENT * len(s)}
    assert set(got) == want and len(want) > 60
    texts = dict(rows)
    for (i, license_id, _), r in got.items():
        if r["containment"] == 1.0:
            span = texts[i][r["start"]:r["end"]]
            assert any(set(L._shingles(span).tolist()) == set(index.sets[k].tolist()) for k, n in enumerate(index.names) if n[0] == license_id)


def test_band_index_retrieves_what_direct_comparison_does():
    rng = np.random.default_rng(4)
    for members, bands in ((1, 1), (3, 9), (700, 27)):
        lows = rng.integers(0, 2**32, (members, bands), dtype=np.uint32)
        lows[members // 2] = lows[0]                                # equal values: both are retrieved
        low = rng.integers(0, 2**32, (500, bands), dtype=np.uint32)
        for w in range(0, 500, 7):
            low[w, rng.integers(bands)] = 0 if w % 2 else lows[rng.integers(members), 0]
            k = rng.integers(bands)
            low[w, k] = lows[rng.integers(members), k]
        got = L.band_index(lows, list(range(members)), bands).retrieve(low)
        want = {w: [t for t in range(members) if (low[w] == lows[t]).any()] for w in range(500)}
        assert {w: sorted(t) for w, t in got.items()} == {w: t for w, t in want.items() if t}


def test_license_in_typographic_dress(spark):
    """Curly quotes, dashes, no-break spaces and guillemets separate words like their plain forms."""
    _, _, terms = next(t for t in TEMPLATES if t[:2] == ("MIT", "terms"))
    dressed = terms.replace('"Software"', "\u201cSoftware\u201d").replace(", free of charge,", "\u2014free of charge\u2014").replace(" to use", "\u00a0to\u2009use")
    rows = [(1, "\u00e9t\u00e9 " + dressed + " \u00ab fin \u00bb"), (2, "\u00ab\u2026\u00bb \u201cReleased under the MIT License\u201d\u2026"), (3, "\u00c2\u00a0 \u201c \u2030 \u20ac")]
    out = sorted((r["doc_id"], r["template"], r["containment"], r["start"], r["end"]) for r in L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(1, "terms", 1.0, 4, 4 + len(dressed) - 1), (2, "released", 1.0, 5, 35)]


def test_license_templates_of_any_number(spark):
    """Hundreds of templates beside the known ones don't change what is found."""
    rnd = random.Random(13)
    more = tuple((f"L{k}", "own", " ".join(f"t{rnd.randrange(5000)}" for _ in range(rnd.choice([6, 30, 90])))) for k in range(600))
    rows = [(k, f"{more[k][2]} and {TEMPLATES[k % len(TEMPLATES)][2]}") for k in range(0, 600, 9)]
    out = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), TEMPLATES + more).collect()
    for k, _ in rows:
        mine = {(r["license"], r["template"]) for r in out if r["doc_id"] == k and r["containment"] == 1.0}
        assert {(f"L{k}", "own"), TEMPLATES[k % len(TEMPLATES)][:2]} <= mine
    assert {r["license"] for r in out if r["license"].startswith("L") and r["license"][1:].isdigit()} == {f"L{k}" for k, _ in rows}


def test_license_awkward_rows(spark):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "MIT"), (None, notice), (5, "é " * 40_000 + notice + " é" * 40_000 + " " + notice), (6, notice), (6, notice)]
    out = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["occurrences"]) for r in out) == [
        (0, "MIT", 1), (5, "MIT", 2), (6, "MIT", 1), (6, "MIT", 1)]
    five = next(r for r in out if r["doc_id"] == 5)
    assert rows[4][1][five["start"]:five["end"]] == notice[:-1]
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.join(docs, columns, "left_semi").count() == out.count()
            sizes.append(out.count())
        docs = out
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > sizes[4] > 0
    assert docs.select("doc_id").distinct().count() == sizes[4]
    kept = spark.read.parquet(str(tmp_path / "quality"))
    near = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "near_dedup")).select("doc_id").collect()}
    groups = near_duplicates(kept).collect()
    assert near == {r["doc_id"] for r in groups if r["doc_id"] == r["component_id"]}


def test_pipeline_awkward_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, "12 34", "en", "src1", 5), (4, "the and of " * 40, "en", "src1", 440),
            (4, "the and of " * 40, "en", "src1", 440), (None, "le la des " * 40, "fr", None, 400), (7, "der die das " * 40, "de", "x", 480)]
    for name, part in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(part, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r["doc_id"] for r in out} <= {4, 7, None} and bool(out) == bool(part)


def test_near_copies_go_by_row(spark):
    rnd = random.Random(12)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(120))
    copied, alone, twice, other, near = (text() for _ in range(5))
    rows = [(1, copied, "a"), (None, copied, "b"), (None, alone, "c"), (None, twice, "d"), (None, twice, "d"), (7, other, "e"), (7, other, "e"),
            (7, near, "f"), (None, near + " end", "g"), (None, None, "i"), (9, copied, "j"), (9, text(), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert "".join(sorted(r["source"] for r in out.collect())) == "acdeefik"


def test_every_query_is_registered():
    for n in range(1, 11):
        assert any(q.startswith(f"op{n}_") for q in Q.QUERIES)
    assert set(Q.ORACLES) <= set(Q.QUERIES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "mixing", "packing"]
