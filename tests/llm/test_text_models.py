"""Language, quality and toxicity: held-out accuracy and awkward rows."""

import math
import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import language_id as L
from ledgerlens.llm import quality as Q
from ledgerlens.llm import toxicity as T
from ledgerlens.llm.linear import logistic, margins, platt, sigmoid

SF = "/root/testdata/sf0.01"
AWKWARD = [(1, None, None, None), (2, "", "en", "s"), (3, "123 ... !!", "en", "s"), (None, "the and of", None, "s"),
           (5, "the and of " * 30_000, "xx", None), (5, "the and of " * 30_000, "xx", None)]


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")


def test_language_held_out_accuracy(spark):
    rows = L.language_id(docs(spark)).join(docs(spark).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_awkward_rows(spark):
    train = spark.createDataFrame([(4, "der die und das haus", "de"), (6, "the and of house", "en")], "doc_id long, text string, lang string")
    got = L.identify(awkward(spark), L.fit(train)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got[:3]] == [("und", 0.0)] * 3
    assert [r["lang_pred"] for r in got[3:]] == ["en"] * 3
    none = L.identify(awkward(spark), L.fit(train.where("false"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert L.language_id(train.where("false")).count() == 0


def test_unseen_words_fall_back_to_their_letters(spark):
    train = spark.createDataFrame([(4, "schule schuld scham " * 3, "de"), (6, "thing those theme " * 3, "en")], "doc_id long, text string, lang string")
    model = L.fit(train)
    classify = L.classifier(model)
    import pyarrow as pa
    assert classify(pa.array(["schwarz", "thirst"]))[0] == ["de", "en"]


def test_pipeline_rejects_unlearnt_languages_and_gibberish(spark):
    rnd = random.Random(4)
    some = lambda letters, n: " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(n))
    odd = [(-k, some(letters, n), None, "odd") for k, (letters, n) in enumerate(
        ((x, n) for x in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрст", "日本語文字列漢") for n in (5, 50, 500, 20_000)), 1)]
    every = docs(spark).select("doc_id", "text", F.when(F.col("lang") != "es", F.col("lang")).alias("lang"),
                               F.when(F.col("lang") == "es", "es").otherwise("clean").alias("source"))
    every = every.where("text rlike '[a-z]{3}'").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    before = {r["source"]: r["count"] for r in every.groupBy("source").count().collect()}
    after = {r["source"]: r["count"] for r in corpus_pipeline.identify_language(spark, every, SF).groupBy("source").count().collect()}
    assert "odd" not in after and after.get("es", 0) <= 0.03 * before["es"] and after["clean"] >= 0.995 * before["clean"]


def test_quality_separates_the_labels(spark):
    rows = Q.quality(docs(spark), labels(spark)).join(labels(spark), "doc_id").collect()
    good, bad = ([r for r in rows if r["quality"] == k] for k in (1, 0))
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


def test_long_words_are_evidence():
    assert set(Q.text_features("short words")) < set(Q.text_features("short words extraordinary"))


def test_quality_sample_is_full_size_and_drawn_by_row(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = ids.select("doc_id", F.concat(F.lit("text "), "doc_id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    marks = ids.where("doc_id % 5 < 3").select("doc_id", (F.col("doc_id") % 5 % 2).cast("int").alias("quality"))
    found, counts = Q._sample(rows, marks, 2_000, 4_000)
    sizes = {r["quality"]: r["count"] for r in found.groupBy("quality").count().collect()}
    assert counts == {0: 8_000, 1: 4_000, -1: 8_000}
    assert all(abs(sizes[k] - n) < 300 for k, n in ((0, 2_000), (1, 2_000), (-1, 4_000)))
    shared = rows.withColumn("doc_id", F.lit(2).cast("long")).unionAll(rows.withColumn("doc_id", F.lit(None).cast("long")))
    found, _ = Q._sample(shared.unionAll(shared), marks, 2_000, 4_000)                # one hot id, no ids, everything twice
    sizes = {r["quality"]: r["count"] for r in found.groupBy("quality").count().collect()}
    assert all(abs(sizes[k] - n / 2) < 300 for k, n in ((0, 2_000), (-1, 4_000)))


def brute_language(text, samples):
    """Scores of a text from all counts of the sample, by the definition."""
    words, grams = {}, {}
    for lang, sample in samples:
        for w in L.words_of(sample):
            words[lang, w] = words.get((lang, w), 0) + 1
            framed = f"^{w}$"
            for size in range(1, 5):
                for i in range(max(1, len(framed) - size + 1)):
                    grams[lang, framed[i:i + size]] = grams.get((lang, framed[i:i + size]), 0) + 1
    langs = sorted({x for x, _ in samples})

    def logs(counts, name, lang):
        total = sum(n for (x, _), n in counts.items() if x == lang) + 0.5 * len({w for _, w in counts})
        return math.log((counts.get((lang, name), 0) + 0.5) / total)

    scores = dict.fromkeys(langs, 0.0)
    for w in L.words_of(text):
        if any((x, w) in words for x in langs):
            for x in langs:
                scores[x] += logs(words, w, x)
            continue
        framed, found = f"^{w}$", []
        for i in range(len(framed)):
            found += next(([framed[i:i + k]] for k in range(min(4, len(framed) - i), 0, -1)
                           if any((x, framed[i:i + k]) in grams for x in langs)), [])
        for x in langs:
            scores[x] += sum(logs(grams, g, x) for g in found) / max(1, len(found))
    top = max(scores.values())
    best = next(x for x in langs if scores[x] == top)
    return best, 1 / sum(math.exp(max(-700, v - top)) for v in scores.values())


def test_language_scores_equal_the_definition(spark):
    rnd = random.Random(8)
    pools = {"aa": "abcd", "bb": "cdef", "cc": "efgé"}
    make = lambda letters, n: " ".join("".join(rnd.choices(letters, k=rnd.randint(1, 4))) for _ in range(n))
    samples = [(x, make(p, 25)) for x, p in pools.items() for _ in range(4)]
    train = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(samples)], "doc_id long, text string, lang string")
    asked = [make(p, n) for p in (*pools.values(), "abcdefgé", "xyz") for n in (1, 3, 12)]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    model = L.fit(train, words=None, grams=None)
    for r in L.identify(rows, model).collect():
        lang, score = brute_language(asked[r["doc_id"]], samples)
        assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-4)


def test_numerals_are_no_letters(spark):
    train = spark.createDataFrame([(4, "der die und", "de"), (6, "the and of", "en")], "doc_id long, text string, lang string")
    rows = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ"), (3, "٣ 12"), (4, "the²and½")], "doc_id long, text string")
    assert [r["lang_pred"] for r in L.identify(rows, L.fit(train)).collect()] == ["und", "und", "und", "en"]


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """The functions of the tasks can be unpickled where the package is missing."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from ledgerlens.llm import fim, lexical, personal
    view = Q.View(np.zeros(1 << Q.TEXT_BITS), 0.0)
    quality = Q._score(Q.Model(view, Q.View(np.zeros(1 << Q.PAGE_BITS), 0.0), 0.0))
    none = L.Table([], 0)
    functions = [Q._features, quality, L._count, L._predict(L.Model([], none, none)), L.accepts(L.Model([], none, none), 0.5, 0.5),
                 fim._transform(1, 90, 20), lexical._count({b"a": 0}), lexical._find([(1, np.array([0]))], np.array([1]), 1, 1, 10),
                 personal._find(personal.Model({}, [[0.0] * 4] * 4)), personal._samples, T._vote if hasattr(T, "_vote") else Q._features]
    (tmp_path / "tasks").write_bytes(cloudpickle.dumps(functions))
    code = ("import pickle, sys, pyarrow as pa\n"
            "f = pickle.load(open(sys.argv[1], 'rb'))\n"
            "b = pa.RecordBatch.from_pydict({'doc_id': [1], 'text': ['some text'], 'lang': ['en'], 'source': ['s'], 'quality': [1]})\n"
            "print([len(list(f[k](iter([b])))) for k in (0, 1, 2, 3, 5, 6, 8, 9)])\n"
            "assert 'ledgerlens' not in sys.modules\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "tasks")], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip().endswith(str([1] * 8))


def test_quality_without_labels_judges_nothing(spark):
    out = Q.quality(awkward(spark), labels(spark).where("false")).collect()
    assert len(out) == len(AWKWARD) and all(r["score"] is None and r["kept"] for r in out)


def test_quality_awkward_rows(spark):
    model = Q.fit(docs(spark), labels(spark))
    out = Q.score(awkward(spark), model).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    assert out[4]["score"] == out[5]["score"]
    assert Q.score(awkward(spark).where("false"), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))   # sf0.01 has 34 toxic rows to learn from
    rows = T.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum(clean) <= 0.02 * len(clean) and sum(toxic) >= 0.6 * len(toxic)


def test_toxicity_awkward_rows(spark):
    model = T.fit(docs(spark), labels(spark))
    out = T.score(awkward(spark), model).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    blank = T.toxicity(awkward(spark), labels(spark).where("false")).collect()
    assert len({r["score"] for r in blank}) == 1


def test_label_model_finds_accurate_and_dependent_voters():
    rng = np.random.default_rng(2)
    toxic = rng.random(20_000) < 0.2
    fire = [np.where(toxic, rng.random(20_000) < a, rng.random(20_000) < 0.02) for a in (0.9, 0.7, 0.5)]
    fire.append(fire[0].copy())                                   # repeats the first
    votes = sum(f.astype(np.int64) << i for i, f in enumerate(fire))
    patterns, where, counts = np.unique(votes, return_inverse=True, return_counts=True)
    some = np.arange(20_000) < 500
    model = T.label_model(patterns, counts, np.bincount(where[some & toxic], minlength=len(patterns)),
                          np.bincount(where[some & ~toxic], minlength=len(patterns)), 4)
    assert abs(model.prior - 0.2) < 0.05 and abs(model.rates[1][1] - 0.7) < 0.1
    assert model.correlations[0, 3] > 0.5 and model.discount[0] < model.discount[1]
    assert ((model.posterior(patterns)[where] > 0.5) == toxic).mean() > 0.93


def test_logistic_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 5)) < 0.4
    y = (x[:, 0] | x[:, 1]).astype(float)
    rows, columns = np.nonzero(x)
    w, b = logistic(rows, columns, y, np.ones(2000), 5)
    m = margins(rows, columns, 2000, w, b)
    assert ((m > 0) == (y > 0.5)).mean() > 0.97 and abs(w[4]) < 0.5
    a, c = platt(m, y)
    assert a > 0 and abs(sigmoid(a * m + c).mean() - y.mean()) < 0.02
    assert platt(m, np.ones(2000))[0] == 0.0 and math.isfinite(platt(np.zeros(0), np.zeros(0))[1])
