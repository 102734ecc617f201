"""Operator 9: quality classifier by co-training two views.

The text view sees what the words look like: hashed words without case,
and shares of symbols, capitals, repeats, long words and table bars.  The page view sees metadata alone: source, language, length, number
and mean length of lines.  Both start from the labelled documents.  In each
round either view marks the unlabelled documents it is surest of, the other
one trains on these marks too.  At the end each view's margin is calibrated
on labelled documents it was not trained on, and the calibrated log odds are
added up, the class balance counted once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .linear import logistic, margins, platt, sigmoid

#: Rows the classifier is fitted on (on average): labelled per class, and the
#: pool of unlabelled ones that the views mark for each other.
LABELLED = 6_000
POOL = 4_000
PARTS = 1_000_003
ROUNDS = 3
PER_ROUND = 0.1                  # share of the unlabelled rows either view marks in a round
SURE = 0.9                       # least calibrated probability of a mark
TEXT_BITS, PAGE_BITS = 15, 12
FOLDS = 5
KEEP = 0.5

_SYMBOLS = list(b"#*$%&|<>@^~=+\\/{}[]")


def _bucket(name: str, bits: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def _level(share: float) -> int:
    """Shares on a scale that tells 0, 0.1 %, 1 %, ... apart."""
    return int(np.searchsorted((1e-9, 0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9), share))


def text_features(text: str | None) -> list[int]:
    text = text or ""
    words = text.split()
    distinct = set(words)
    n = max(1, len(words))
    chars = max(1, len(text))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    shapes = {
        "symbol": raw[_SYMBOLS].sum() / chars, "mark": raw[ord("!")] / chars, "stop": raw[ord(".")] / chars,
        "digit": raw[48:58].sum() / chars, "upper": raw[65:91].sum() / chars, "control": (raw[:32].sum() - raw[9:14].sum()) / chars,
        "distinct": len(distinct) / n, "bar": words.count("|") / n, "plain": sum(map(str.isalpha, words)) / n,
        "long": (sizes > 15).sum() / n, "short": (sizes < 3).sum() / n,
    }
    found = {_bucket(f"{k}={_level(v)}", TEXT_BITS) for k, v in shapes.items()}
    found.update({_bucket(w, TEXT_BITS) for w in set(map(str.lower, distinct))})
    return sorted(found)


def page_features(text: str | None, lang: str | None, source: str | None) -> list[int]:
    lines = (text or "").split("\n")
    size = len(text or "")
    names = [f"lang={lang}", f"source={source}", f"both={lang}/{source}", f"size={int(2 * np.log2(1 + size))}",
             f"lines={int(2 * np.log2(len(lines)))}", f"line={int(2 * np.log2(1 + size / len(lines)))}"]
    return sorted({_bucket(x, PAGE_BITS) for x in names})


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True)
        pairs = [(text_features(t), page_features(t, g, s)) for t, g, s in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
             pa.array([p[1] for p in pairs], pa.list_(pa.int32()))], names=["quality", "text_ones", "page_ones"])


@dataclass
class View:
    """A linear view and its calibration: log odds = a * margin + b."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def odds(self, ones: list[int]) -> float:
        return self.a * (float(self.weights[ones].sum()) + self.bias) + self.b


@dataclass
class Model:
    text: View
    page: View
    prior: float                  # log odds of good quality


class _Ones:
    """The features of some examples: one list of numbers for all, kept once.

    A fit runs over all examples and gives those that aren't chosen no weight.
    """

    def __init__(self, lists: pa.ChunkedArray, features: int):
        self.columns = pc.list_flatten(lists).to_numpy().astype(np.int32)
        sizes = pc.list_value_length(lists).to_numpy()
        self.rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.size, self.features = len(sizes), features

    def fit(self, chosen: np.ndarray, target: np.ndarray) -> View:
        good = max(1e-9, float(target.sum()))
        bad = max(1e-9, float(len(target) - target.sum()))
        importance, wanted = np.zeros(self.size), np.zeros(self.size)
        importance[chosen] = np.where(target > 0.5, len(target) / (2 * good), len(target) / (2 * bad))
        wanted[chosen] = target
        return View(*logistic(self.rows, self.columns, wanted, importance, self.features, l2=0.3, steps=120))

    def margins(self, chosen: np.ndarray, view: View) -> np.ndarray:
        return margins(self.rows, self.columns, self.size, view.weights, view.bias)[chosen]


def cotrain(label: np.ndarray, views: list[_Ones], prior: float) -> list[View]:
    """Two views trained by turns; ``label`` is 0 / 1, or -1 where unknown."""
    known, free = np.flatnonzero(label >= 0), np.flatnonzero(label < 0)
    hold = known[np.arange(len(known)) % FOLDS == 0]             # for the calibration
    learn = np.setdiff1d(known, hold)
    marks: list[dict[int, int]] = [{}, {}]                       # what each view was taught by the other
    trained: list[View] = []

    def train(k: int) -> View:
        taught = np.array(sorted(marks[k]), np.int64)
        target = np.concatenate([label[learn], [marks[k][i] for i in taught]]).astype(float)
        view = views[k].fit(np.concatenate([learn, taught]), target)
        view.a, view.b = platt(views[k].margins(hold, view), label[hold])
        return view

    for turn in range(ROUNDS + 1):
        trained = [train(0), train(1)]
        if turn == ROUNDS or not len(free):
            break
        most = int(np.ceil(PER_ROUND * len(free)))
        for k in (0, 1):
            p = sigmoid(trained[k].a * views[k].margins(free, trained[k]) + trained[k].b)
            for cls, sure in ((1, p), (0, 1 - p)):
                share = most * (prior if cls else 1 - prior)
                best = np.argsort(-sure, kind="stable")[:int(np.ceil(share))]
                marks[1 - k].update((int(free[i]), cls) for i in best if sure[i] >= SURE)
    return trained


def _sample(docs: DataFrame, marks: DataFrame, labelled: int, pool: int) -> tuple[DataFrame, dict[int, int]]:
    """Different rows of ``docs`` with their quality (-1: none), and the number
    of all rows by quality.

    About ``labelled`` rows of each class and ``pool`` rows without a label
    are drawn by a hash of the row, so that rows which share an id, or have
    none, are drawn one by one; exact repeats count once.
    """
    quality = F.coalesce("quality", F.lit(-1)).alias("quality")
    counts = {r["quality"]: r["n"] for r in docs.select("doc_id").join(marks, "doc_id", "left").select(quality)
              .groupBy("quality").agg(F.count("*").alias("n")).collect()}
    parts = {k: -(-PARTS * (pool if k < 0 else labelled) // n) for k, n in counts.items()}
    docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(PARTS)))
    limit = F.create_map(*[F.lit(x) for k in sorted(parts) for x in (k, parts[k])]) if parts else F.lit(None)
    drawn = docs.where(F.col("part") < max(parts.values(), default=0)).join(marks, "doc_id", "left") \
        .select(quality, "text", "lang", "source", "part")
    return (drawn.where(F.col("part") < limit[F.col("quality")]) if parts else drawn).drop("part").distinct(), counts


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model | None:
    """Learns from ``docs`` (doc_id, text, lang, source) and ``labels``
    (doc_id, quality 0/1; other values and nulls are no label).

    ``labelled`` bounds the rows of each class, ``pool`` the unlabelled rows
    that the views may mark (the method works on such a pool), both on
    average.  A document labelled twice takes the lower label.  Without both
    classes there is no model (None): nothing can be judged.
    """
    marks = (labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id")
             .agg(F.min(F.col("quality").cast("int")).alias("quality")))
    rows, counts = _sample(docs.select("doc_id", "text", "lang", "source"), marks, labelled, pool)
    if not counts.get(0) or not counts.get(1):
        return None
    # written, so that the driver only reads numbers, in small batches
    numbers = materialize(rows.mapInArrow(_features, "quality int, text_ones array<int>, page_ones array<int>")
                          .withColumn("key", F.xxhash64("text_ones", "page_ones")), "features").orderBy("key", "quality").toArrow()
    label = numbers.column("quality").to_numpy()
    good = counts[1] / (counts[0] + counts[1])
    views = [_Ones(numbers.column("text_ones"), 1 << TEXT_BITS), _Ones(numbers.column("page_ones"), 1 << PAGE_BITS)]
    del numbers
    text, page = cotrain(label, views, good)
    # the calibration saw the sampled balance of the classes; the score is to show the real one
    seen = label[label >= 0]
    shift = float(np.log(good / (1 - good)) - np.log(max(1, (seen == 1).sum()) / max(1, (seen == 0).sum())))
    text.b += shift
    page.b += shift
    return Model(text, page, float(np.log(good / (1 - good))))


def scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    """Text, page and combined score (3 x rows) of columns text, lang, source."""
    rows = zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True)
    odds = np.array([(model.text.odds(text_features(t)), model.page.odds(page_features(t, g, s))) for t, g, s in rows], float).reshape(-1, 2)
    a, b = odds.T
    return sigmoid(np.stack([a, b, a + b - model.prior]))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.nulls(batch.num_rows, pa.float64())] * 3 if model is None else [pa.array(x) for x in scores(model, batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], names=["doc_id", "text_score", "page_score", "score"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, page_score, score (probabilities of good quality).

    One row per row of ``docs`` (doc_id, text, lang, source), nulls and empty
    texts included; without a model the scores are null.
    """
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(
        _score(model), "doc_id long, text_score double, page_score double, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits both views and scores all of ``docs``; kept is score >= KEEP
    (true without a model)."""
    return score(docs, fit(docs, labels)).withColumn("kept", F.coalesce(F.col("score") >= KEEP, F.lit(True)))
