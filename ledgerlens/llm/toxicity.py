"""Operator 10: toxicity by weak supervision.

1. Terms: a text's letter words, and the 4-letter beginnings of its longer
   words.  Over a sample of labelled documents Spark counts in how
   many toxic and clean documents each term occurs.
2. Voters: the terms that point to toxicity are dealt to ``LEXICONS``
   lexicons, by strength; beside them stand a fixed word list and patterns
   (an insult next to a pronoun, shouted or repeated insults).  Each votes on
   every training document, labelled or not.
3. Label model: two latent classes, every voter with its own firing rate in
   each (EM on the table of vote patterns, which has at most 2^voters rows).
   Correlations of the voters within the classes are estimated from the same
   table; a voter's evidence is divided by one plus the sum of its
   correlations, so that voters which repeat each other count once.
4. A linear classifier over term presence is trained on the posterior labels
   and scores all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .language_id import held_out, sampled, words_of
from .linear import logistic, margins, sigmoid

#: Labelled documents read for the terms, per class, and documents the linear
#: classifier is trained on, per posterior class (both on average).
LABELLED = 10_000
TRAINED = 6_000
LEXICONS = 8
LEXICON_TERMS = 400
FEATURES = 6_000
THRESHOLD = 0.7

# fixed values: common English insults
INSULTS = ("idiot", "moron", "loser", "scum", "clown", "trash", "stupid", "pathetic", "worthless", "disgusting")
_ADDRESS = {"you", "your", "youre", "this", "these", "such", "du", "tu", "vous", "usted", "ihr", "eres", "bist", "es"}
_SHOUT = re.compile(r"[A-Z]{4,}")


def terms_of(text: str | None) -> set[str]:
    """Distinct words, and beginnings (marked ``*``) of words of six letters or more."""
    parts = set(text.lower().split()) if text else set()
    words = {w for w in parts if w.isalpha()}
    if len(words) < len(parts):
        words.update(words_of(" ".join(parts - words)))
    words.update([w[:4] + "*" for w in words if len(w) > 5])
    return words


@dataclass
class Voters:
    lexicons: list[frozenset[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.known = frozenset().union(INSULTS, *self.lexicons)

    def __len__(self) -> int:
        return len(self.lexicons) + 4

    def votes(self, text: str) -> int:
        """Bit i is set if voter i fires."""
        hits = self.known & terms_of(text)
        if not hits:
            return 0
        bits = sum(1 << i for i, lexicon in enumerate(self.lexicons) if not lexicon.isdisjoint(hits))
        at, words = len(self.lexicons), words_of(text)
        listed = [w in hits for w in words]
        if not hits.isdisjoint(INSULTS):
            bits |= 1 << at
        if any(x and words[i - 1] in _ADDRESS for i, x in enumerate(listed) if i):
            bits |= 1 << at + 1
        if any(w.lower() in hits for w in _SHOUT.findall(text)):
            bits |= 1 << at + 2
        if sum(listed) > 1:
            bits |= 1 << at + 3
        return bits


@dataclass
class LabelModel:
    """Firing rates of the voters per class, their discounts and the prior."""

    rates: np.ndarray            # 2 x voters
    discount: np.ndarray
    prior: float
    correlations: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        fires = _bits(patterns, self.rates.shape[1])
        clean, toxic = self.rates
        evidence = fires * np.log(toxic / clean) + (1 - fires) * np.log((1 - toxic) / (1 - clean))
        return sigmoid(evidence @ self.discount + np.log(self.prior / (1 - self.prior)))


def _bits(patterns: np.ndarray, voters: int) -> np.ndarray:
    return ((np.asarray(patterns, np.int64)[:, None] >> np.arange(voters)) & 1).astype(float)


def label_model(patterns: np.ndarray, counts: np.ndarray, toxic: np.ndarray, clean: np.ndarray,
                voters: int, steps: int = 50) -> LabelModel:
    """EM over vote patterns; labelled counts per pattern give the start.

    ``counts`` has all training documents of a pattern, ``toxic`` and
    ``clean`` the labelled ones among them.  A pattern keeps the class
    balance of its labelled documents as a weight of its own evidence.
    """
    fires, total = _bits(patterns, voters), counts.astype(float)
    start = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)
    if not total.sum():
        return LabelModel(np.full((2, voters), 0.5), np.ones(voters), float(start), np.zeros((voters, voters)))
    post = (toxic + start) / (toxic + clean + 1)
    discount, correlations = np.ones(voters), np.zeros((voters, voters))
    model = None
    for _ in range(steps):
        weight = np.stack([total * (1 - post), total * post])
        rates = np.clip((weight @ fires + [[0.01], [0.5]]) / (weight.sum(axis=1, keepdims=True) + 1), 1e-5, 1 - 1e-5)
        rates[1] = np.maximum(rates[1], rates[0])                # a voter never speaks for the clean class
        prior = float(np.clip(weight[1].sum() / total.sum(), 1e-3, 0.5))
        both = np.zeros((voters, voters))
        for k in (0, 1):
            off = fires - rates[k]
            spread = np.sqrt(rates[k] * (1 - rates[k]))
            both += (off * weight[k][:, None]).T @ off / total.sum() / np.outer(spread, spread)
        correlations = np.clip(both, 0, 1)
        np.fill_diagonal(correlations, 0)
        discount = 1 / (1 + correlations.sum(axis=1))
        model = LabelModel(rates, discount, prior, correlations)
        new = model.posterior(patterns)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return model


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: documents that hold a term, by class (weights add up)."""
    for batch in batches:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for weight, text in zip(batch.column("weight").to_pylist(), batch.column("text"), strict=True):
            for term in terms_of(text.as_py()):
                found[0][term] += 1
                found[1][term] += weight
        names = list(found[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([float(found[0][t]) for t in names], pa.float64()),
             pa.array([float(found[1][t]) for t in names], pa.float64())], names=["term", "n", "toxic"])


def _terms(rows: DataFrame) -> DataFrame:
    """(term, n, toxic) over rows (text, weight): documents, and their summed weight."""
    return (rows.select("text", F.col("weight").cast("double").alias("weight"))
            .mapInArrow(_count_terms, "term string, n double, toxic double")
            .groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")))


def _strength(toxic_docs: float, clean_docs: float):
    """Smoothed log odds of a toxic against a clean document holding the term."""
    rate = (F.col("toxic") + 0.1) / (toxic_docs + 1)
    other = (F.greatest(F.col("n") - F.col("toxic"), F.lit(0.0)) + 0.1) / (clean_docs + 1)
    return F.log(rate / other)


def mine_voters(labelled: DataFrame) -> Voters:
    """Lexicons from rows (doc_id, text, toxic): the LEXICON_TERMS terms found
    in three toxic documents or more that point to toxicity most, dealt to the
    lexicons in turn."""
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    strength = _strength(float(sizes.get(1, 0)), float(sizes.get(0, 0)))
    top = (_terms(labelled.select("text", F.col("toxic").alias("weight"))).where("toxic >= 3")
           .withColumn("strength", strength).where("strength > 3")
           .orderBy(F.desc(F.col("strength") * F.log1p("toxic")), "term").limit(LEXICON_TERMS).collect())
    names = [r["term"] for r in top]
    return Voters([frozenset(names[i::LEXICONS]) for i in range(LEXICONS)])


def _vote(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [voters.votes(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(votes, pa.int64())], names=["doc_id", "votes"])
    return run


def _ones(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(vocabulary[t] for t in vocabulary.keys() & terms_of(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("post"), pa.array(found, pa.list_(pa.int32()))], names=["post", "ones"])
    return run


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    vocabulary: dict[str, float]     # term -> weight
    bias: float


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from documents that aren't held out, and their labels.

    ``docs`` (doc_id, text), ``labels`` (doc_id, toxic 0/1; other values and
    nulls are no label).  Without any label the score of all is the prior.
    """
    train = docs.where(~held_out()).select("doc_id", "text").where("text is not null")
    marks = (labels.where(~held_out()).where("toxic in (0, 1)").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    # sampled ids (about LABELLED per class, TRAINED per side) go to the texts, which stay where they are
    known = train.join(F.broadcast(sampled(marks, "toxic", LABELLED, 10)), "doc_id")
    voters = mine_voters(known)
    votes = train.mapInArrow(_vote(voters), "doc_id long, votes long")
    voted = materialize(votes.join(marks, "doc_id", "left"), "votes")
    seen = (voted.groupBy("votes").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"),
                                       F.count_if(F.col("toxic") == 0).alias("clean")).orderBy("votes").collect())
    columns = [np.array([r[c] for r in seen], np.int64) for c in ("votes", "n", "toxic", "clean")]
    model = label_model(*columns, voters=len(voters))
    post = model.posterior(columns[0]) if seen else np.zeros(0)
    if not seen or not columns[2].sum():
        return Model(voters, model, {}, float(np.log(model.prior / (1 - model.prior))))
    table = docs.sparkSession.createDataFrame([(int(v), float(p)) for v, p in zip(columns[0], post, strict=True)], "votes long, post double")
    chosen = sampled(voted.join(F.broadcast(table), "votes").withColumn("side", F.col("post") > 0.5), "side", TRAINED, 11)
    chosen = chosen.groupBy("doc_id").agg(F.max("post").alias("post"))
    rows = materialize(train.join(F.broadcast(chosen), "doc_id").select("text", "post"), "posterior")
    sums = rows.agg(F.count("*").alias("n"), F.sum("post").alias("toxic")).first()
    strength = _strength(sums["toxic"] or 0.0, sums["n"] - (sums["toxic"] or 0.0))
    kept = (_terms(rows.select("text", F.col("post").alias("weight"))).where("n >= 3").withColumn("strength", strength)
            .orderBy(F.desc(F.abs("strength") * F.log1p("n")), "term").limit(FEATURES).collect())
    vocabulary = {r["term"]: i for i, r in enumerate(kept)}
    sample = rows.mapInArrow(_ones(vocabulary), "post double, ones array<int>").toPandas()
    ones = [np.asarray(x, np.int64) for x in sample["ones"]]
    at = np.repeat(np.arange(len(ones)), [len(x) for x in ones])
    flat = np.concatenate(ones) if ones else np.zeros(0, np.int64)
    target = sample["post"].to_numpy()
    weights, bias = logistic(at, flat, target, np.ones(len(target)), len(vocabulary), l2=0.02, steps=400)
    return Model(voters, model, {t: float(weights[i]) for t, i in vocabulary.items() if abs(weights[i]) > 1e-4}, bias)


def _score(model: Model):
    weights, bias = model.vocabulary, model.bias
    known = frozenset(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = [bias + math.fsum(weights[t] for t in known & terms_of(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sigmoid(np.array(margin, float)), pa.float64())], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) per row of ``docs`` (doc_id, text), one to one.

    A null, empty or wordless text has no term and gets the classifier's
    bias as its margin.
    """
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on what isn't held out and scores all of ``docs``.

    Returns doc_id, held_out, score, predicted (1 from THRESHOLD on).
    """
    model = fit(docs, labels)
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
