"""Operator 7: language identification, word first, then character n-grams.

Each language has the log frequencies of its commonest words and character
n-grams, learnt from a sample of labelled documents.  A known word adds its
log frequency in each language.  An unseen word adds the mean over its
positions of the log frequency of the longest known n-gram that starts there
(four characters down to one, the word framed by ``^`` and ``$``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Sizes of the model (parameters of ``fit``): labelled documents sampled per
#: language (on average), commonest words and n-grams kept per language.
SAMPLE_DOCS = 4_000
KEPT_WORDS = 20_000
KEPT_GRAMS = 20_000
LONGEST = 4
#: Bounds of a task's cache: words, and cells (words times languages).
CACHE_WORDS = 300_000
CACHE_CELLS = 8_000_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (numerals such as fractions are none)."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


class Table:
    """Log frequencies of words or n-grams, stored for the languages that know
    them; elsewhere ``base`` holds (the log frequency of none)."""

    def __init__(self, counts: list[tuple[str, int, int]], languages: int):
        """``counts``: (name, number of the language, times), sorted by name."""
        names = [c[0] for c in counts]
        times = np.array([c[2] for c in counts], float)
        self.langs = np.array([c[1] for c in counts], np.int32)
        first = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
        self.rows = {names[k]: r for r, k in enumerate(first)}
        self.offsets = np.array([*first, len(names)], np.int64)
        totals = np.bincount(self.langs, weights=times, minlength=languages) + 0.5 * max(1, len(first))
        self.base = np.log(0.5 / totals)
        self.gains = (np.log((times + 0.5) / totals[self.langs]) - self.base[self.langs]) if len(names) else np.zeros(0)

    def sums(self, found: list[int], sizes: list[int], languages: int, known: bool) -> np.ndarray:
        """Per group of rows (``found`` one after another, ``sizes`` long) the
        sums of the log frequencies, or the numbers of rows each language knows."""
        out = np.zeros(len(sizes) * languages)
        rows = np.array(found, np.int64)
        group = np.repeat(np.arange(len(sizes)), sizes)
        spans = self.offsets[rows + 1] - self.offsets[rows]
        cells = np.repeat(self.offsets[rows] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        if len(cells):
            gains = None if known else self.gains[cells]
            out = np.bincount(np.repeat(group, spans) * languages + self.langs[cells], weights=gains, minlength=len(out)).astype(float)
        out = out.reshape(len(sizes), languages)
        return out if known else out + np.array(sizes, float)[:, None] * self.base


@dataclass
class Model:
    languages: list[str]
    words: Table
    grams: Table


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts per language, added up within each batch."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))],
            names=["lang", "word", "n"])


def sampled(labelled: DataFrame, label: str, size: int, seed: int, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About ``size`` rows of each value of ``label``, chosen by a hash of ``key``."""
    totals = labelled.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).collect()
    parts = 1_000_003
    if not totals:
        return labelled.limit(0)
    limits = F.create_map(*[x for r in totals for x in (F.lit(r[label]), F.lit(-(-parts * size // r["n"])))])
    return labelled.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(parts)) < limits[F.col(label)])


def _top(counts: DataFrame, name: str, kept: int | None, languages: list[str] | None) -> tuple[list[str], Table]:
    """The commonest ``kept`` values of ``name`` per language (all, if None)."""
    if kept is not None:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), name))
        counts = counts.withColumn("place", place).where(F.col("place") <= kept)
    found = counts.select(name, "lang", "n").orderBy(name, "lang").toArrow()       # by columns: no object per row
    languages = sorted(set(found.column("lang").unique().to_pylist())) if languages is None else languages
    number = {x: k for k, x in enumerate(languages)}
    langs = [number[x] for x in found.column("lang").to_pylist()]
    rows = list(zip(found.column(name).to_pylist(), langs, found.column("n").to_pylist(), strict=True))
    return languages, Table(rows, len(languages))


def fit(docs: DataFrame, seed: int = 7, sample: int = SAMPLE_DOCS, words: int | None = KEPT_WORDS,
        grams: int | None = KEPT_GRAMS) -> Model:
    """Learns from rows (doc_id, text, lang) with a text and a language.

    Every language is learnt, from about ``sample`` of its rows, whole texts;
    rows are drawn by a hash of doc_id and text, so those without an id or
    with a shared one are drawn one by one.  The commonest ``words`` words and
    ``grams`` n-grams per language are kept, None keeps all of the sample
    (what isn't kept counts as unseen).  No such row gives a model without
    languages.
    """
    rows = sampled(docs.where("text is not null and lang is not null").select("doc_id", "text", "lang"),
                   "lang", sample, seed, ("doc_id", "text"))
    counts = materialize(rows.select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
                         .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    framed = F.concat(F.lit("^"), "word", F.lit("$"))

    def cut(size: int) -> Column:        # a word that is shorter gives itself
        first = F.sequence(F.lit(1), F.greatest(F.length(framed) - size + 1, F.lit(1)))
        return F.transform(first, lambda i: F.substring(framed, i, F.lit(size)))

    pieces = counts.select("lang", "n", F.explode(F.flatten(F.array(*[cut(size) for size in range(1, LONGEST + 1)]))).alias("gram")) \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages, known = _top(counts, "word", words, None)
    return Model(languages, known, _top(pieces, "gram", grams, languages)[1])


class _Rows(dict):
    """Word -> row of a growing score table; emptied when full.

    ``fits`` (only if asked for) has 1 for a word known in the language, else
    the share of its n-grams of LONGEST that are.
    """

    def __init__(self, model: Model, fits: bool):
        super().__init__()
        self.model = model
        width = len(model.languages)
        self.most = max(1_000, min(CACHE_WORDS, CACHE_CELLS // max(1, width)))
        self.table = np.zeros((self.most + 1, width), dtype=np.float32)
        self.fits = np.zeros_like(self.table) if fits else None

    def learn(self, words: list[str]) -> None:
        """Adds rows for new words, all at once."""
        m, width, start = self.model, len(self.model.languages), len(self)
        grams, known = m.grams.rows.get, m.words.rows.get
        seen = [known(w) for w in words]
        found, sizes, long, longs, places = [], [], [], [], []
        for word, row in zip(words, seen, strict=True):
            framed = f"^{word}$"
            last = len(framed)
            if row is None:
                before = len(found)
                for i in range(last):
                    for end in range(min(i + LONGEST, last), i, -1):
                        if (gram := grams(framed[i:end])) is not None:
                            found.append(gram)
                            break
                sizes.append(len(found) - before)
            if self.fits is not None:
                before = len(long)
                long += [g for i in range(last - LONGEST + 1) if (g := grams(framed[i:i + LONGEST])) is not None]
                longs.append(len(long) - before)
                places.append(max(1, last - LONGEST + 1))
        at = np.arange(start, start + len(words))
        old = np.array([row is not None for row in seen], bool)
        rows = [row for row in seen if row is not None]
        self.table[at[old]] = m.words.sums(rows, [1] * len(rows), width, False)
        self.table[at[~old]] = m.grams.sums(found, sizes, width, False) / np.maximum(1, np.array(sizes))[:, None]
        if self.fits is not None:
            share = m.grams.sums(long, longs, width, True) / np.array(places)[:, None]
            share[old] += m.words.sums(rows, [1] * len(rows), width, True)
            self.fits[at] = np.minimum(share, 1)
        self.update(zip(words, at.tolist(), strict=True))


def classifier(model: Model, with_fits: bool = False):
    """A function text column -> (languages, scores, fits); keeps a cache of
    words.  ``fit`` (0 to 1, whatever the length; None unless asked for) is
    the mean over the words of 1 for one known in the language, else its share
    of known n-grams."""
    rows = _Rows(model, with_fits)

    def classify(texts: pa.Array) -> tuple[list[str], list[float], list[float | None]]:
        names, scores, fits = [], [], []
        for text in texts:
            words = words_of(text.as_py())
            if not words or not model.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                fits.append(0.0 if with_fits else None)
                continue
            total, fit = np.zeros((2, len(model.languages)))
            step = max(1, rows.most // 4)
            for lo in range(0, len(words), step):
                if len(rows) > rows.most // 2:
                    rows.clear()
                here = words[lo:lo + step]
                if new := [w for w in dict.fromkeys(here) if w not in rows]:
                    rows.learn(new)
                at = list(map(rows.__getitem__, here))
                total += rows.table[at].sum(axis=0, dtype=np.float64)
                if with_fits:
                    fit += rows.fits[at].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            names.append(model.languages[best])
            scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            fits.append(float(fit[best] / len(words)) if with_fits else None)
        return names, scores, fits

    return classify


def accepts(model: Model, least: float, fitting: float = 0.0):
    """Makes a function text column -> list of bools: a language was
    recognised with a score of ``least`` and a fit of ``fitting`` or more."""
    def make():
        classify = classifier(model, with_fits=fitting > 0)

        def decide(texts: pa.Array) -> list[bool]:
            return [n != UNKNOWN and s >= least and (not fitting or f >= fitting) for n, s, f in zip(*classify(texts), strict=True)]

        return decide
    return make


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(model)
        for batch in batches:
            names, scores, _ = classify(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])
    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no model may learn labels from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (posterior, 0 to 1).

    A text without letters (null, empty, digits) is ``und`` with score 0, and
    so is every text if the model has no language; of equal scores the
    alphabetically first language wins.  Rows are kept one to one.
    """
    return docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the labelled rows that aren't held out, predicts for all.

    Returns doc_id, held_out, lang_pred, score; see ``fit`` and ``identify``.
    """
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
