"""Operator 2: quality rules, native: counts and robust multivariate outliers.

Per document the counts of the contract, then five transformed statistics.
Per language and source (or the language, or the corpus, where a group has
fewer than ``MIN_GROUP`` documents: a covariance needs support) the minimum
covariance determinant estimate: from two starts, concentration steps refit
mean and covariance to the ``SHARE`` of the documents nearest so far, and the
start with the smaller determinant wins.  A document is rejected when its
squared Mahalanobis distance is beyond ``CUTOFF``.

Everything is DataFrame functions.  A concentration step is one aggregation:
moments are summed per distance bin (log scale, at most about 2000 bins a
group), so the subset boundary, at a bin edge, needs no sort of a group and a
hot group is added up on the map side.  Window hashes are 64-bit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLANK = r"[\x20\x09-\x0D]+"
STATS = ("word_length", "symbols", "dup_lines", "repeats", "shouting")
#: Least standard deviation of each statistic (in its transformed unit), so a
#: statistic that is constant in a group can't make its covariance singular.
FLOOR = (0.05, 0.3, 0.65, 0.65, 0.3)
#: Correlation of the floors of dup_lines and repeats: a repeated line of five
#: words or more counts in both and must not be held against a text twice.
SHARED = 0.5
MIN_GROUP = 200
SHARE = 0.75
STEPS = 6
BINS = 32                        # bins per unit of ln(distance)
#: chi2(5) quantile of 0.9999.  The floors let each statistic go beyond it
#: alone: symbols from about 4 % of the characters, capitals from about 13 %,
#: repeated lines or words from about 16 % (the base rule ends at 20 %).
CUTOFF = 25.745


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function (series)."""
    term = total = 1 / a
    for n in range(1, 500):
        term *= x / (a + n)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def consistency(p: int, share: float) -> float:
    """Factor that makes the covariance of the central ``share`` of a p-variate
    Gaussian estimate the whole one's."""
    lo, hi = 1e-6, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(p / 2, mid / 2) < share else (lo, mid)
    return share / _gamma_p(p / 2 + 1, lo / 2)


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with the counts of the contract."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, BLANK, "")) > 0))
    rows = rows.select(
        "doc_id", "lang", "source", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"[A-Z!]")).cast("long").alias("n_loud"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    starts = F.when(F.size("words") >= 5, F.sequence(F.lit(1), F.size("words") - 4)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, 5)))).drop("words")
    rows = rows.withColumn("repeated", F.size(F.array_distinct("windows")) < F.size("windows"))
    # (hash, position) in order: a window found twice has a neighbour of its hash
    placed = F.when(F.col("repeated"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("placed", placed).drop("windows")
    twice = F.filter("placed", lambda x, j: F.coalesce(F.get("placed", j - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get("placed", j + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("placed")
    covered = F.aggregate(
        "at", F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(5), i - s["last"])).alias("n")), lambda s: s["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at", "repeated")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def statistics(rows: DataFrame) -> DataFrame:
    """The transformed statistic vector; shares of short texts are drawn to 0."""
    share = lambda n, of, prior: F.log1p(100.0 * F.col(n) / (F.col(of) + F.lit(float(prior))))
    return rows.withColumns({
        "word_length": F.log((F.col("word_chars") + 50.0) / (F.col("n_words") + 10.0)),
        "symbols": share("n_symbols", "word_chars", 50), "dup_lines": share("n_dup_lines", "n_lines", 5),
        "repeats": share("n_repeat_words", "n_words", 20), "shouting": share("n_loud", "word_chars", 50),
    })


def groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per language and source (l, s) its ``grp``: itself, its language or all,
    the lowest with support; and every grp that its documents belong to and
    that judges any document, so an estimate rests on its whole group."""
    key = lambda level, *names: F.to_json(F.struct(F.lit(level).alias("level"), *names))
    size = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    size = size.withColumn("in_lang", F.sum("n").over(Window.partitionBy("lang")))
    size = size.withColumns({"own": key("source", "lang", "source"), "whole": key("lang", "lang"), "all": key("all")})
    size = materialize(size.select(
        F.col("lang").alias("l"), F.col("source").alias("s"), "own", "whole", "all",
        F.when(F.col("n") >= MIN_GROUP, F.col("own")).when(F.col("in_lang") >= MIN_GROUP, F.col("whole")).otherwise(F.col("all")).alias("grp")),
        "groups")
    fed = size.select("l", "s", F.explode(F.array("own", "whole", "all")).alias("grp"))
    return size.select("l", "s", "grp"), fed.join(size.select("grp").distinct(), "grp", "left_semi")


def with_group(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Adds ``grp`` of ``found`` by language and source."""
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    return rows.join(found, same, how).drop("l", "s")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _factor(params: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the covariance s_i_j (floored)."""
    for i, j in _pairs():
        rest = F.col(f"s_{i}_{j}")
        for k in range(j):
            rest -= F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        params = params.withColumn(
            f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[i] ** 2 * 1e-3))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return params


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, name in enumerate(STATS):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest -= F.col(f"l_{i}_{j}") * z[j]
        z.append(rest / F.col(f"l_{i}_{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total += x * x
    return total


def _floored(cov: Column | float, i: int, j: int) -> Column:
    """Covariance of the statistics ``i`` and ``j`` with the floors added."""
    share = 1.0 if i == j else SHARED if {STATS[i], STATS[j]} == {"dup_lines", "repeats"} else 0.0
    return cov + F.lit(share * FLOOR[i] * FLOOR[j])


def _moments(sums: DataFrame, scale: float = 1.0) -> DataFrame:
    """Mean and floored covariance from n, t_i, t_i_j."""
    out = {f"m_{i}": F.col(f"t_{i}") / F.col("n") for i in range(len(STATS))}
    for i, j in _pairs():
        cov = (F.col(f"t_{i}_{j}") / F.col("n") - F.col(f"t_{i}") / F.col("n") * F.col(f"t_{j}") / F.col("n")) * scale
        out[f"s_{i}_{j}"] = _floored(cov, i, j)
    return sums.select("grp", "start", *[c.alias(k) for k, c in out.items()])


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(F.col(s)).alias(f"t_{i}") for i, s in enumerate(STATS)],
            *[F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"t_{i}_{j}") for i, j in _pairs()]]


def _starts(good: DataFrame) -> DataFrame:
    """Start 0: all documents' moments.  Start 1: medians and interquartile ranges."""
    plain = _moments(good.groupBy("grp").agg(*_sums()).withColumn("start", F.lit(0)))
    quart = good.groupBy("grp").agg(*[F.percentile_approx(s, [0.25, 0.5, 0.75], 10_000).alias(f"q_{i}") for i, s in enumerate(STATS)])
    cols = [F.col(f"q_{i}")[1].cast("double").alias(f"m_{i}") for i in range(len(STATS))]
    for i, j in _pairs():
        spread = (F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349
        cols.append(_floored(spread * spread if i == j else 0.0, i, j).alias(f"s_{i}_{j}"))
    return plain.unionByName(quart.select("grp", F.lit(1).alias("start"), *cols))


def _concentrate(good: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: moments of the SHARE nearest documents."""
    placed = (good.join(_factor(params), "grp")
              .withColumn("bin", F.floor(F.log(_distance() + 1e-9) * BINS)))
    bins = placed.groupBy("grp", "start", "bin").agg(*_sums())
    group = Window.partitionBy("grp", "start")
    inner = (bins.withColumn("total", F.sum("n").over(group))
             .withColumn("before", F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .where(F.col("before") < F.ceil(F.col("total") * SHARE)))
    names = ["n", *[f"t_{i}" for i in range(len(STATS))], *[f"t_{i}_{j}" for i, j in _pairs()]]
    return _moments(inner.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in names]), consistency(len(STATS), SHARE))


def robust_estimates(good: DataFrame) -> DataFrame:
    """Per grp the minimum covariance determinant estimate (m_i, s_i_j, l_i_j)."""
    params = materialize(_starts(good), "mcd")
    for _ in range(STEPS):
        params = materialize(_concentrate(good, params), "mcd")
    found = _factor(params)
    det = F.lit(0.0)
    for i in range(len(STATS)):
        det += F.log(F.col(f"l_{i}_{i}"))
    first = F.row_number().over(Window.partitionBy("grp").orderBy(F.round(det, 9), "start"))
    return found.withColumn("place", first).where("place = 1").drop("place", "start")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base rule and outlier verdict for every row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance (squared Mahalanobis; null
    for base_failed rows, which take no part in the estimates).  A null text
    counts as empty; null languages and sources are groups of their own;
    repeated rows are judged alike; an empty table gives no rows.
    """
    rows = materialize(statistics(base_counts(docs)), "counts")
    judges, fed = groups(rows)
    good = rows.where("not base_failed").select("lang", "source", *STATS)
    good = materialize(with_group(good, fed, "inner").select("grp", *STATS), "statistics")
    verdict = with_group(rows, judges, "left").join(materialize(robust_estimates(good), "mcd"), "grp", "left") \
        .withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return verdict.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"), "distance")
