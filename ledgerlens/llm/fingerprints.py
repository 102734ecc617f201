"""Operator 3: threshold-scaled document fingerprints, native.

A fingerprint keeps every 5-word shingle hash below 1 / 2**SCALE of the hash
range (in ascending order, 16 hex digits each).  The line is the same for all
texts, so the share of a small text's hashes found in a large one's estimates
containment however unequal they are; likeness here is that containment of
the smaller one.  A text whose hashes are all above the line keeps its least
one, so that short texts can be told apart; ``merge`` gives the fingerprint
of two texts' shingles together exactly: the union of what lies below the
line, and only where nothing does the lesser of the least hashes.

The next document in descending doc_id order comes from a window per range of
doc_id (``operators.ranges``); each range gets a copy of the first row of the
range below it, the lowest one that of the highest.  The texts are shuffled
once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import quantile_cuts, range_number

SCALE = 2
ROWS_PER_RANGE = 2048
MOST_RANGES = 100_000
BLANK = r"[\x20\x09-\x0D]+"


def with_sketch(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the retained shingle hashes of column ``text`` as array<long>."""
    words, hashes = f"{out}_words", f"{out}_hashes"
    rows = rows.withColumn(words, F.array_remove(F.split(text, BLANK), ""))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - 4, F.lit(1)))
    rows = rows.withColumn(hashes, F.when(F.size(words) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, 5))))).drop(words)
    rows = rows.withColumn(out, below_line(hashes))
    kept = F.when(F.size(out) > 0, F.sort_array(F.array_distinct(out))).when(F.size(hashes) > 0, F.array(F.array_min(hashes)))
    return rows.withColumn(out, F.coalesce(kept, F.array().cast("array<long>"))).drop(hashes)


def below_line(hashes: str | Column) -> Column:
    return F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - SCALE) == 0)


def merge(a: str, b: str) -> Column:
    """The sketch of both texts' shingles together (columns of ``with_sketch``)."""
    both = F.array_union(a, b)
    low = below_line(both)
    return (F.when(F.size(low) > 0, F.sort_array(low)).when(F.size(both) > 0, F.array(F.array_min(both)))
            .otherwise(F.array().cast("array<long>")))


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated containment of the smaller text: 0 to 1 (1 if both are empty)."""
    least = F.least(F.size(a), F.size(b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(least == 0, F.lit(0.0))
            .otherwise(F.size(F.array_intersect(a, b)) / least).cast("double"))


def with_next(docs: DataFrame, make) -> DataFrame:
    """Adds ``next_text`` and ``next_sketch`` of the next row in the order of
    descending doc_id (null ids last, equal ids by text), the first row's
    after the last.  ``make`` adds the column ``sketch`` to the dealt rows."""
    ranges = min(MOST_RANGES, max(1, -(-docs.count() // ROWS_PER_RANGE)))
    number = range_number(F.col("doc_id"), quantile_cuts(docs, "doc_id", ranges))
    dealt = docs.withColumn("bucket", number)
    tops = dealt.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    above = [r["bucket"] for r in tops[1:]] + [r["bucket"] for r in tops[:1]]
    first = docs.sparkSession.createDataFrame(
        [(r["bucket"], r["top"], to) for r, to in zip(tops, above, strict=True)], "bucket long, top long, above long")
    own = F.struct("bucket", F.lit(False).alias("copy"))
    copy = F.struct(F.col("above").alias("bucket"), F.lit(True).alias("copy"))
    placed = (dealt.join(F.broadcast(first), "bucket")            # one row per range: at most MOST_RANGES
              .withColumn("place", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, copy)).otherwise(F.array(own))))
              .select("doc_id", "text", "place.bucket", "place.copy"))
    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    return (make(placed.repartition("bucket"))
            .withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
            .where("not copy").drop("bucket", "copy"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  A null text counts as empty; a text without a
    word has the empty fingerprint, fewer than five words make one shingle;
    repeated rows are rows like any other (neighbours in the order); a single
    row is its own next; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, lambda x: with_sketch(x, "text", "sketch"))
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))
