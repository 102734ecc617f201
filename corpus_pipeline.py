"""Corpus pipeline: documents -> packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next stage's
docs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import language_id, mixing, near_dedup, packing, quality
from ledgerlens.session import materialize

#: A language is accepted from this posterior on.
SURE_LANGUAGE = 0.5
#: ... and from this fit on: the mean over its words of 1 for a word known in
#: the language, else its share of known n-grams.  Unlike the posterior it
#: doesn't grow with the length (learnt languages have about 0.98, others 0.2 to 0.4).
SURE_FIT = 0.55
#: Share of the tokens that the mixture takes; each document once at most.
MIX_SHARE = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents without a recognisable language go.

    Rejected are texts without letters (null and empty ones too) and those
    whose best language has a posterior under SURE_LANGUAGE or a fit under
    SURE_FIT (languages not learnt, gibberish); if no document has a language
    to learn from, none is rejected.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    if not model.languages:
        return docs
    sure = language_id.accepts(model, SURE_LANGUAGE, SURE_FIT)

    def keep(batches):
        decide = sure()
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column("text")), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored under quality.KEEP go (none without labels
    of both classes)."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    scores, least = quality.scores, quality.KEEP

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch)[2] >= least, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, a long in the order of doc_id, null ids last.

    Rows that repeat an id and its text share a key; a row without an id, or
    with another text under the same id, has a key of its own.
    """
    tie = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_tie")]
    rows = materialize(docs.withColumn("row_tie", tie), "ties")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_key", F.monotonically_increasing_id())
    first = F.min("row_key").over(Window.partitionBy("doc_id", "row_tie"))
    return materialize(rows.withColumn("row_key", first).drop("row_tie"), "keyed")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each near-duplicate group stays, the one
    with the smallest doc_id (repeated rows of it stay together).

    Decided per row: rows without an id, and different texts under one id,
    are documents of their own; a row with an id stays before one without.
    """
    rows = with_row_key(docs)
    found = near_dedup.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"))
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("row_key")).distinct(), "gone")
    wanted = F.broadcast(gone) if gone.count() <= near_dedup.SENT_IDS else gone
    return rows.join(wanted, "row_key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the mixture at the target weights.  One epoch: a text that
    came twice would undo the deduplication before."""
    return mixing.mix(docs, share=MIX_SHARE, epochs=1).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: all documents left, in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality", judge_quality),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and the pair search can't be written as SQL; the tests
#: compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
