"""Registered queries of the thirteen operators, each over its whole table.

``QUERIES[name](spark, sf_dir)`` returns the operator's full result;
``ORACLES`` holds DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim
from .captures import capture_records
from .fingerprints import fingerprints
from .language_id import language_id
from .lexical import lexical_search
from .licenses import license_scan
from .mixing import mix
from .near_dedup import near_duplicates
from .oracles import fim_sql, lexical_sql, mixing_sql, revisits_sql
from .packing import pack
from .personal import KINDS, listed, personal_spans
from .quality import quality
from .quality_rules import quality_rules
from .revisits import resolve_revisits
from .toxicity import toxicity


MIX_SHARE, MIX_EPOCHS = 0.6, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of 60 % of the corpus' tokens, up to four epochs of a leaf."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, share=MIX_SHARE, epochs=MIX_EPOCHS).select(
        "doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"),
        F.col("mix_tokens").alias("tokens"), F.col("mix_take").alias("take"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All derived not-modified revisits, headers as sorted text, the payload
    as its digest and length."""
    found = resolve_revisits(capture_records(table(spark, sf_dir, "pages")))
    fields = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return found.select(
        "record_id", "url", F.col("warc_date").cast("long").alias("second"), "response_id", "outcome",
        F.array_join(fields, "\n").alias("headers"), F.md5("payload").alias("payload_md5"),
        F.length("payload").cast("long").alias("payload_chars"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the fixed patterns' spans, and all spans."""
    found = personal_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"] == kind), False)).cast("long").alias(f"n_{kind}")
              for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output as its digest, beside that of the text rebuilt from it."""
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_fingerprints": op3_fingerprints,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_revisits": op6_revisits,
    "op7_language_id": op7_language_id,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_personal": op12_personal,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: The others learn models, search by MinHash or use hashes that SQL lacks.
ORACLES: dict[str, str] = {
    "op4_mixing": mixing_sql(MIX_SHARE, MIX_EPOCHS),
    "op6_revisits": revisits_sql(),
    "op11_lexical_search": lexical_sql(),
    "op13_fill_in_middle": fim_sql(),
}
