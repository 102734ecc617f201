"""Projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SBA_LOB_ID, TAPE_COLUMNS

# --- fixed values: the detail projection and the columns every result must hold ---
DETAIL_COLUMNS = [
    "ProcessingDateKey", "CommitmentAmt", "OutstandingAmt", "Region", "NAICSGrpName",
    "CommitmentSizeGroup", "RiskGroupDesc", "LineofBusinessId", "LineofBusiness",
    "BankID", "MaturityTermMonths", "SpreadBPS", "YieldPct",
]

REQUIRED = ["ProcessingDateKey", "BankID", "CommitmentAmt", "OutstandingAmt"]
# ------------------------------------------------------------------------------------


def _resolve(df: DataFrame, name: str) -> str:
    by_lower = {c.lower(): c for c in df.columns}
    try:
        return by_lower[name.lower()]
    except KeyError:
        raise ValueError(f"unknown column {name!r}") from None


def project(df: DataFrame, columns=None) -> DataFrame:
    """Select a column list in any letter case; None or '*' = all."""
    if not columns or columns == "*" or list(columns) == ["*"]:
        return df
    return df.select(*[F.col(_resolve(df, c)).alias(c) for c in columns])


def detail_columns(df: DataFrame, extra=()) -> DataFrame:
    """The fixed 13-column detail projection."""
    return df.select(*DETAIL_COLUMNS, *extra)


def require_columns(df: DataFrame, names=REQUIRED) -> DataFrame:
    """Raise if a required column is missing (case-insensitive)."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def with_sba(df: DataFrame, col: str = "LineofBusinessId") -> DataFrame:
    """``SBA_Classification`` (NULL ids are Non-SBA), kept if present."""
    if "SBA_Classification" in df.columns:
        return df
    return df.withColumn("SBA_Classification",
                         F.when(F.col(col) == SBA_LOB_ID, "SBA").otherwise("Non-SBA"))


def canonicalise(df: DataFrame, canonical=TAPE_COLUMNS) -> DataFrame:
    """P5: rename columns case-insensitively to the canonical tape names."""
    by_lower = {c.lower(): c for c in canonical}
    mapping = {c: by_lower[c.lower()] for c in df.columns
               if c.lower() in by_lower and by_lower[c.lower()] != c}
    return df.withColumnsRenamed(mapping) if mapping else df


def csv_composites(totals: DataFrame) -> DataFrame:
    """Series renamed to ``ca``/``oa``/``deals``."""
    return totals.select("ProcessingDateKey", F.col("CommitmentAmt").alias("ca"),
                         F.col("OutstandingAmt").alias("oa"), F.col("Deals").alias("deals"))
