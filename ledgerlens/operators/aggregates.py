"""Aggregations and ordered/limited queries.

All are single ``groupBy``/``agg`` plans (partial aggregation before the
shuffle) or distributed top-k (``orderBy().limit()`` ->
TakeOrderedAndProject); option lists are computed in ONE scan.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SBA_CLASSES, SBA_LOB_ID, TOTAL
from .filters import FilterSpec, apply_filters, has_amount, latest_period, nonblank
from .projections import DETAIL_COLUMNS

DATE = "ProcessingDateKey"


def mean(col: str) -> Column:
    """Average as ``sum / count`` in double (exact sum, one rounding)."""
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


# ------------------------------------------------------------------------ A5
GROUP_KEYS = ["ProcessingDateKey", "LineofBusinessId", "CommitmentSizeGroup", "RiskGroupDesc", "Region"]


def grouped_query(df: DataFrame, spec: FilterSpec | None = None, limit: int | None = None) -> DataFrame:
    """Count/sum/avg/min/max of the commitment on five keys, largest first."""
    g = apply_filters(df, spec).groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("RecordCount"),
        F.sum("CommitmentAmt").cast(TOTAL).alias("TotalCommitment"),
        mean("CommitmentAmt").alias("AvgCommitment"),
        F.min("CommitmentAmt").alias("MinCommitment"),
        F.max("CommitmentAmt").alias("MaxCommitment"))
    g = g.orderBy(F.col(DATE).desc_nulls_first(), F.col("TotalCommitment").desc_nulls_first(),
                  *[F.col(k).asc_nulls_last() for k in GROUP_KEYS[1:]])
    return g if limit is None else g.limit(limit)


def result_totals(grouped: DataFrame) -> DataFrame:
    """Totals over the (limited) grouped result."""
    return grouped.agg(F.count(F.lit(1)).alias("totalRecords"),
                       F.coalesce(F.sum("TotalCommitment"), F.lit(0).cast(TOTAL)).cast(TOTAL)
                        .alias("totalCommitment"))


# ------------------------------------------------------------------------ A6
def analytics_summary(df: DataFrame) -> DataFrame:
    """The ``analytics_summary`` view: six keys over rows with an amount."""
    return df.filter(has_amount()).groupBy(
        DATE, "Region", "LineofBusinessId", "LineofBusiness", "CommitmentSizeGroup", "RiskGroupDesc").agg(
        F.count(F.lit(1)).alias("Deals"),
        F.sum("CommitmentAmt").cast(TOTAL).alias("CommitmentAmt"),
        F.sum("OutstandingAmt").cast(TOTAL).alias("OutstandingAmt"),
        mean("CommitmentAmt").alias("AvgCommitmentAmt"))


# ------------------------------------------------------------------------ A7
def distinct_values(df: DataFrame, col: str, strict: bool = True) -> DataFrame:
    """Sorted distinct values; ``strict`` also drops ``'NULL'``/blank."""
    pred = nonblank(col) if strict else F.col(col).isNotNull()
    return df.filter(pred).select(col).distinct().orderBy(col)


# ------------------------------------------------------------------------ A8
def lob_options(df: DataFrame) -> DataFrame:
    """Line-of-business ids with record count and ``LOB x (SBA)`` label."""
    g = df.filter(nonblank("LineofBusinessId")).groupBy("LineofBusinessId").agg(
        F.count(F.lit(1)).alias("record_count"))
    label = F.concat(F.lit("LOB "), F.col("LineofBusinessId"),
                     F.when(F.col("LineofBusinessId") == SBA_LOB_ID, F.lit(" (SBA)")).otherwise(F.lit(" (Non-SBA)")))
    return g.select(F.col("LineofBusinessId").alias("id"), label.alias("display_name"), "record_count") \
            .orderBy("id")


# ------------------------------------------------------------------------ A9
def lob_label(id_col: Column, name_col: Column) -> Column:
    """``"id - name"`` when the name is non-empty, else the id."""
    return F.when(name_col.isNotNull() & (name_col != ""), F.concat_ws(" - ", id_col, name_col)) \
            .otherwise(id_col.cast("string"))


def lob_labels(df: DataFrame) -> DataFrame:
    d = df.filter(F.col("LineofBusinessId").isNotNull()).select("LineofBusinessId", "LineofBusiness").distinct()
    return d.select("LineofBusinessId", "LineofBusiness",
                    lob_label(F.col("LineofBusinessId"), F.col("LineofBusiness")).alias("label"))


# ----------------------------------------------------------------------- A10
OPTION_DIMENSIONS = (
    ("commitmentSizeGroup", "CommitmentSizeGroup"),
    ("riskGroup", "RiskGroupDesc"),
    ("bankId", "BankID"),
    ("region", "Region"),
    ("naicsGrpName", "NAICSGrpName"),
)


def unpivot_options(combinations: DataFrame, dims) -> DataFrame:
    """``(dimension, value)``: distinct non-NULL values of each (name, column)."""
    parts = [F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in dims]
    return combinations.select(F.inline(F.array(*parts))).filter(F.col("value").isNotNull()).distinct()


def filter_options(df: DataFrame) -> DataFrame:
    """All filter options as ``(dimension, value)`` in ONE scan.

    Rows are first reduced to distinct combinations of the dimensions
    (partial aggregation per task), then unpivoted.  The fixed SBA classes
    are there for an empty tape too.
    """
    dims = [("lineOfBusiness", F.when(F.col("LineofBusinessId").isNotNull(),
                                      lob_label(F.col("LineofBusinessId"), F.col("LineofBusiness"))))]
    dims += [(k, F.col(c)) for k, c in OPTION_DIMENSIONS]
    rows = df.select("LineofBusinessId", "LineofBusiness", *[c for _, c in OPTION_DIMENSIONS]).distinct()
    classes = df.sparkSession.range(1).select(
        F.lit("sbaClassification").alias("dimension"), F.explode(F.array(*[F.lit(v) for v in SBA_CLASSES])).alias("value"))
    return unpivot_options(rows, dims).unionByName(classes).orderBy("dimension", "value")


# ----------------------------------------------------------------------- A11
def summary_stats(df: DataFrame) -> DataFrame:
    """Whole-table statistics over rows with an amount.

    Rows are first reduced by (period, region, line of business, bank) with
    mergeable sums; the exact distinct counts run on that.
    """
    keys = [DATE, "Region", "LineofBusinessId", "BankID"]
    cells = df.filter(has_amount()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("CommitmentAmt").cast(TOTAL).alias("ca"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_records"),
        F.count_distinct(DATE).alias("unique_months"),
        F.min(DATE).alias("earliest_date"),
        F.max(DATE).alias("latest_date"),
        F.sum("ca").cast(TOTAL).alias("total_commitment"),
        F.try_divide(F.sum("ca").cast("double"), F.sum("n").cast("double")).alias("avg_commitment"),
        F.count_distinct("Region").alias("unique_regions"),
        F.count_distinct("LineofBusinessId").alias("unique_lobs"),
        F.count_distinct("BankID").alias("unique_banks"))


# ----------------------------------------------------------------------- A12
def latest_month_stats(df: DataFrame) -> DataFrame:
    """Deals, commitment and outstanding of the latest period."""
    return latest_period(df).groupBy(DATE).agg(
        F.count(F.lit(1)).alias("deals"),
        F.sum("CommitmentAmt").cast(TOTAL).alias("total_commitment"),
        F.sum("OutstandingAmt").cast("double").alias("total_outstanding"))


# -------------------------------------------------------------------- A13-A15
def max_date(df: DataFrame) -> DataFrame:
    return df.agg(F.max(DATE).alias("max_date"))


def months_available(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct(DATE).alias("months_available"))


def table_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(DATE).alias("min_date"),
                  F.max(DATE).alias("max_date"))


# ----------------------------------------------------------------------- A17
def bundle_summary(df: DataFrame) -> DataFrame:
    """TSV dashboard summary: totals, rows, latest period, range, periods."""
    iso = lambda c: F.date_format(F.to_date(c.cast("string"), "yyyyMMdd"), "yyyy-MM-dd")
    return df.agg(
        F.coalesce(F.sum("CommitmentAmt"), F.lit(0)).cast(TOTAL).alias("total_commitment"),
        F.coalesce(F.sum("OutstandingAmt"), F.lit(0)).cast(TOTAL).alias("total_outstanding"),
        F.count(F.lit(1)).alias("total_deals"),
        iso(F.max(DATE)).alias("latest_period"),
        iso(F.min(DATE)).alias("date_start"),
        iso(F.max(DATE)).alias("date_end"),
        F.count_distinct(DATE).alias("record_count"))


# ----------------------------------------------------------------------- A18
def filter_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("LineofBusinessId", "CommitmentSizeGroup").agg(F.count(F.lit(1)).alias("Count")) \
             .orderBy("LineofBusinessId", "CommitmentSizeGroup")


# ------------------------------------------------------------------------ O1
def detail_query(df: DataFrame, spec: FilterSpec | None = None, limit: int | None = None,
                 tie_break: Sequence[str] = ()) -> DataFrame:
    """Filtered detail rows, newest period and largest amount first.

    PostgreSQL puts NULLs first in DESC order; that is spelled out.  A
    request's limit is a distributed top-k (each task keeps ``limit`` rows);
    without one, or with 0, all rows are returned.
    """
    f = apply_filters(df, spec)
    order = [F.col(DATE).desc_nulls_first(), F.col("CommitmentAmt").desc_nulls_first(),
             *[F.col(c).asc_nulls_last() for c in tie_break]]
    out = f.orderBy(*order)
    out = out.limit(limit) if limit else out
    return out.select(*DETAIL_COLUMNS)


# ------------------------------------------------------------------------ O5
def latest_periods(series: DataFrame, n: int = 3) -> DataFrame:
    return series.orderBy(F.col(DATE).desc()).limit(n)


# ------------------------------------------------------------------------ O3
def analytics_series(series: DataFrame, limit: int | None = None) -> DataFrame:
    """The series by period, the first ``limit`` rows of it (all without one, or with 0)."""
    s = series.orderBy(F.col(DATE).asc())
    return s.limit(limit) if limit else s
