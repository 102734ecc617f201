"""Report-level jobs: tape query (E6), TSV dashboard bundle (E5), formatted
report rows (E8) and the status panel (E9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as AG
from ..operators import series as S
from ..operators.filters import FilterSpec, apply_filters
from ..operators.projections import project, require_columns, with_sba

DATE = "ProcessingDateKey"


# ------------------------------------------------------------------------ E6
def tape_query(df: DataFrame, region="Rocky Mountain", sba="Non-SBA", lob=None, sizes=None, risks=None,
               columns=None, limit: int | None = None, residual: bool = True) -> DataFrame:
    """Flexible tape query: region, SBA class, LOB ids, size and risk
    groups, the residual maturity filter, a projection and the SBA column.

    A request's limit takes any rows, like the SQL ``LIMIT`` without ``ORDER
    BY`` it stands for; without one all rows are returned.  Rows are classed
    before the projection; the result must hold the required columns.
    """
    spec = FilterSpec.of(regions=region, sba=None if sba in (None, "All") else [sba], lob=lob,
                         size_groups=sizes, risk_groups=risks, residual=residual)
    classed = with_sba(apply_filters(df, spec))
    added = [c for c in classed.columns if c not in df.columns]
    out = require_columns(project(classed, None if columns is None else [*columns, *added]))
    return out if limit is None else out.limit(limit)


# ------------------------------------------------------------------------ E5
def bundle_options(df: DataFrame) -> DataFrame:
    """TSV-path filter options: sorted distinct non-NULL values per
    dimension (line of business by *name*, bank ids as text), one scan; the
    rows are reduced to distinct combinations before they are unpivoted."""
    dims = (("lineOfBusiness", "LineofBusiness"), ("commitmentSizeGroup", "CommitmentSizeGroup"),
            ("riskGroup", "RiskGroupDesc"), ("bankId", "BankID"), ("region", "Region"),
            ("naicsGrpName", "NAICSGrpName"))
    return AG.unpivot_options(df.select(*[c for _, c in dims]).distinct(),
                              [(k, F.col(c)) for k, c in dims]).orderBy("dimension", "value")


def dashboard_bundle(df: DataFrame) -> dict[str, DataFrame]:
    """E5: raw rows + options + monthly series (``tsv`` PoP) + summary."""
    totals = S.period_totals(df, deals="bank")
    return {"raw_data": df,
            "filter_options": bundle_options(df),
            "analytics_data": S.pop_change(totals, "tsv"),
            "summary": AG.bundle_summary(df.filter(F.col(DATE).isNotNull()))}


# ------------------------------------------------------------------------ E8
CHANGES = (("ca_diff", "ca_diff"), ("oa_diff", "oa_diff"), ("deals_diff", "deals_diff"),
           ("ca_model_diff", "ca_model"), ("oa_model_diff", "oa_model"), ("deals_model_diff", "deals_model"))


def report_view(result: DataFrame) -> DataFrame:
    """Formatted table rows plus chart series for a ``RESULT_SCHEMA`` frame.

    Also takes the monthly series variants (ISO keys, no model changes): an
    absent model change shows as missing.  Per change: its text, its sign
    class and its percentage; per amount: its text, its prior's text and the
    raw chart value.
    """
    for name, _ in CHANGES:
        if name not in result.columns:
            result = result.withColumn(name, F.lit(None).cast("double"))
    idx = S.index_100(result)
    cols = [
        F.col(DATE),
        X.date_label(F.col(DATE), "long").alias("period"),
        X.date_label(F.col(DATE), "short").alias("chart_date"),
        X.date_label(F.col(DATE), "month").alias("chart_full_date"),
        X.date_label(F.col("ProcessingDateKeyPrior"), "long").alias("prior_period")]
    for col, name in (("CommitmentAmt", "commitment"), ("Deals", "deals"), ("OutstandingAmt", "outstanding")):
        cols += [X.human_number(col, "table").alias(name), X.human_number(f"{col}Prior", "table").alias(f"{name}_prior"),
                 F.col(col).cast("double").alias(f"chart_{name}")]
    for col, name in CHANGES:
        cols += [X.percent_text(col).alias(f"{name}_text"), X.sign_class(col).alias(f"{name}_class"),
                 (F.col(col) * 100).alias(f"{name}_pct")]
    return idx.select(*cols, "commitmentIndex", "outstandingIndex", "dealsIndex")


# ------------------------------------------------------------------------ E9
def status_panel(df: DataFrame, as_of: str) -> DataFrame:
    """Row count, latest period label, total commitment and freshness.

    The panel knows the latest period by its label, a month: freshness takes
    the first of that month.
    """
    s = AG.summary_stats(df)
    month = X.date_to_key(F.trunc(X.key_to_date("latest_date"), "month"))
    return s.select(
        F.col("total_records").alias("record_count"),
        X.date_label(F.col("latest_date"), "month_short").alias("latest_period"),
        F.col("total_commitment"),
        X.human_number(F.col("total_commitment"), "compact").alias("total_commitment_text"),
        X.freshness(month, as_of).alias("freshness"))
