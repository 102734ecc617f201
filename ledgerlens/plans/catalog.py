"""Registered queries: Spark callables and their DuckDB oracles.

Every query reads the driver tables through ``tape_from_tables`` (the
same mapping as ``TAPE_CTE``) and runs over the whole tape.  Double
columns are rounded to 6 places on both sides (``finish`` / ``rounded``)
because floating-point sums depend on evaluation order.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TAPE_COLUMNS, CapConfig
from ..operators import composite as C
from ..operators.filters import FilterSpec, apply_filters
from ..session import ensure_checkpoint_dir
from ..sources import period_sketches as PS
from ..sources import period_table as PT
from ..sources.tape import tape_from_tables
from . import analysis as A
from . import oracle_sql as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles and fold -0.0 into 0.0 (mirrors ``oracle_sql.rounded``)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None, dbl: tuple[str, ...] = ()):
    """Register ``fn(spark, tape) -> DataFrame`` as ``queries()[name]``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, tape_from_tables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = O.rounded(sql, dbl)
        return fn
    return deco


# ===================================================================== E1/E2
NON_SBA = FilterSpec.of(sba=["Non-SBA"])
SBA = FilterSpec.of(sba=["SBA"])

E2_DBL = ("ca_diff", "oa_diff", "deals_diff", "ca_model_diff", "oa_model_diff", "deals_model_diff")


def _filtered_sql(where: str = "TRUE", scope_sel: str = "") -> str:
    return f"src AS (SELECT {scope_sel}* FROM tape WHERE {where})"


@register("capped_vs_uncapped", O.with_tape(_filtered_sql(), O.composite_ctes("src"), recursive=True)
          + O.result_select(), E2_DBL)
def q_capped_vs_uncapped(spark, tape):
    """E2 (flagship) over the whole tape."""
    return A.capped_vs_uncapped(tape)


@register("capped_vs_uncapped_nan",
          O.with_tape(_filtered_sql(), O.composite_ctes("src", missing="nan"), recursive=True) + O.result_select(), E2_DBL)
def q_capped_vs_uncapped_nan(spark, tape):
    """E2 over the whole tape with the original application's NaN semantics."""
    return A.capped_vs_uncapped(tape, None, CapConfig(missing="nan"))


@register("capped_vs_uncapped_sba_nan",
          O.with_tape(_filtered_sql("LineofBusinessId = '12'"), O.composite_ctes("src", missing="nan"),
                      recursive=True) + O.result_select(), E2_DBL)
def q_capped_vs_uncapped_sba_nan(spark, tape):
    """E2 on the sparse SBA panel with the original application's NaN semantics."""
    return A.capped_vs_uncapped(tape, SBA, CapConfig(missing="nan"))


@register("capped_vs_uncapped_sba",
          O.with_tape(_filtered_sql("LineofBusinessId = '12'"), O.composite_ctes("src"),
                      recursive=True) + O.result_select(), E2_DBL)
def q_capped_vs_uncapped_sba(spark, tape):
    """E2 on the sparse SBA panel (missing cells excluded)."""
    return A.capped_vs_uncapped(tape, SBA)


@register("composites",
          O.with_tape(_filtered_sql(), O.composite_ctes("src"), recursive=True)
          + "\nSELECT ProcessingDateKey, ca, oa, deals FROM compw", ("ca", "oa", "deals"))
def q_composites(spark, tape):
    """Composite change series."""
    return C.composites(tape)


@register("cell_aggregate",
          O.with_tape(_filtered_sql(), O.composite_ctes("src"), recursive=True)
          + "\nSELECT ProcessingDateKey, BankID, CommitmentAmt, Deals, OutstandingAmt FROM cells")
def q_cell_aggregate(spark, tape):
    """A1: date x bank cells."""
    return C.cell_aggregate(tape)


@register("cap_max_proportion",
          O.with_tape(_filtered_sql(), O.composite_ctes("src"), recursive=True)
          + '\nSELECT metric, ProcessingDateKey, BankID, amt, "Sum", "Perc", "Max", v AS "Capped" FROM capped',
          ("Sum", "Perc", "Max", "Capped"))
def q_cap_max_proportion(spark, tape):
    """Concentration cap of every metric."""
    return C.cap_max_proportion(C.long_panel(C.cells(tape)))


_LIM_COLS = ("metric, ProcessingDateKey, actual_data, num_breaches_max, num_breaches_min, "
             "perc_breaches_max, perc_breaches_min, lim_max, lim_min")
_LIM_DBL = ("perc_breaches_max", "perc_breaches_min", "lim_max", "lim_min")
_CHAIN_DBL = ("value", "perc_diff_raw", "perc_diff", "mod", "prev_mod")


def _composite_sql(select: str, where: str, missing: str = "exclude") -> str:
    return O.with_tape(_filtered_sql(where), O.composite_ctes("src", missing=missing), recursive=True) + "\n" + select


def _stage_queries(suffix: str, spec: FilterSpec | None, where: str, rows: str) -> None:
    """W6-W9 in both missing modes over the rows ``spec`` selects."""
    nan = CapConfig(missing="nan")

    def parts(tape, cfg=CapConfig()):
        return C.composite_parts(C.cells(apply_filters(tape, spec)), (), cfg)

    def add(name, doc, sql, dbl, fn):
        fn.__doc__ = f"{doc}, {rows}."
        register(name + suffix, sql, dbl)(fn)

    add("raw_mom", "W6: bank change against the previous period", _composite_sql(
        "SELECT metric, ProcessingDateKey, BankID, v AS value, PrevDateKey, perc_diff_raw FROM raw", where),
        ("value", "perc_diff_raw"),
        lambda spark, tape: parts(tape)["raw"].select("metric", "ProcessingDateKey", "BankID", F.col("Capped").alias("value"),
                                                      "PrevDateKey", "perc_diff_raw"))
    limits = f"SELECT {_LIM_COLS} FROM lims"
    add("breach_limits", "W7: limits, missing cells excluded", _composite_sql(limits, where), _LIM_DBL,
        lambda spark, tape: parts(tape)["limits"])
    add("breach_limits_nan", "W7: limits, missing cells counted as upper breaches", _composite_sql(limits, where, "nan"), _LIM_DBL,
        lambda spark, tape: parts(tape, nan)["limits"])
    add("capped_chain", "W8: clamped chain per bank", _composite_sql(
        'SELECT metric, BankID, ProcessingDateKey, value, perc_diff_raw, perc_diff, mod_v AS "mod", prev_mod, inc FROM chain', where),
        _CHAIN_DBL, lambda spark, tape: parts(tape)["chain"].drop("PrevDateKey", "n_banks"))
    change = "SELECT metric, ProcessingDateKey, curr_sum, prior_sum, perc_diff FROM comp"
    add("composite", "W9: weighted change, missing cells excluded", _composite_sql(change, where),
        ("curr_sum", "prior_sum", "perc_diff"), lambda spark, tape: parts(tape)["composite"])
    add("composite_nan", "W9: weighted change, missing cells void it", _composite_sql(change, where, "nan"),
        ("curr_sum", "prior_sum", "perc_diff"), lambda spark, tape: parts(tape, nan)["composite"])


_stage_queries("", None, "TRUE", "over the whole tape")
_stage_queries("_sba", SBA, "LineofBusinessId = '12'", "on the sparse SBA panel")


# ============================================================ series
from ..operators import series as S  # noqa: E402
from ..operators import aggregates as AG  # noqa: E402
from ..operators import filters as FL  # noqa: E402
from ..operators import projections as P  # noqa: E402
from ..functions import scalars as X  # noqa: E402
from ..sources import files as FS  # noqa: E402
from ..sources.tape import TIE_BREAK  # noqa: E402
from . import report as R  # noqa: E402
from . import templates as TP  # noqa: E402

_TOT_A2 = """tot AS (
  SELECT ProcessingDateKey,
    CAST(COALESCE(SUM(CommitmentAmt), 0) AS DECIMAL(38,2)) AS CommitmentAmt,
    COUNT(CommitmentAmt) AS Deals,
    CAST(COALESCE(SUM(OutstandingAmt), 0) AS DECIMAL(38,2)) AS OutstandingAmt
  FROM tape GROUP BY ProcessingDateKey)"""

_LAGS = """lagged AS (
  SELECT *, LAG(ProcessingDateKey) OVER w AS pk, LAG(CommitmentAmt) OVER w AS CommitmentAmtPrior,
    LAG(OutstandingAmt) OVER w AS OutstandingAmtPrior, LAG(Deals) OVER w AS DealsPrior
  FROM tot WINDOW w AS (ORDER BY ProcessingDateKey))"""


def _chg(cur, prior, style="core"):
    if style == "core":
        return (f"CASE WHEN {prior} IS NULL OR {prior} = 0 THEN NULL "
                f"ELSE CAST({cur} AS DOUBLE) / CAST({prior} AS DOUBLE) - 1 END")
    if style == "view":
        return (f"CASE WHEN {prior} > 0 THEN (CAST({cur} AS DOUBLE) - CAST({prior} AS DOUBLE)) "
                f"/ CAST({prior} AS DOUBLE) END")
    return (f"CASE WHEN {prior} IS NULL OR {prior} = 0 THEN NULL ELSE (CAST({cur} AS DOUBLE) - "
            f"CAST({prior} AS DOUBLE)) / CAST({prior} AS DOUBLE) END")


_DIFFS = ("ca_diff", "oa_diff", "deals_diff")


@register("period_totals", O.with_tape(_TOT_A2) + "\nSELECT * FROM tot")
def q_period_totals(spark, tape):
    """A2: uncapped totals, non-NULL-amount deals, empty sums 0."""
    return S.period_totals(tape)


@register("with_prior", O.with_tape(_TOT_A2, _LAGS) + """
SELECT ProcessingDateKey, CommitmentAmt, Deals, OutstandingAmt, pk AS ProcessingDateKeyPrior,
  CommitmentAmtPrior, OutstandingAmtPrior, DealsPrior FROM lagged""")
def q_with_prior(spark, tape):
    """LAG of key and metrics."""
    return S.with_prior(S.period_totals(tape))


@register("join_prior", O.with_tape(_TOT_A2, _LAGS) + """
SELECT ProcessingDateKey, CommitmentAmt, Deals, OutstandingAmt, COALESCE(pk, 0) AS ProcessingDateKeyPrior,
  CommitmentAmtPrior, OutstandingAmtPrior, DealsPrior FROM lagged""")
def q_join_prior(spark, tape):
    """Prior-period left self-join."""
    return S.join_prior(S.period_totals(tape))


@register("pop_core", O.with_tape(_TOT_A2, _LAGS) + f"""
SELECT ProcessingDateKey, CommitmentAmt, Deals, OutstandingAmt, COALESCE(pk, 0) AS ProcessingDateKeyPrior,
  CommitmentAmtPrior, OutstandingAmtPrior, DealsPrior,
  {_chg('CommitmentAmt', 'CommitmentAmtPrior')} AS ca_diff,
  {_chg('OutstandingAmt', 'OutstandingAmtPrior')} AS oa_diff,
  {_chg('Deals', 'DealsPrior')} AS deals_diff FROM lagged""", _DIFFS)
def q_pop_core(spark, tape):
    """W2 core variant."""
    return S.pop_change(S.period_totals(tape), "core")


_TOT_VIEW = """tot AS (
  SELECT ProcessingDateKey, CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS CommitmentAmt,
    COUNT(*) AS Deals, CAST(SUM(OutstandingAmt) AS DECIMAL(38,2)) AS OutstandingAmt
  FROM tape WHERE CommitmentAmt IS NOT NULL GROUP BY ProcessingDateKey)"""

_VIEW_SELECT = f"""
SELECT CAST(ProcessingDateKey AS VARCHAR) AS ProcessingDateKey, CommitmentAmt, Deals, OutstandingAmt,
  COALESCE(CAST(pk AS VARCHAR), '0') AS ProcessingDateKeyPrior,
  COALESCE(CommitmentAmtPrior, CAST(0 AS DECIMAL(38,2))) AS CommitmentAmtPrior,
  COALESCE(OutstandingAmtPrior, CAST(0 AS DECIMAL(38,2))) AS OutstandingAmtPrior,
  COALESCE(DealsPrior, 0) AS DealsPrior,
  {_chg('CommitmentAmt', 'CommitmentAmtPrior', 'view')} AS ca_diff,
  {_chg('OutstandingAmt', 'OutstandingAmtPrior', 'view')} AS oa_diff,
  {_chg('Deals', 'DealsPrior', 'view')} AS deals_diff,
  CAST(NULL AS DOUBLE) AS ca_model_diff, CAST(NULL AS DOUBLE) AS oa_model_diff,
  CAST(NULL AS DOUBLE) AS deals_model_diff
FROM lagged"""
_VIEW_DBL = _DIFFS + ("ca_model_diff", "oa_model_diff", "deals_model_diff")


@register("pop_view", O.with_tape(_TOT_VIEW, _LAGS) + _VIEW_SELECT, _VIEW_DBL)
def q_pop_view(spark, tape):
    """W2 view variant (the ``aggregated_analytics`` view)."""
    return FS.aggregated_analytics(tape)


_POP_TSV_SQL = (O.with_tape("""tot AS (
  SELECT ProcessingDateKey, CAST(COALESCE(SUM(CommitmentAmt), 0) AS DECIMAL(38,2)) AS CommitmentAmt,
    COUNT(BankID) AS Deals, CAST(COALESCE(SUM(OutstandingAmt), 0) AS DECIMAL(38,2)) AS OutstandingAmt
  FROM tape WHERE ProcessingDateKey IS NOT NULL GROUP BY ProcessingDateKey)""", _LAGS) + f"""
SELECT strftime(strptime(CAST(ProcessingDateKey AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS ProcessingDateKey,
  CommitmentAmt, Deals, OutstandingAmt,
  COALESCE(strftime(strptime(CAST(pk AS VARCHAR), '%Y%m%d'), '%Y-%m-%d'), '0') AS ProcessingDateKeyPrior,
  COALESCE(CommitmentAmtPrior, CAST(0 AS DECIMAL(38,2))) AS CommitmentAmtPrior,
  COALESCE(OutstandingAmtPrior, CAST(0 AS DECIMAL(38,2))) AS OutstandingAmtPrior,
  COALESCE(DealsPrior, 0) AS DealsPrior,
  COALESCE({_chg('CommitmentAmt', 'CommitmentAmtPrior', 'tsv')}, 0.0) AS ca_diff,
  COALESCE({_chg('OutstandingAmt', 'OutstandingAmtPrior', 'tsv')}, 0.0) AS oa_diff,
  COALESCE({_chg('Deals', 'DealsPrior', 'tsv')}, 0.0) AS deals_diff
FROM lagged""")


@register("pop_tsv", _POP_TSV_SQL, _DIFFS)
def q_pop_tsv(spark, tape):
    """W2 tsv variant (A3 totals, bank-count deals, NULLs -> 0)."""
    return S.pop_change(S.period_totals(tape, deals="bank"), "tsv")


@register("pop_seed", O.with_tape("""tot AS (
  SELECT ProcessingDateKey, CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS CommitmentAmt,
    COUNT(*) AS Deals, CAST(SUM(OutstandingAmt) AS DECIMAL(38,2)) AS OutstandingAmt
  FROM tape GROUP BY ProcessingDateKey)""", _LAGS) + f"""
SELECT ProcessingDateKey, CommitmentAmt, Deals, OutstandingAmt, COALESCE(pk, 0) AS ProcessingDateKeyPrior,
  CommitmentAmtPrior, OutstandingAmtPrior, DealsPrior,
  round({_chg('CommitmentAmt', 'CommitmentAmtPrior')}, 6) AS ca_diff,
  round({_chg('OutstandingAmt', 'OutstandingAmtPrior')}, 6) AS oa_diff,
  round({_chg('Deals', 'DealsPrior')}, 6) AS deals_diff,
  CAST(NULL AS DOUBLE) AS ca_model_diff, CAST(NULL AS DOUBLE) AS oa_model_diff,
  CAST(NULL AS DOUBLE) AS deals_model_diff
FROM lagged""", _VIEW_DBL)
def q_pop_seed(spark, tape):
    """W2 seed variant (A4 with COUNT(*), changes rounded to 6 places)."""
    return S.pop_change(S.period_totals(tape, deals="rows"), "seed")


def _attach_sql(where: str) -> str:
    return O.with_tape(_filtered_sql(where), O.composite_ctes("src"), _TOT_A2, recursive=True) + """
SELECT t.ProcessingDateKey, t.CommitmentAmt, t.Deals, t.OutstandingAmt, c.series_date, c.series_ca
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ProcessingDateKey) AS pos FROM tot) t
LEFT JOIN (SELECT ProcessingDateKey AS series_date, ca AS series_ca, ROW_NUMBER() OVER (ORDER BY ProcessingDateKey) AS pos
           FROM compw) c ON t.pos = c.pos"""


def _attach(tape, series_tape):
    comp = C.composites(series_tape).select(F.col("ProcessingDateKey").alias("series_date"), F.col("ca").alias("series_ca"))
    return S.attach_by_position(S.period_totals(tape), "ProcessingDateKey", comp, "series_date", ["series_date", "series_ca"])


@register("attach_by_position", _attach_sql("TRUE"), ("series_ca",))
def q_attach_by_position(spark, tape):
    """The composite series paired by position with the monthly totals."""
    return _attach(tape, tape)


@register("attach_by_position_sba", _attach_sql("LineofBusinessId = '12'"), ("series_ca",))
def q_attach_by_position_sba(spark, tape):
    """J3 with the shorter SBA series: the last period is padded."""
    return _attach(tape, apply_filters(tape, SBA))


@register("index_100", O.with_tape(_TOT_A2) + """
SELECT ProcessingDateKey, CommitmentAmt, Deals, OutstandingAmt,
  CASE WHEN rn = 1 THEN 100.0 WHEN b_ca IS NULL OR b_ca <= 0 THEN 100.0
       ELSE CAST(CommitmentAmt AS DOUBLE) / CAST(b_ca AS DOUBLE) * 100 END AS commitmentIndex,
  CASE WHEN rn = 1 THEN 100.0 WHEN b_oa IS NULL OR b_oa <= 0 THEN 100.0
       ELSE CAST(OutstandingAmt AS DOUBLE) / CAST(b_oa AS DOUBLE) * 100 END AS outstandingIndex,
  CASE WHEN rn = 1 THEN 100.0 WHEN b_d IS NULL OR b_d <= 0 THEN 100.0
       ELSE CAST(Deals AS DOUBLE) / CAST(b_d AS DOUBLE) * 100 END AS dealsIndex
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ProcessingDateKey) AS rn,
        FIRST_VALUE(CommitmentAmt) OVER (ORDER BY ProcessingDateKey) AS b_ca,
        FIRST_VALUE(OutstandingAmt) OVER (ORDER BY ProcessingDateKey) AS b_oa,
        FIRST_VALUE(Deals) OVER (ORDER BY ProcessingDateKey) AS b_d FROM tot) x""",
          ("commitmentIndex", "outstandingIndex", "dealsIndex"))
def q_index_100(spark, tape):
    """Base-100 index of the monthly totals."""
    return S.index_100(S.period_totals(tape))


def _summary_sql(metric):
    return f"""
SELECT '{metric}' AS metric, latest, previous,
  CASE WHEN latest > previous THEN 'up' WHEN latest < previous THEN 'down' ELSE 'stable' END AS trend,
  CASE WHEN previous IS NULL OR previous = 0 THEN 0.0 ELSE (latest - previous) / previous * 100 END AS change
FROM (SELECT MAX(CASE WHEN rn = 1 THEN v END) AS latest, MAX(CASE WHEN rn = 2 THEN v END) AS previous
      FROM (SELECT CAST({metric} AS DOUBLE) AS v,
              ROW_NUMBER() OVER (ORDER BY ProcessingDateKey DESC) AS rn FROM tot WHERE {metric} IS NOT NULL) a
      WHERE rn <= 2) b"""


@register("metric_summary", O.with_tape(_TOT_A2) + "\nUNION ALL".join(
    _summary_sql(m) for m in ("CommitmentAmt", "OutstandingAmt", "Deals")), ("latest", "previous", "change"))
def q_metric_summary(spark, tape):
    """Latest / previous / trend / % change of each monthly total."""
    return S.metric_summary(S.period_totals(tape), ("CommitmentAmt", "OutstandingAmt", "Deals"))


# ================================================================ filters
_DETAIL = ", ".join(P.DETAIL_COLUMNS)


def _detail_sql(where: str) -> str:
    return O.with_tape() + f"\nSELECT {_DETAIL} FROM tape WHERE {where}"


def _filter_query(name: str, spec: FilterSpec, doc: str):
    def fn(spark, tape):
        return P.detail_columns(apply_filters(tape, spec))
    fn.__doc__ = doc
    register(name, _detail_sql(O.spec_sql(spec)))(fn)


_filter_query("filter_sba", FilterSpec.of(sba=["non-sba", "unknown"]),
              "F1: Non-SBA (case-insensitive), unknown classes ignored, NULL ids dropped.")
_filter_query("filter_lob", FilterSpec.of(lob=["11 - Commercial", "12", "3"]),
              "F2: line-of-business ids from labels.")
_filter_query("filter_in", FilterSpec.of(size_groups=["$1MM - $5MM", "$5MM - $10MM"],
                                         risk_groups=["Pass", "Substandard"], banks=[3, "7", "11"],
                                         regions="Pacific", naics=["PROMO", "SMALL", "LARGE"]),
              "F3: IN on size, risk, bank (as text), region and NAICS group.")
_filter_query("filter_all_sentinel", FilterSpec.of(regions=["All"], size_groups="All", risk_groups=[],
                                                   banks=None, sba=["SBA"]),
              "F4: 'All' / empty mean no filter (only the SBA class applies).")
_filter_query("filter_ranges", FilterSpec.of(ranges=[{"min": 10000, "max": 20000, "label": "small"},
                                                     {"min": 50000.5, "max": 60000, "label": "mid"},
                                                     {"min": 90000, "max": 80000, "label": "bad"},
                                                     {"min": 1, "max": 2, "label": "  "}]),
              "F5: inclusive ranges OR-ed; inverted and unlabeled ranges skipped.")
_filter_query("filter_dates", FilterSpec.of(dates=[
    {"operator": "greaterThan", "startDate": "1997-01-31T00:00:00Z"},
    {"operator": "lessThan", "startDate": "1999-12-31T10:00:00-05:00"},
    {"operator": "between", "startDate": "1996-01-01"},
    {"operator": "equals", "startDate": "not a date"}]),
              "F6: >= and <= on the key; end-less between and bad dates skipped.")
_filter_query("filter_dates_between", FilterSpec.of(dates=[
    {"operator": "between", "startDate": "1998-01-31", "endDate": "1998-12-31T00:00:00Z"},
    {"operator": "equals", "startDate": "1998-06-30"}]),
              "F6: between AND equals.")
_filter_query("filter_residual", FilterSpec.of(residual=True),
              "F7: matured deals under 1000 outstanding dropped (NULL tests too).")
_filter_query("filter_combined", FilterSpec.of(sba=["SBA", "Non-SBA"], lob=["1", "2", "12"],
                                               regions=["Southwest", "Northeast"], residual=True,
                                               ranges=[(1000, 60000, "r")]),
              "F10: every predicate kind together.")
_filter_query("filter_contradiction", FilterSpec.of(sba=["SBA"], lob=["1", "2"]),
              "SBA with non-SBA ids: empty by construction.")


# F9's input: some of the tape's risk groups made blank, NULL or the text 'NULL', by line number.
_BLANKS = ((2, "'  '"), (3, "NULL"), (4, "'NULL'"))
_BLANKED_SQL = ("SELECT * REPLACE (CASE " + " ".join(f"WHEN DealLineNumber = {n} THEN {v}" for n, v in _BLANKS)
                + " ELSE RiskGroupDesc END AS RiskGroupDesc) FROM tape")


def _blanked(tape):
    v = F.col("RiskGroupDesc")
    for n, text in _BLANKS:
        v = F.when(F.col("DealLineNumber") == n, F.expr(f"CAST({text} AS STRING)")).otherwise(v)
    return tape.withColumn("RiskGroupDesc", v)


@register("filter_nonblank", O.with_tape(f"blanked AS ({_BLANKED_SQL})") + f"""
SELECT {_DETAIL} FROM blanked WHERE trim(coalesce(RiskGroupDesc, '')) NOT IN ('', 'NULL')""")
def q_filter_nonblank(spark, tape):
    """non-blank dimension values (blanks derived from the line number)."""
    return P.detail_columns(_blanked(tape).filter(FL.nonblank("RiskGroupDesc")))


@register("has_amount", _detail_sql("CommitmentAmt IS NOT NULL"))
def q_has_amount(spark, tape):
    """F8: rows with a commitment."""
    return P.detail_columns(tape.filter(FL.has_amount()))


@register("latest_period", _detail_sql("ProcessingDateKey = (SELECT MAX(ProcessingDateKey) FROM tape)"))
def q_latest_period(spark, tape):
    """rows of the latest period (scalar subquery)."""
    return P.detail_columns(FL.latest_period(tape))


# ============================================================ projections
@register("project", O.with_tape() + "\nSELECT ProcessingDateKey AS processingdatekey, BankID AS bankid, "
          "CommitmentAmt AS commitmentamt, Region AS REGION FROM tape")
def q_project(spark, tape):
    """Case-insensitive projection."""
    return P.project(tape, ["processingdatekey", "bankid", "commitmentamt", "REGION"])


@register("with_sba", O.with_tape() + f"\nSELECT {_DETAIL}, CASE WHEN LineofBusinessId = '12' THEN 'SBA' "
          "ELSE 'Non-SBA' END AS SBA_Classification FROM tape")
def q_with_sba(spark, tape):
    """SBA classification column."""
    return P.with_sba(P.detail_columns(tape))


@register("canonicalise", O.with_tape() + f"\nSELECT {', '.join(TAPE_COLUMNS)} FROM tape")
def q_canonicalise(spark, tape):
    """P5: lower-case database names of all columns mapped back to canonical names."""
    return P.canonicalise(tape.select(*[F.col(c).alias(c.lower()) for c in TAPE_COLUMNS]))


@register("csv_composites", O.with_tape(_TOT_A2) + "\nSELECT ProcessingDateKey, CommitmentAmt AS ca, "
          "OutstandingAmt AS oa, Deals AS deals FROM tot")
def q_csv_composites(spark, tape):
    """Series renamed from the totals."""
    return P.csv_composites(S.period_totals(tape))


# ============================================================ aggregates (A5-A18), ordering
_GQ_SPEC = FilterSpec.of(sba=["Non-SBA"], size_groups=["$1MM - $5MM", "$5MM - $10MM", "> $25MM"])
_GQ_SQL = O.with_tape() + f"""
SELECT ProcessingDateKey, LineofBusinessId, CommitmentSizeGroup, RiskGroupDesc, Region,
  COUNT(*) AS RecordCount, CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS TotalCommitment,
  CASE WHEN COUNT(CommitmentAmt) = 0 THEN NULL
       ELSE CAST(SUM(CommitmentAmt) AS DOUBLE) / CAST(COUNT(CommitmentAmt) AS DOUBLE) END AS AvgCommitment,
  MIN(CommitmentAmt) AS MinCommitment, MAX(CommitmentAmt) AS MaxCommitment
FROM tape WHERE {O.spec_sql(_GQ_SPEC)}
GROUP BY ProcessingDateKey, LineofBusinessId, CommitmentSizeGroup, RiskGroupDesc, Region
ORDER BY ProcessingDateKey DESC NULLS FIRST, TotalCommitment DESC NULLS FIRST, LineofBusinessId,
  CommitmentSizeGroup, RiskGroupDesc, Region
LIMIT 500"""


@register("grouped_query", _GQ_SQL, ("AvgCommitment",))
def q_grouped_query(spark, tape):
    """A5: five-key grouped query, largest totals first, top 500."""
    return AG.grouped_query(tape, _GQ_SPEC, 500)


@register("result_totals", f"SELECT COUNT(*) AS totalRecords, CAST(COALESCE(SUM(TotalCommitment), 0) AS "
          f"DECIMAL(38,2)) AS totalCommitment FROM (\n{_GQ_SQL}\n) g")
def q_result_totals(spark, tape):
    """Totals over the limited grouped result."""
    return AG.result_totals(AG.grouped_query(tape, _GQ_SPEC, 500))


@register("analytics_summary", O.with_tape() + """
SELECT ProcessingDateKey, Region, LineofBusinessId, LineofBusiness, CommitmentSizeGroup, RiskGroupDesc,
  COUNT(*) AS Deals, CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS CommitmentAmt,
  CAST(SUM(OutstandingAmt) AS DECIMAL(38,2)) AS OutstandingAmt,
  CAST(SUM(CommitmentAmt) AS DOUBLE) / CAST(COUNT(CommitmentAmt) AS DOUBLE) AS AvgCommitmentAmt
FROM tape WHERE CommitmentAmt IS NOT NULL
GROUP BY ProcessingDateKey, Region, LineofBusinessId, LineofBusiness, CommitmentSizeGroup, RiskGroupDesc""",
          ("AvgCommitmentAmt",))
def q_analytics_summary(spark, tape):
    """The analytics_summary view."""
    return AG.analytics_summary(tape)


@register("distinct_values", O.with_tape(f"blanked AS ({_BLANKED_SQL})") + """
SELECT DISTINCT RiskGroupDesc FROM blanked
WHERE trim(coalesce(RiskGroupDesc, '')) NOT IN ('', 'NULL') ORDER BY RiskGroupDesc""")
def q_distinct_values(spark, tape):
    """Distinct risk groups, strict form (no blanks, no 'NULL')."""
    return AG.distinct_values(_blanked(tape), "RiskGroupDesc")


@register("distinct_values_lenient", O.with_tape(f"blanked AS ({_BLANKED_SQL})") + """
SELECT DISTINCT RiskGroupDesc FROM blanked WHERE RiskGroupDesc IS NOT NULL ORDER BY RiskGroupDesc""")
def q_distinct_values_lenient(spark, tape):
    """Distinct risk groups, lenient form (only NULLs dropped)."""
    return AG.distinct_values(_blanked(tape), "RiskGroupDesc", strict=False)


@register("lob_options", O.with_tape() + """
SELECT LineofBusinessId AS id,
  'LOB ' || LineofBusinessId || CASE WHEN LineofBusinessId = '12' THEN ' (SBA)' ELSE ' (Non-SBA)' END
    AS display_name,
  COUNT(*) AS record_count
FROM tape WHERE LineofBusinessId IS NOT NULL AND LineofBusinessId <> 'NULL' AND trim(LineofBusinessId) <> ''
GROUP BY LineofBusinessId ORDER BY LineofBusinessId""")
def q_lob_options(spark, tape):
    """LOB ids with record counts and labels."""
    return AG.lob_options(tape)


@register("lob_labels", O.with_tape() + """
SELECT LineofBusinessId, LineofBusiness,
  CASE WHEN LineofBusiness IS NOT NULL AND LineofBusiness <> '' THEN LineofBusinessId || ' - ' || LineofBusiness
       ELSE LineofBusinessId END AS label
FROM (SELECT DISTINCT LineofBusinessId, LineofBusiness FROM tape WHERE LineofBusinessId IS NOT NULL) d""")
def q_lob_labels(spark, tape):
    """Distinct (id, name) labels."""
    return AG.lob_labels(tape)


_OPT_SQL_PARTS = ["SELECT 'lineOfBusiness' AS dimension, CASE WHEN LineofBusiness IS NOT NULL AND "
                  "LineofBusiness <> '' THEN LineofBusinessId || ' - ' || LineofBusiness ELSE "
                  "LineofBusinessId END AS value FROM tape WHERE LineofBusinessId IS NOT NULL"]
_OPT_SQL_PARTS += [f"SELECT '{k}', CAST({c} AS VARCHAR) FROM tape WHERE {c} IS NOT NULL"
                   for k, c in AG.OPTION_DIMENSIONS]
_OPT_SQL_PARTS += ["SELECT 'sbaClassification', 'SBA'", "SELECT 'sbaClassification', 'Non-SBA'"]


@register("filter_options", O.with_tape() + "\nSELECT DISTINCT dimension, value FROM (\n"
          + "\nUNION ALL ".join(_OPT_SQL_PARTS) + "\n) o ORDER BY dimension, value")
def q_filter_options(spark, tape):
    """A10: every filter option in one scan."""
    return AG.filter_options(tape)


@register("summary_stats", O.with_tape() + """
SELECT COUNT(*) AS total_records, COUNT(DISTINCT ProcessingDateKey) AS unique_months,
  MIN(ProcessingDateKey) AS earliest_date, MAX(ProcessingDateKey) AS latest_date,
  CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS total_commitment,
  CAST(SUM(CommitmentAmt) AS DOUBLE) / CAST(COUNT(CommitmentAmt) AS DOUBLE) AS avg_commitment,
  COUNT(DISTINCT Region) AS unique_regions, COUNT(DISTINCT LineofBusinessId) AS unique_lobs,
  COUNT(DISTINCT BankID) AS unique_banks
FROM tape WHERE CommitmentAmt IS NOT NULL""", ("avg_commitment",))
def q_summary_stats(spark, tape):
    """Whole-table statistics."""
    return AG.summary_stats(tape)


@register("summary_stats_sketched", O.with_tape() + """
SELECT COUNT(*) AS total_records, COUNT(DISTINCT ProcessingDateKey) AS unique_months,
  MIN(ProcessingDateKey) AS earliest_date, MAX(ProcessingDateKey) AS latest_date,
  CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS total_commitment,
  CAST(SUM(CommitmentAmt) AS DOUBLE) / CAST(COUNT(CommitmentAmt) AS DOUBLE) AS avg_commitment,
  TRUE AS unique_regions_close, TRUE AS unique_lobs_close, TRUE AS unique_banks_close
FROM tape WHERE CommitmentAmt IS NOT NULL""", ("avg_commitment",))
def q_summary_stats_sketched(spark, tape):
    """A11 from stored partials: built without the SBA rows, which arrive later
    for all months.  ``..._close``: the estimate lies within four standard
    errors of the exact count (``summary_stats``)."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-stored-partials-{uuid.uuid4().hex}"
    late = F.coalesce(F.col("LineofBusinessId") == "12", F.lit(False))
    PS.build_partials(tape.where(~late), path)
    PS.add_rows(tape.where(late), path)
    found = PS.stats(PS.read_partials(spark, path))
    exact = AG.summary_stats(tape)
    close = [(F.abs(F.col(c) - exact.select(c).scalar()) <= 4 * PS.standard_error() * exact.select(c).scalar()).alias(f"{c}_close")
             for c in PS.SKETCHED]
    return found.select(*[c for c in found.columns if c not in PS.SKETCHED], *close)


@register("latest_month_stats", O.with_tape() + """
SELECT ProcessingDateKey, COUNT(*) AS deals, CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS total_commitment,
  CAST(SUM(OutstandingAmt) AS DOUBLE) AS total_outstanding
FROM tape WHERE ProcessingDateKey = (SELECT MAX(ProcessingDateKey) FROM tape) GROUP BY ProcessingDateKey""",
          ("total_outstanding",))
def q_latest_month_stats(spark, tape):
    """Latest-period statistics."""
    return AG.latest_month_stats(tape)


@register("max_date", O.with_tape() + "\nSELECT MAX(ProcessingDateKey) AS max_date FROM tape")
def q_max_date(spark, tape):
    """A13."""
    return AG.max_date(tape)


@register("months_available", O.with_tape() + "\nSELECT COUNT(DISTINCT ProcessingDateKey) AS months_available "
          "FROM tape")
def q_months_available(spark, tape):
    """A14."""
    return AG.months_available(tape)


@register("table_profile", O.with_tape() + "\nSELECT COUNT(*) AS row_count, MIN(ProcessingDateKey) AS min_date, "
          "MAX(ProcessingDateKey) AS max_date FROM tape")
def q_table_profile(spark, tape):
    """A15."""
    return AG.table_profile(tape)


_ISO = "strftime(strptime(CAST({} AS VARCHAR), '%Y%m%d'), '%Y-%m-%d')"


@register("bundle_summary", O.with_tape() + f"""
SELECT CAST(COALESCE(SUM(CommitmentAmt), 0) AS DECIMAL(38,2)) AS total_commitment,
  CAST(COALESCE(SUM(OutstandingAmt), 0) AS DECIMAL(38,2)) AS total_outstanding,
  COUNT(*) AS total_deals, {_ISO.format('MAX(ProcessingDateKey)')} AS latest_period,
  {_ISO.format('MIN(ProcessingDateKey)')} AS date_start, {_ISO.format('MAX(ProcessingDateKey)')} AS date_end,
  COUNT(DISTINCT ProcessingDateKey) AS record_count
FROM tape WHERE ProcessingDateKey IS NOT NULL""")
def q_bundle_summary(spark, tape):
    """TSV bundle summary."""
    return R.dashboard_bundle(tape)["summary"]


@register("bundle_options", O.with_tape() + "\nSELECT DISTINCT dimension, value FROM (\n" + "\nUNION ALL ".join(
    f"SELECT '{k}' AS dimension, CAST({c} AS VARCHAR) AS value FROM tape WHERE {c} IS NOT NULL"
    for k, c in (("lineOfBusiness", "LineofBusiness"), ("commitmentSizeGroup", "CommitmentSizeGroup"),
                 ("riskGroup", "RiskGroupDesc"), ("bankId", "BankID"), ("region", "Region"),
                 ("naicsGrpName", "NAICSGrpName"))) + "\n) o ORDER BY dimension, value")
def q_bundle_options(spark, tape):
    """E5: TSV-path filter options."""
    return R.dashboard_bundle(tape)["filter_options"]


@register("filter_breakdown", O.with_tape() + """
SELECT LineofBusinessId, CommitmentSizeGroup, COUNT(*) AS Count FROM tape
GROUP BY LineofBusinessId, CommitmentSizeGroup ORDER BY LineofBusinessId, CommitmentSizeGroup""")
def q_filter_breakdown(spark, tape):
    """Count by LOB x size group."""
    return AG.filter_breakdown(tape)


_DQ_SPEC = FilterSpec.of(regions=["Pacific", "Southeast"], sba=["Non-SBA"],
                         ranges=[{"min": 20000, "max": 80000, "label": "mid"}])


@register("detail_query", O.with_tape() + f"""
SELECT {_DETAIL} FROM tape WHERE {O.spec_sql(_DQ_SPEC)}
ORDER BY ProcessingDateKey DESC NULLS FIRST, CommitmentAmt DESC NULLS FIRST, {', '.join(TIE_BREAK)}
LIMIT 1000""")
def q_detail_query(spark, tape):
    """O1: detail rows, newest and largest first, top 1000."""
    return AG.detail_query(tape, _DQ_SPEC, 1000, TIE_BREAK)


@register("detail_query_nulls_first", O.with_tape() + f"""
SELECT {_DETAIL} FROM tape WHERE LineofBusinessId = '12'
ORDER BY ProcessingDateKey DESC NULLS FIRST, CommitmentAmt DESC NULLS FIRST, {', '.join(TIE_BREAK)}
LIMIT 50""")
def q_detail_query_nulls_first(spark, tape):
    """O1: NULL commitments sort first within a period (PostgreSQL order)."""
    return AG.detail_query(tape, SBA, 50, TIE_BREAK)


@register("analytics_series", O.with_tape(_TOT_VIEW, _LAGS) + _VIEW_SELECT, _VIEW_DBL)
def q_analytics_series(spark, tape):
    """O3: aggregated_analytics ordered by period (no limit)."""
    return AG.analytics_series(FS.aggregated_analytics(tape))


@register("stored_periods", O.with_tape(_TOT_VIEW, _LAGS) + _VIEW_SELECT, _VIEW_DBL)
def q_stored_periods(spark, tape):
    """The stored period table, built without the SBA rows, which arrive
    later for all months; the latest month is then counted again."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens-stored-periods-{uuid.uuid4().hex}"
    late = F.coalesce(F.col("LineofBusinessId") == "12", F.lit(False))
    PT.build_periods(tape.where(~late), path)
    months = PT.add_rows(tape.where(late), path)
    PT.reload_months(tape, [m for m in months if m is not None][-1:], path)
    return PT.read_periods(spark, path).drop(PT.PERIOD)


@register("latest_periods", O.with_tape(_TOT_VIEW, _LAGS) + _VIEW_SELECT + "\nORDER BY ProcessingDateKey DESC LIMIT 3",
          _VIEW_DBL)
def q_latest_periods(spark, tape):
    """Latest three periods of the aggregated view."""
    return AG.latest_periods(FS.aggregated_analytics(tape), 3)


# ============================================================ templates (E3, E4, S9, S10), E7, W12
def _template_src_sql(templates: dict) -> str:
    parts = []
    for key, t in templates.items():
        spec = FilterSpec.from_template(t.get("filters", {}))
        parts.append(f"SELECT '{key}' AS template_id, * FROM tape WHERE {O.spec_sql(spec)}")
    return "src AS (\n" + "\nUNION ALL ".join(parts) + ")"


_E3_SQL = (O.with_tape(_template_src_sql(TP.TEMPLATES), O.composite_ctes("src", ["template_id"]), recursive=True)
           + O.result_select(["template_id"]))


@register("run_templates", _E3_SQL, E2_DBL)
def q_run_templates(spark, tape):
    """All eight templates in one scan."""
    return TP.run_templates(tape)


_CUSTOM = {"sba_classification": "Non-SBA", "region": "Pacific",
           "commitment_size_groups": ["$1MM - $5MM", "$5MM - $10MM"], "risk_group_descriptions": None}


@register("run_custom", O.with_tape(_template_src_sql({"Custom": {"filters": _CUSTOM}}),
                                    O.composite_ctes("src", ["template_id"]), recursive=True)
          + O.result_select(["template_id"]), E2_DBL)
def q_run_custom(spark, tape):
    """Ad-hoc named run."""
    return TP.run_custom(tape, _CUSTOM, "Custom")


_REPORT_VALUES = ", ".join(f"('{k}', '{t['name']}')" for k, t in TP.TEMPLATES.items())


@register("run_report", O.with_tape(_template_src_sql(TP.TEMPLATES)) + f"""
SELECT t.template_id, t.template_name, COALESCE(c.n, 0) AS row_count,
  CASE WHEN c.n > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status
FROM (VALUES {_REPORT_VALUES}) t(template_id, template_name)
LEFT JOIN (SELECT template_id, COUNT(DISTINCT ProcessingDateKey) AS n FROM src GROUP BY template_id) c
  ON t.template_id = c.template_id""")
def q_run_report(spark, tape):
    """Status and row count per template."""
    return TP.run_report(TP.run_templates(tape), TP.template_frame(spark))


_RUN_TS = "20240101_000000"


def _results_table_sql() -> str:
    import json
    vals = ", ".join(f"('{k}', '{t['name']}', '{json.dumps(t['filters'])}')" for k, t in TP.TEMPLATES.items())
    ratio = lambda c: f"CAST(round({c}, 6) AS DECIMAL(10,6)) AS {c}"
    return f"""SELECT m.template_name, strptime('{_RUN_TS}', '%Y%m%d_%H%M%S') AS run_timestamp, m.filter_params,
  CAST(r.ProcessingDateKey AS BIGINT) AS processingdatekey,
  CAST(r.CommitmentAmt AS DECIMAL(20,2)) AS commitmentamt, CAST(r.OutstandingAmt AS DECIMAL(20,2)) AS outstandingamt,
  CAST(r.Deals AS BIGINT) AS deals, {ratio('ca_diff')}, {ratio('oa_diff')}, {ratio('deals_diff')},
  {ratio('ca_model_diff')}, {ratio('oa_model_diff')}, {ratio('deals_model_diff')}
FROM (\n{_E3_SQL}\n) r JOIN (VALUES {vals}) m(template_id, template_name, filter_params)
  ON r.template_id = m.template_id"""


@register("results_table", _results_table_sql())
def q_results_table(spark, tape):
    """S6 + S9: template results with run metadata, conformed to the results table."""
    res = TP.with_run_metadata(TP.run_templates(tape), TP.template_frame(spark), _RUN_TS)
    res = res.withColumn("run_timestamp", F.to_timestamp_ntz(F.col("run_timestamp"), F.lit("yyyyMMdd_HHmmss")))
    return TP.to_results_table(res, with_created_at=False)


_CAPS = (0.05, 0.1, 0.2)


@register("cap_sensitivity", O.with_tape(
    "src AS (SELECT c.cap_value, t.* FROM tape t CROSS JOIN (VALUES "
    + ", ".join(f"({O.dbl(c)})" for c in _CAPS) + ") c(cap_value))",
    O.composite_ctes("src", ["cap_value"], hi="cap_value"), recursive=True)
    + "\nSELECT cap_value, ProcessingDateKey, ca, oa, deals FROM compw", ("cap_value", "ca", "oa", "deals"))
def q_cap_sensitivity(spark, tape):
    """Composite for MoM caps 5 %, 10 %, 20 %."""
    return A.cap_sensitivity(tape, _CAPS)


_BANKS = [str(i) for i in range(25)]   # the columns of the oracle; the query takes its banks from the tape


def _wide_sql():
    cols = []
    for b in _BANKS:
        w = f"BankID = '{b}'"
        cols += [f'MAX(CASE WHEN {w} THEN value END) AS "{b}"',
                 f'MAX(CASE WHEN {w} THEN perc_diff_raw END) AS "{b}_perc_diff_raw"',
                 f'COALESCE(CAST(MAX(CASE WHEN {w} THEN CAST(inc AS INTEGER) END) AS BOOLEAN), FALSE) AS "{b}_inc"',
                 f'MAX(CASE WHEN {w} THEN perc_diff END) AS "{b}_perc_diff"',
                 f'MAX(CASE WHEN {w} THEN mod_v END) AS "{b}_mod"']
    return (O.with_tape(_filtered_sql(), O.composite_ctes("src"), recursive=True)
            + f""",
wide AS (SELECT ProcessingDateKey, {', '.join(cols)} FROM chain WHERE metric = 'ca' GROUP BY ProcessingDateKey)
SELECT w.*, l.lim_max, l.lim_min, c.perc_diff FROM wide w
JOIN lims l ON l.metric = 'ca' AND l.ProcessingDateKey = w.ProcessingDateKey
JOIN comp c ON c.metric = 'ca' AND c.ProcessingDateKey = w.ProcessingDateKey""")


_WIDE_DBL = tuple([f"{b}{s}" for b in _BANKS for s in ("", "_perc_diff_raw", "_perc_diff", "_mod")]
                  + ["lim_max", "lim_min", "perc_diff"])


@register("wide_panel", _wide_sql(), _WIDE_DBL)
def q_wide_panel(spark, tape):
    """The original application's wide commitment panel (one column set per bank)."""
    cells = A.reduced_cells(tape)
    return C.wide_panel(C.composite_parts(cells), C.bank_ids(tape), "ca")


@register("panel_long", O.with_tape(_filtered_sql(), O.composite_ctes("src"), recursive=True) + """,
places AS (SELECT BankID, ROW_NUMBER() OVER (ORDER BY length(BankID), BankID) AS bank_pos
           FROM (SELECT DISTINCT BankID FROM chain WHERE BankID IS NOT NULL) b)
SELECT h.metric, h.ProcessingDateKey, h.BankID, h.value, h.perc_diff_raw, h.inc, h.perc_diff, h.mod_v AS mod,
  CAST(p.bank_pos AS INTEGER) AS bank_pos, l.lim_max, l.lim_min, c.perc_diff AS composite
FROM chain h LEFT JOIN places p ON p.BankID = h.BankID
JOIN lims l ON l.metric = h.metric AND l.ProcessingDateKey = h.ProcessingDateKey
JOIN comp c ON c.metric = h.metric AND c.ProcessingDateKey = h.ProcessingDateKey""",
          ("value", "perc_diff_raw", "perc_diff", "mod", "lim_max", "lim_min", "composite"))
def q_panel_long(spark, tape):
    """W12 for all three metrics, one row per metric, period and bank."""
    return C.panel_long(C.composite_parts(A.reduced_cells(tape)))


# ============================================================ record-level change
_RP_ORDER = ["ProcessingDateKey", *TIE_BREAK]


@register("record_pop", O.with_tape() + f"""
SELECT {', '.join(_RP_ORDER)}, CommitmentAmt, OutstandingAmt,
  CASE WHEN rn = 1 THEN 0.0 WHEN pc IS NULL OR CommitmentAmt IS NULL THEN NULL WHEN pc = 0 THEN 0.0
       ELSE (CAST(CommitmentAmt AS DOUBLE) - CAST(pc AS DOUBLE)) / CAST(pc AS DOUBLE) END AS ca_perc_diff,
  CASE WHEN rn = 1 THEN 0.0 WHEN po IS NULL OR OutstandingAmt IS NULL THEN NULL WHEN po = 0 THEN 0.0
       ELSE (CAST(OutstandingAmt AS DOUBLE) - CAST(po AS DOUBLE)) / CAST(po AS DOUBLE) END AS oa_perc_diff
FROM (SELECT *, ROW_NUMBER() OVER w AS rn, LAG(CommitmentAmt) OVER w AS pc, LAG(OutstandingAmt) OVER w AS po
      FROM tape WINDOW w AS (ORDER BY {', '.join(_RP_ORDER)})) x""", ("ca_perc_diff", "oa_perc_diff"))
def q_record_pop(spark, tape):
    """Record-level change over the whole tape, range-partitioned."""
    return S.record_pop(tape, _RP_ORDER)


# ============================================================ scalars
_TOT_DATES = O.with_tape(_TOT_A2)


@register("date_label", _TOT_DATES + """
SELECT ProcessingDateKey,
  strftime(d, '%b') || ' ' || CAST(day(d) AS VARCHAR) || ', ' || CAST(year(d) AS VARCHAR) AS long_label,
  strftime(d, '%b') || ' ' || lpad(CAST(year(d) % 100 AS VARCHAR), 2, '0') AS short_label,
  strftime(d, '%B') || ' ' || CAST(year(d) AS VARCHAR) AS month_label,
  strftime(d, '%b') || ' ' || CAST(year(d) AS VARCHAR) AS month_short_label,
  strftime(d, '%Y-%m-%d') AS iso, CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INTEGER) AS round_trip,
  CAST(strftime(d, '%Y%m%d') AS INTEGER) AS iso_key,
  strftime(d, '%b') || ' ' || CAST(day(d) AS VARCHAR) || ', ' || CAST(year(d) AS VARCHAR) AS iso_label,
  'N/A' AS zero_label
FROM (SELECT ProcessingDateKey, CAST(strptime(CAST(ProcessingDateKey AS VARCHAR), '%Y%m%d') AS DATE) AS d
      FROM tot) x""")
def q_date_label(spark, tape):
    """C1 + C10: key <-> date and the three display labels."""
    t = S.period_totals(tape)
    return t.select("ProcessingDateKey",
                    X.date_label("ProcessingDateKey", "long").alias("long_label"),
                    X.date_label("ProcessingDateKey", "short").alias("short_label"),
                    X.date_label("ProcessingDateKey", "month").alias("month_label"),
                    X.date_label("ProcessingDateKey", "month_short").alias("month_short_label"),
                    X.key_to_iso("ProcessingDateKey").alias("iso"),
                    X.date_to_key(X.key_to_date("ProcessingDateKey")).alias("round_trip"),
                    X.iso_to_key(X.key_to_iso("ProcessingDateKey")).alias("iso_key"),
                    X.date_label(X.key_to_iso("ProcessingDateKey"), "long").alias("iso_label"),
                    X.date_label(F.lit(0), "long").alias("zero_label"))


def _fixed_sql(x: str, places: int) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,{places})) AS VARCHAR)"


def _human_sql(x: str, style: str) -> str:
    x = f"CAST({x} AS DECIMAL(38,6))"
    if style == "table":
        return (f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN abs({x}) > 1000000 THEN {_fixed_sql(x + ' / 1000000', 2)} || 'M' "
                f"WHEN abs({x}) > 1000 THEN {_fixed_sql(x + ' / 1000', 2)} || 'K' ELSE {_fixed_sql(x, 2)} END")
    if style == "chart":
        return (f"CASE WHEN abs({x}) > 1000000000 THEN {_fixed_sql(x + ' / 1000000000', 1)} || 'B' "
                f"WHEN abs({x}) > 1000000 THEN {_fixed_sql(x + ' / 1000000', 1)} || 'M' "
                f"WHEN abs({x}) > 1000 THEN {_fixed_sql(x + ' / 1000', 1)} || 'K' "
                f"WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) "
                f"ELSE regexp_replace(CAST({x} AS VARCHAR), '0+$', '') END")
    if style == "range":
        return (f"CASE WHEN {x} >= 1000000 THEN '$' || {_fixed_sql(x + ' / 1000000', 1)} || 'M' "
                f"WHEN {x} >= 1000 THEN '$' || {_fixed_sql(x + ' / 1000', 1)} || 'K' "
                f"WHEN {x} = floor({x}) THEN '$' || CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) "
                f"ELSE '$' || regexp_replace(CAST(CAST({x} AS DECIMAL(38,3)) AS VARCHAR), '0+$', '') END")
    if style == "usd":
        return (f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || "
                f"format('{{:,}}', CAST(abs(CAST({x} AS DECIMAL(38,0))) AS HUGEINT))")
    if style == "compact":
        units = (("999950000000", "1000000000000", "T"), ("999950000", "1000000000", "B"), ("999950", "1000000", "M"),
                 ("999.95", "1000", "K"))
        part = lambda u: f"regexp_replace({_fixed_sql(f'abs({x}) / {u}', 1)}, '[.]0$', '')"
        cases = " ".join(f"WHEN abs({x}) >= {least} THEN {part(u)} || '{mark}'" for least, u, mark in units)
        return f"CASE WHEN {x} < 0 THEN '-$' ELSE '$' END || CASE {cases} ELSE {part('1')} END"
    raise ValueError(style)


@register("human_number", _TOT_DATES + f"""
SELECT ProcessingDateKey,
  {_human_sql('CommitmentAmt', 'table')} AS ca_table, {_human_sql('Deals', 'table')} AS deals_table,
  {_human_sql('OutstandingAmt / 1000', 'table')} AS oa_table_small,
  {_human_sql('CommitmentAmt', 'chart')} AS ca_chart, {_human_sql('Deals', 'chart')} AS deals_chart,
  {_human_sql('OutstandingAmt / 7', 'chart')} AS oa_chart_frac,
  {_human_sql('CommitmentAmt * 1000', 'chart')} AS ca_chart_big,
  {_human_sql('CommitmentAmt', 'range')} AS ca_range, {_human_sql('Deals', 'range')} AS deals_range,
  {_human_sql('CommitmentAmt', 'usd')} AS ca_usd, {_human_sql('-OutstandingAmt', 'usd')} AS oa_usd_neg,
  {_human_sql('CommitmentAmt', 'compact')} AS ca_compact, {_human_sql('-OutstandingAmt * 1000', 'compact')} AS oa_compact_neg,
  {_human_sql('Deals', 'compact')} AS deals_compact,
  {_human_sql('CommitmentAmt / 1000', 'range')} || ' - ' || {_human_sql('CommitmentAmt', 'range')} AS range_label
FROM tot""")
def q_human_number(spark, tape):
    """Compact number styles (table, chart, range, usd, compact)."""
    t = S.period_totals(tape)
    c, d, o = F.col("CommitmentAmt"), F.col("Deals"), F.col("OutstandingAmt")
    return t.select("ProcessingDateKey",
                    X.human_number(c, "table").alias("ca_table"), X.human_number(d, "table").alias("deals_table"),
                    X.human_number(o / 1000, "table").alias("oa_table_small"),
                    X.human_number(c, "chart").alias("ca_chart"), X.human_number(d, "chart").alias("deals_chart"),
                    X.human_number(o / 7, "chart").alias("oa_chart_frac"),
                    X.human_number(c * 1000, "chart").alias("ca_chart_big"),
                    X.human_number(c, "range").alias("ca_range"), X.human_number(d, "range").alias("deals_range"),
                    X.human_number(c, "usd").alias("ca_usd"), X.human_number(-o, "usd").alias("oa_usd_neg"),
                    X.human_number(c, "compact").alias("ca_compact"), X.human_number(-o * 1000, "compact").alias("oa_compact_neg"),
                    X.human_number(d, "compact").alias("deals_compact"),
                    X.range_label(c / 1000, c).alias("range_label"))


def _pct_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' ELSE "
            f"CAST(CAST(CAST({x} * 100 AS DECIMAL(38,10)) AS DECIMAL(38,2)) AS VARCHAR) || '%' END")


def _sign_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'none' WHEN {x} >= 0 THEN 'positive' ELSE 'negative' END"


@register("percent_text", O.with_tape(_TOT_A2, _LAGS) + f"""
SELECT ProcessingDateKey, {_pct_sql('d')} AS ca_pct, {_sign_sql('d')} AS ca_sign
FROM (SELECT ProcessingDateKey, {_chg('CommitmentAmt', 'CommitmentAmtPrior')} AS d FROM lagged) x""")
def q_percent_text(spark, tape):
    """Percent text and sign class of the monthly change."""
    p = S.pop_change(S.period_totals(tape), "core")
    return p.select("ProcessingDateKey", X.percent_text("ca_diff").alias("ca_pct"),
                    X.sign_class("ca_diff").alias("ca_sign"))


_AS_OF = "2001-09-15"


def _freshness_sql(where: str) -> str:
    return O.with_tape() + f"""
SELECT BankID, latest, CASE WHEN latest IS NULL THEN 'No data'
  WHEN CAST(strptime(CAST(latest AS VARCHAR), '%Y%m%d') AS DATE) >= CAST(DATE '{_AS_OF}' - INTERVAL 1 MONTH AS DATE)
  THEN 'Fresh' ELSE 'Stale' END AS freshness
FROM (SELECT BankID, MAX(ProcessingDateKey) AS latest FROM tape WHERE {where} GROUP BY BankID) b"""


def _freshness(tape):
    b = tape.groupBy("BankID").agg(F.max("ProcessingDateKey").alias("latest"))
    return b.select("BankID", "latest", X.freshness(F.col("latest"), _AS_OF).alias("freshness"))


@register("freshness", _freshness_sql("TRUE"))
def q_freshness(spark, tape):
    """C11: freshness of each bank's latest period as of a fixed date."""
    return _freshness(tape)


@register("freshness_sba", _freshness_sql("LineofBusinessId = '12'"))
def q_freshness_sba(spark, tape):
    """C11: freshness of each bank's latest SBA period."""
    return _freshness(tape.filter(F.col("LineofBusinessId") == "12"))


@register("to_amount", O.with_tape() + f"""
SELECT {', '.join(TIE_BREAK)}, CAST(CommitmentAmt AS DOUBLE) AS ca_lenient,
  CASE WHEN DealLineNumber = 3 THEN NULL ELSE CAST(OutstandingAmt AS DOUBLE) END AS oa_lenient,
  CAST(OutstandingAmt AS DOUBLE) AS oa_strict
FROM tape""", ("ca_lenient", "oa_lenient", "oa_strict"))
def q_to_amount(spark, tape):
    """Text amounts with 'NULL' tokens and junk -> double."""
    txt_ca = F.when(F.col("CommitmentAmt").isNull(), F.lit("NULL")).otherwise(F.col("CommitmentAmt").cast("string"))
    txt_oa = F.when(F.col("DealLineNumber") == 3, F.lit("n/a")).otherwise(F.col("OutstandingAmt").cast("string"))
    return tape.select(*TIE_BREAK, X.to_amount(txt_ca).alias("ca_lenient"), X.to_amount(txt_oa).alias("oa_lenient"),
                       X.to_amount(F.col("OutstandingAmt").cast("string"), strict=True).alias("oa_strict"))


@register("finite", O.with_tape() + f"""
SELECT {', '.join(TIE_BREAK)}, CASE WHEN OutstandingAmt = 0 THEN NULL
  ELSE CAST(CommitmentAmt AS DOUBLE) / CAST(OutstandingAmt AS DOUBLE) END AS ratio FROM tape""", ("ratio",))
def q_finite(spark, tape):
    """IEEE ratio (+-Inf / NaN on a zero divisor) made finite (NULL)."""
    ca, oa = F.col("CommitmentAmt").cast("double"), F.col("OutstandingAmt").cast("double")
    ieee = (F.when(oa == 0, F.when(ca.isNull() | (ca == 0), F.lit(float("nan")))
                             .otherwise(F.lit(float("inf")) * F.signum(ca)))
             .otherwise(F.try_divide(ca, oa)))
    return tape.select(*TIE_BREAK, X.finite(ieee).alias("ratio"))


@register("key_text", O.with_tape(_TOT_A2, _LAGS) + """
SELECT CAST(ProcessingDateKey AS VARCHAR) AS ProcessingDateKey,
  CASE WHEN pk IS NULL OR pk = 0 THEN '0' ELSE CAST(pk AS VARCHAR) END AS ProcessingDateKeyPrior,
  CAST(CommitmentAmt AS DOUBLE) AS CommitmentAmt FROM lagged""", ("CommitmentAmt",))
def q_key_text(spark, tape):
    """C12 + C13: keys as text (prior '0'), decimals as double."""
    p = S.with_prior(S.period_totals(tape))
    return p.select(X.key_text("ProcessingDateKey").alias("ProcessingDateKey"),
                    X.key_text("ProcessingDateKeyPrior").alias("ProcessingDateKeyPrior"),
                    X.to_double("CommitmentAmt").alias("CommitmentAmt"))


# ============================================================ reports (E6, E8, E9), cleaning
#: A tape row told apart by its deal keys, with what the filters look at.
_ESSENTIAL = ["DealOrderKey", "DealLineNumber", "BankID", "ProcessingDateKey", "CurrentMaturityDateKey", "LineofBusinessId",
              "Region", "RiskGroupDesc", "CommitmentAmt", "OutstandingAmt"]


@register("tape_query", O.with_tape() + f"""
SELECT {', '.join(_ESSENTIAL)}, CASE WHEN LineofBusinessId = '12' THEN 'SBA' ELSE 'Non-SBA' END AS SBA_Classification
FROM tape WHERE Region = 'Rocky Mountain' AND LineofBusinessId <> '12'
  AND NOT (CurrentMaturityDateKey < ProcessingDateKey AND CAST(OutstandingAmt AS DOUBLE) < 1000.0)""")
def q_tape_query(spark, tape):
    """The flexible tape query with its defaults (whole result, no row cap)."""
    return R.tape_query(tape, columns=_ESSENTIAL, limit=None)


@register("tape_query_lob", O.with_tape() + f"""
SELECT {', '.join(_ESSENTIAL)}, CASE WHEN LineofBusinessId = '12' THEN 'SBA' ELSE 'Non-SBA' END AS SBA_Classification
FROM tape WHERE Region = 'Southwest' AND LineofBusinessId IN ('1', '2', '3')
  AND CommitmentSizeGroup IN ('< $250K', '$250K - $1MM') AND RiskGroupDesc IN ('Pass')
  AND NOT (CurrentMaturityDateKey < ProcessingDateKey AND CAST(OutstandingAmt AS DOUBLE) < 1000.0)""")
def q_tape_query_lob(spark, tape):
    """E6 with every optional filter (all SBA classes)."""
    return R.tape_query(tape, region="Southwest", sba="All", lob=["1", "2", "3"],
                        sizes=["< $250K", "$250K - $1MM"], risks="Pass", columns=_ESSENTIAL, limit=None)


def _report_sql(source: str, date_format: str, prior_none: str, models: bool) -> str:
    def lab(x, style):
        d = f"CAST(strptime(CAST({x} AS VARCHAR), '{date_format}') AS DATE)"
        body = {"long": f"strftime({d}, '%b') || ' ' || CAST(day({d}) AS VARCHAR) || ', ' || CAST(year({d}) AS VARCHAR)",
                "short": f"strftime({d}, '%b') || ' ' || lpad(CAST(year({d}) % 100 AS VARCHAR), 2, '0')",
                "month": f"strftime({d}, '%B') || ' ' || CAST(year({d}) AS VARCHAR)"}[style]
        return f"CASE WHEN {x} IS NULL OR {x} = {prior_none} THEN 'N/A' ELSE {body} END"

    def idx(c):
        return (f"CASE WHEN rn = 1 THEN 100.0 WHEN FIRST_VALUE({c}) OVER w IS NULL OR FIRST_VALUE({c}) OVER w <= 0 "
                f"THEN 100.0 ELSE CAST({c} AS DOUBLE) / CAST(FIRST_VALUE({c}) OVER w AS DOUBLE) * 100 END")
    cols = [f"{lab('ProcessingDateKey', 'long')} AS period", f"{lab('ProcessingDateKey', 'short')} AS chart_date",
            f"{lab('ProcessingDateKey', 'month')} AS chart_full_date", f"{lab('ProcessingDateKeyPrior', 'long')} AS prior_period"]
    for col, name in (("CommitmentAmt", "commitment"), ("Deals", "deals"), ("OutstandingAmt", "outstanding")):
        cols += [f"{_human_sql(col, 'table')} AS {name}", f"{_human_sql(col + 'Prior', 'table')} AS {name}_prior",
                 f"CAST({col} AS DOUBLE) AS chart_{name}"]
    for m in ("ca", "oa", "deals"):
        for col, name, there in ((f"{m}_diff", f"{m}_diff", True), (f"{m}_model_diff", f"{m}_model", models)):
            v = col if there else "CAST(NULL AS DOUBLE)"
            cols += [f"{_pct_sql(v)} AS {name}_text", f"{_sign_sql(v)} AS {name}_class", f"{v} * 100 AS {name}_pct"]
    cols += [f"{idx(c)} AS {n}" for c, n in (("CommitmentAmt", "commitmentIndex"), ("OutstandingAmt", "outstandingIndex"),
                                             ("Deals", "dealsIndex"))]
    return f"""SELECT ProcessingDateKey, {', '.join(cols)}
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ProcessingDateKey) AS rn FROM (\n{source}\n) e) r
WINDOW w AS (ORDER BY ProcessingDateKey)"""


_REPORT_DBL = tuple([f"{m}{k}_pct" for m in ("ca", "oa", "deals") for k in ("_diff", "_model")]
                    + ["commitmentIndex", "outstandingIndex", "dealsIndex", "chart_commitment", "chart_deals", "chart_outstanding"])


@register("report_view", _report_sql(
    O.with_tape(_filtered_sql(), O.composite_ctes("src"), recursive=True) + O.result_select(), "%Y%m%d", "0", True), _REPORT_DBL)
def q_report_view(spark, tape):
    """Formatted report rows + chart series of the capped analysis."""
    return R.report_view(A.capped_vs_uncapped(tape))


@register("report_view_tsv", _report_sql(_POP_TSV_SQL, "%Y-%m-%d", "'0'", False), _REPORT_DBL)
def q_report_view_tsv(spark, tape):
    """E8 over the monthly series of the TSV path (ISO keys, no model changes)."""
    return R.report_view(S.pop_change(S.period_totals(tape, deals="bank"), "tsv"))


@register("status_panel", O.with_tape() + f"""
SELECT total_records AS record_count,
  strftime(d, '%b') || ' ' || CAST(year(d) AS VARCHAR) AS latest_period, total_commitment,
  {_human_sql('total_commitment', 'compact')} AS total_commitment_text,
  CASE WHEN d IS NULL THEN 'No data' WHEN date_trunc('month', d) >= CAST(DATE '{_AS_OF}' - INTERVAL 1 MONTH AS DATE) THEN 'Fresh'
       ELSE 'Stale' END AS freshness
FROM (SELECT COUNT(*) AS total_records, CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS total_commitment,
        CAST(strptime(CAST(MAX(ProcessingDateKey) AS VARCHAR), '%Y%m%d') AS DATE) AS d
      FROM tape WHERE CommitmentAmt IS NOT NULL) s""")
def q_status_panel(spark, tape):
    """Status panel as of a fixed date."""
    return R.status_panel(tape, _AS_OF)


# S2's input: every third deal line has junk in its amount, every fifth line number in a strict integer column, every
# seventh part no processing date; -1 stands for an open maturity.
_JUNK = {"CommitmentAmt": ("DealLineNumber % 3 = 0", "12,5 USD"), "size_SortOrder": ("DealLineNumber % 5 = 0", "n/a"),
         "ProcessingDateKey": ("DealPartKey % 7 = 0", " ")}


@register("clean_tape", O.with_tape() + "\nSELECT " + ", ".join(
    "CASE WHEN DealLineNumber % 3 = 0 THEN NULL ELSE CommitmentAmt END AS CommitmentAmt" if c == "CommitmentAmt" else c
    for c in TAPE_COLUMNS) + " FROM tape WHERE DealLineNumber % 5 <> 0 AND DealPartKey % 7 <> 0")
def q_clean_tape(spark, tape):
    """The tape written as text with NULL tokens, junk amounts, bad
    integers, blank keys and -1 maturities, then cleaned to typed columns."""
    toks = F.element_at(F.array(F.lit("NULL"), F.lit("null"), F.lit("")),
                        (F.col("DealOrderKey") % 3 + 1).cast("int"))
    txt = []
    for c in TAPE_COLUMNS:
        v = F.coalesce(F.col(c).cast("string"), F.lit("-1") if c == "CurrentMaturityDateKey" else toks)
        if c in _JUNK:
            v = F.when(F.expr(_JUNK[c][0]), F.lit(_JUNK[c][1])).otherwise(v)
        txt.append(v.alias(c.lower() if c in ("Region", "BankID") else c))
    return FS.clean_tape(tape.select(*txt))


# ============================================================ composites with the tape-query defaults
_API_SPEC = FilterSpec.of(regions="Rocky Mountain", sba=["Non-SBA"], residual=True)


@register("composites_tape_defaults",
          O.with_tape(_filtered_sql(O.spec_sql(_API_SPEC)), O.composite_ctes("src"), recursive=True)
          + "\nSELECT ProcessingDateKey, ca, oa, deals FROM compw", ("ca", "oa", "deals"))
def q_composites_tape_defaults(spark, tape):
    """E1 over the tape query's defaults (region, Non-SBA, residual filter)."""
    return C.composites(apply_filters(tape, _API_SPEC))
