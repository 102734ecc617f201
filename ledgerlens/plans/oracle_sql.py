"""DuckDB SQL for the correctness gate.

Written independently of the Spark plans: window SQL for the cap and the
limits, and a recursive CTE that steps each bank through its months for
the clamp.  Every oracle starts from ``TAPE_CTE``.
"""

from __future__ import annotations

from typing import Sequence

from ..config import HIGH_BREACH_PERC, MAX_BANK_CELL_WEIGHT, MAX_MOM, MAX_MOM_HIGH
from ..sources.tape import TAPE_CTE


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


class Scope:
    """Helpers to splice optional scope columns into SQL."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def lead(self, alias: str = "") -> str:
        """``a.s1, a.s2, `` or empty."""
        p = f"{alias}." if alias else ""
        return "".join(f"{p}{c}, " for c in self.cols)

    def part(self, *extra: str, alias: str = "") -> str:
        p = f"{alias}." if alias else ""
        items = [f"{p}{c}" for c in self.cols] + [f"{p}{e}" for e in extra]
        return f"PARTITION BY {', '.join(items)}" if items else ""

    def eq(self, a: str, b: str) -> str:
        return "".join(f"{a}.{c} = {b}.{c} AND " for c in self.cols)


def composite_ctes(src: str, scope: Sequence[str] = (), missing: str = "exclude",
                   lim: float = MAX_BANK_CELL_WEIGHT, hi: str | None = None,
                   hi_high: float = MAX_MOM_HIGH, hbp: float = HIGH_BREACH_PERC) -> str:
    """CTEs ``cells panel capped dates nb raw lims chain comp`` from the
    filtered rows ``src`` (which carries the scope columns)."""
    s = Scope(scope)
    S = s.lead()
    hi = hi or dbl(MAX_MOM)
    lo = f"(-({hi}) / (1 + {hi}))"
    hih = dbl(hi_high)
    loh = f"(-({hih}) / (1 + {hih}))"
    L = dbl(lim)
    nb_join = (f"JOIN nb ON {s.eq('c', 'nb')[:-5]}" if scope else "CROSS JOIN nb")
    nb_join_g = (f"JOIN nb ON {s.eq('g', 'nb')[:-5]}" if scope else "CROSS JOIN nb")
    nan = missing == "nan"
    actual = "n_banks" if nan else "n_valid"
    n_hi = "(n_hi + n_banks - n_valid)" if nan else "n_hi"
    nan_gap = (f"WHEN g.n_present < nb.n_banks OR LAG(g.n_present) OVER ({s.part('metric', alias='g')} "
               f"ORDER BY g.ProcessingDateKey) < nb.n_banks THEN NULL" if nan else "")
    return f"""
cells AS (
  SELECT {S}ProcessingDateKey, BankID,
    CAST(SUM(COALESCE(CommitmentAmt, 0)) AS DECIMAL(38,2)) AS CommitmentAmt,
    COUNT(*) AS Deals,
    CAST(SUM(COALESCE(OutstandingAmt, 0)) AS DECIMAL(38,2)) AS OutstandingAmt,
    COUNT(CommitmentAmt) AS DealsWithAmount
  FROM {src} GROUP BY {S}ProcessingDateKey, BankID),
panel AS (
  SELECT {S}'ca' AS metric, ProcessingDateKey, BankID, CAST(CommitmentAmt AS DECIMAL(38,2)) AS amt FROM cells
  UNION ALL SELECT {S}'oa', ProcessingDateKey, BankID, CAST(OutstandingAmt AS DECIMAL(38,2)) FROM cells
  UNION ALL SELECT {S}'deals', ProcessingDateKey, BankID, CAST(Deals AS DECIMAL(38,2)) FROM cells),
shares AS (
  SELECT *, CAST(SUM(amt) OVER ({s.part('metric', 'ProcessingDateKey')}) AS DOUBLE) AS s FROM panel),
shares2 AS (
  SELECT *, CASE WHEN s = 0 THEN NULL ELSE CAST(amt AS DOUBLE) / s END AS perc FROM shares),
shares3 AS (
  SELECT *, MAX(perc) OVER ({s.part('metric', 'ProcessingDateKey')}) AS mx FROM shares2),
capped AS (
  SELECT {S}metric, ProcessingDateKey, BankID, amt, s AS "Sum", perc AS "Perc", mx AS "Max",
    CASE WHEN mx > {L} AND mx < 1.0 THEN
           CASE WHEN perc = mx THEN s * {L} ELSE (1 - {L}) * CAST(amt AS DOUBLE) / (1 - mx) END
         ELSE CAST(amt AS DOUBLE) END AS v
  FROM shares3),
dates AS (
  SELECT {S}ProcessingDateKey,
    LAG(ProcessingDateKey) OVER ({s.part()} ORDER BY ProcessingDateKey) AS PrevDateKey
  FROM (SELECT DISTINCT {S}ProcessingDateKey FROM cells) dd),
nb AS (
  SELECT {S}COUNT(DISTINCT BankID) AS n_banks FROM cells {('GROUP BY ' + ', '.join(scope)) if scope else ''}),
rawb AS (
  SELECT c.*, d.PrevDateKey, nb.n_banks,
    LAG(c.ProcessingDateKey) OVER ({s.part('metric', 'BankID', alias='c')} ORDER BY c.ProcessingDateKey) AS bprev_d,
    LAG(c.v) OVER ({s.part('metric', 'BankID', alias='c')} ORDER BY c.ProcessingDateKey) AS bprev_v
  FROM capped c JOIN dates d ON {s.eq('c', 'd')}c.ProcessingDateKey = d.ProcessingDateKey
  {nb_join}),
raw AS (
  SELECT *, CASE WHEN bprev_d = PrevDateKey AND bprev_v <> 0 THEN v / bprev_v - 1 END AS perc_diff_raw
  FROM rawb),
limg AS (
  SELECT {S}metric, ProcessingDateKey,
    COUNT(perc_diff_raw) AS n_valid,
    COUNT(*) FILTER (WHERE perc_diff_raw > {hi}) AS n_hi,
    COUNT(*) FILTER (WHERE perc_diff_raw < {lo}) AS n_lo,
    MAX(n_banks) AS n_banks
  FROM raw GROUP BY {S}metric, ProcessingDateKey),
limp AS (
  SELECT {S}metric, ProcessingDateKey,
    {actual} AS actual_data, {n_hi} AS num_breaches_max, n_lo AS num_breaches_min,
    CASE WHEN {actual} = 0 THEN 0.0 ELSE CAST({n_hi} AS DOUBLE) / CAST({actual} AS DOUBLE) END AS perc_breaches_max,
    CASE WHEN {actual} = 0 THEN 0.0 ELSE CAST(n_lo AS DOUBLE) / CAST({actual} AS DOUBLE) END AS perc_breaches_min
  FROM limg),
lims AS (
  SELECT *,
    CASE WHEN perc_breaches_max >= {dbl(hbp)} THEN {hih} ELSE {hi} END AS lim_max,
    CASE WHEN perc_breaches_min >= {dbl(hbp)} THEN {loh} ELSE {lo} END AS lim_min
  FROM limp),
bc AS (
  SELECT {s.lead('r')}r.metric, r.BankID, r.ProcessingDateKey, r.PrevDateKey, r.v, r.perc_diff_raw,
    l.lim_max, l.lim_min,
    ROW_NUMBER() OVER ({s.part('metric', 'BankID', alias='r')} ORDER BY r.ProcessingDateKey) AS k
  FROM raw r JOIN lims l ON {s.eq('r', 'l')}r.metric = l.metric AND r.ProcessingDateKey = l.ProcessingDateKey),
chain AS (
  SELECT {S}metric, BankID, k, ProcessingDateKey, v AS value, perc_diff_raw,
    CAST(NULL AS DOUBLE) AS perc_diff, v AS mod_v, CAST(NULL AS DOUBLE) AS prev_mod, FALSE AS inc
  FROM bc WHERE k = 1
  UNION ALL
  SELECT {s.lead('n')}n.metric, n.BankID, n.k, n.ProcessingDateKey, n.v, n.perc_diff_raw,
    CASE WHEN n.PrevDateKey = c.ProcessingDateKey AND c.mod_v <> 0
         THEN greatest(least(n.v / c.mod_v - 1, n.lim_max), n.lim_min) END,
    CASE WHEN n.PrevDateKey = c.ProcessingDateKey AND c.mod_v <> 0
         THEN c.mod_v * (1 + greatest(least(n.v / c.mod_v - 1, n.lim_max), n.lim_min)) ELSE n.v END,
    CASE WHEN n.PrevDateKey = c.ProcessingDateKey AND c.mod_v <> 0 THEN c.mod_v END,
    COALESCE(n.PrevDateKey = c.ProcessingDateKey AND c.mod_v <> 0, FALSE)
  FROM chain c JOIN bc n
    ON {s.eq('c', 'n')}n.metric = c.metric AND n.BankID = c.BankID AND n.k = c.k + 1),
compg AS (
  SELECT {S}metric, ProcessingDateKey,
    SUM(CASE WHEN inc THEN mod_v END) AS curr_sum,
    SUM(CASE WHEN inc THEN prev_mod END) AS prior_sum,
    COUNT(*) AS n_present
  FROM chain GROUP BY {S}metric, ProcessingDateKey),
comp AS (
  SELECT {s.lead('g')}g.metric, g.ProcessingDateKey, g.curr_sum, g.prior_sum,
    CASE WHEN d.PrevDateKey IS NULL THEN NULL
         WHEN g.prior_sum IS NULL OR g.prior_sum = 0 OR g.curr_sum IS NULL THEN NULL
         {nan_gap}
         ELSE g.curr_sum / g.prior_sum - 1 END AS perc_diff
  FROM compg g JOIN dates d ON {s.eq('g', 'd')}g.ProcessingDateKey = d.ProcessingDateKey
  {nb_join_g}),
compw AS (
  SELECT {S}ProcessingDateKey,
    MAX(CASE WHEN metric = 'ca' THEN perc_diff END) AS ca,
    MAX(CASE WHEN metric = 'oa' THEN perc_diff END) AS oa,
    MAX(CASE WHEN metric = 'deals' THEN perc_diff END) AS deals
  FROM comp GROUP BY {S}ProcessingDateKey)"""


def result_select(scope: Sequence[str] = ()) -> str:
    """E2's final SELECT over ``cells`` and ``compw``."""
    s = Scope(scope)
    S = s.lead()
    def diff(cur, prior):
        return (f"CASE WHEN {prior} IS NULL OR {prior} = 0 THEN NULL "
                f"ELSE CAST({cur} AS DOUBLE) / CAST({prior} AS DOUBLE) - 1 END")
    return f""",
tot AS (
  SELECT {S}ProcessingDateKey,
    CAST(SUM(CommitmentAmt) AS DECIMAL(38,2)) AS CommitmentAmt,
    CAST(SUM(DealsWithAmount) AS BIGINT) AS Deals,
    CAST(SUM(OutstandingAmt) AS DECIMAL(38,2)) AS OutstandingAmt
  FROM cells GROUP BY {S}ProcessingDateKey),
pop AS (
  SELECT *,
    LAG(ProcessingDateKey) OVER w AS pk,
    LAG(CommitmentAmt) OVER w AS CommitmentAmtPrior,
    LAG(OutstandingAmt) OVER w AS OutstandingAmtPrior,
    LAG(Deals) OVER w AS DealsPrior
  FROM tot WINDOW w AS ({s.part()} ORDER BY ProcessingDateKey))
SELECT {s.lead('p')}p.ProcessingDateKey, p.CommitmentAmt, p.Deals, p.OutstandingAmt,
  COALESCE(p.pk, 0) AS ProcessingDateKeyPrior, p.CommitmentAmtPrior, p.OutstandingAmtPrior, p.DealsPrior,
  {diff('p.CommitmentAmt', 'p.CommitmentAmtPrior')} AS ca_diff,
  {diff('p.OutstandingAmt', 'p.OutstandingAmtPrior')} AS oa_diff,
  {diff('p.Deals', 'p.DealsPrior')} AS deals_diff,
  c.ca AS ca_model_diff, c.oa AS oa_model_diff, c.deals AS deals_model_diff
FROM pop p LEFT JOIN compw c ON {s.eq('p', 'c')}p.ProcessingDateKey = c.ProcessingDateKey"""


def with_tape(*ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([TAPE_CTE, *ctes])


def rounded(sql: str, cols: Sequence[str], places: int = 6) -> str:
    """Round double columns like Spark's ``round``: half up on the value's
    shortest decimal text (not on its binary expansion), -0.0 folded into
    0.0; NaN and infinities pass through."""
    if not cols:
        return sql

    def r(c):
        x = f'"{c}"'
        return (f"CASE WHEN isnan({x}) OR isinf({x}) THEN {x} ELSE "
                f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {places}) AS DOUBLE) + 0.0 END")
    rep = ", ".join(f'{r(c)} AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


# ----------------------------------------------------------- filter specs
def _q(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _in(col: str, vals) -> str:
    return f"{col} IN ({', '.join(_q(v) for v in vals)})"


def _number(v) -> str:
    """A literal as DuckDB reads it (NULL if it is no number)."""
    return f"TRY_CAST({_q(v)} AS DOUBLE)"


def _day(v) -> str:
    """The key of the day an ISO text names, NULL if it names none."""
    return f"CAST(strftime(TRY_CAST(substr({_q('' if v is None else v)}, 1, 10) AS DATE), '%Y%m%d') AS INTEGER)"


def spec_sql(spec) -> str:
    """SQL text of a ``FilterSpec``: labels, numbers and dates are taken apart
    by DuckDB, so that nothing of the Spark predicates is shared."""
    parts = []
    sba = {"sba": "LineofBusinessId = '12'", "non-sba": "LineofBusinessId <> '12'"}
    classes = [sba[str(v).lower()] for v in spec.sba if str(v).lower() in sba]
    if classes:
        parts.append("(" + " OR ".join(classes) + ")")
    if spec.lob:
        parts.append("LineofBusinessId IN (" + ", ".join(f"split_part({_q(v)}, ' - ', 1)" for v in spec.lob) + ")")
    for col, vals in (("CommitmentSizeGroup", spec.size_groups), ("RiskGroupDesc", spec.risk_groups),
                      ("BankID", spec.banks), ("Region", spec.regions), ("NAICSGrpName", spec.naics)):
        if vals:
            parts.append(_in(col, vals))
    if spec.ranges:
        good = [f"COALESCE(trim({_q(r.label)}) <> '' AND {_number(r.min)} < {_number(r.max)}, FALSE)" for r in spec.ranges]
        hits = [f"({g} AND CAST(CommitmentAmt AS DOUBLE) >= {_number(r.min)} AND CAST(CommitmentAmt AS DOUBLE) <= {_number(r.max)})"
                for g, r in zip(good, spec.ranges)]
        parts.append(f"(NOT ({' OR '.join(good)}) OR {' OR '.join(hits)})")
    tests = {"equals": "=", "greaterthan": ">=", "lessthan": "<="}
    for d in spec.dates:
        start, op = _day(d.startDate), str(d.operator or "").lower()
        if op in tests:
            parts.append(f"({start} IS NULL OR ProcessingDateKey {tests[op]} {start})")
        elif op == "between":
            end = _day(d.endDate)
            parts.append(f"({start} IS NULL OR {end} IS NULL OR ProcessingDateKey BETWEEN {start} AND {end})")
    if spec.residual:
        parts.append(f"NOT (CurrentMaturityDateKey < ProcessingDateKey AND "
                     f"CAST(OutstandingAmt AS DOUBLE) < {float(spec.residual_limit)!r})")
    return " AND ".join(parts) if parts else "TRUE"
