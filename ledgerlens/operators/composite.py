"""The capped composite growth index.

Pipeline (one lazy plan, nothing is written while it is built):

1. ``cells``: partial + final aggregate of the tape by
   ``(scope, date, bank)`` - the only step that touches detail rows.
2. ``long_panel``: the three metrics unpivoted to
   ``(scope, metric, date, bank, amt)``; from here on the data is
   banks x months x 3 per scope.
3. ``cap_max_proportion`` (W3-W5): largest-bank concentration cap per
   ``(scope, metric, date)``.
4. ``with_period_links``: the scope's previous period, from its distinct
   periods (calendar-sized), joined back; with the scope's bank count.
5. ``raw_mom`` (W6): bank change against that period, per
   ``(scope, metric, bank)``.
6. ``with_limits`` / ``breach_limits`` (W7): share of breaching banks ->
   limits, per ``(scope, metric, date)``.
7. ``capped_chain`` (W8): the recursive clamp, folded per
   ``(scope, metric, bank)`` with the native ``aggregate`` higher-order
   function over that bank's months.
8. ``composite`` (W9): weighted change of the clamped values per
   ``(scope, metric, date)``.

Every exchange after the cells moves the reduced panel and is keyed by date
or by bank, so the work spreads over dates and banks.  The branches (panel,
periods, bank count) read the same columns of the cells, so Spark runs the
cell aggregate once and reuses its exchange.  Missing cells are never
materialised: a bank's previous cell is valid only if it sits on the scope's
previous period, which is what a dense date x bank pivot would say.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AMOUNT, METRICS, TOTAL, CapConfig

DATE = "ProcessingDateKey"
BANK = "BankID"


def _zero() -> Column:
    return F.lit(0).cast(AMOUNT)


# --------------------------------------------------------------------------- A1
def cells(tape: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Cell aggregate by ``(scope, date, bank)``.

    ``Deals`` counts every row; ``DealsWithAmount`` (non-NULL commitment)
    is carried so the uncapped period totals derive from the same
    shuffle.  Amounts are summed as decimals (exact, order-free).
    """
    keys = [*scope, DATE, BANK]
    return tape.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col("CommitmentAmt"), _zero())).cast(TOTAL).alias("CommitmentAmt"),
        F.count(F.lit(1)).alias("Deals"),
        F.sum(F.coalesce(F.col("OutstandingAmt"), _zero())).cast(TOTAL).alias("OutstandingAmt"),
        F.count("CommitmentAmt").alias("DealsWithAmount"),
    )


def cell_aggregate(tape: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A1 as the original application exposes it: sums of null-filled amounts, all-row deals."""
    return cells(tape, scope).drop("DealsWithAmount")


def scoped_cells(tape: DataFrame, scopes: Sequence[tuple[object, Column]],
                 scope_col: str = "template_id") -> DataFrame:
    """``cells`` for many filter scopes in ONE scan and ONE shuffle.

    Each scope is ``(id, predicate)``.  The OR of all predicates is pushed
    into the scan; each surviving row is tagged with the ids of the scopes
    it matches (``explode(filter(array(when(pred_i, id_i))))``) and the
    tagged rows go straight into the partially aggregated cell aggregate.
    Work grows with the average number of scopes a row matches, not with
    the number of scopes, and only reduced cells are shuffled.
    """
    any_hit = None
    for _, pred in scopes:
        any_hit = pred if any_hit is None else (any_hit | pred)
    src = tape.filter(any_hit) if any_hit is not None else tape
    ids = F.filter(F.array(*[F.when(pred, F.lit(sid)) for sid, pred in scopes]), lambda x: x.isNotNull())
    tagged = src.select(DATE, BANK, "CommitmentAmt", "OutstandingAmt", F.explode(ids).alias(scope_col))
    return cells(tagged, [scope_col])


# ------------------------------------------------------------------ long panel
def long_panel(cell_df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Unpivot the three metrics: ``(scope, metric, date, bank, amt)``.

    ``amt`` stays DECIMAL so period sums are exact; the maths converts to
    double where the original application works in floating point.
    """
    parts = [F.struct(F.lit(m).alias("metric"), F.col(c).cast(TOTAL).alias("amt"))
             for m, c in METRICS]
    return cell_df.select(*scope, DATE, BANK, F.inline(F.array(*parts)))


# ---------------------------------------------------------------------- W3-W5
def cap_max_proportion(panel: DataFrame, scope: Sequence[str] = (), lim: float = 0.5,
                       amt: str = "amt") -> DataFrame:
    """Largest-bank cap: if ``lim < max share < 1`` the largest bank gets
    ``lim * period sum`` and the others ``(1 - lim) * amt / (1 - max)``;
    otherwise unchanged.  Adds ``Sum``, ``Perc``, ``Max``, ``Capped``.
    """
    w = Window.partitionBy(*scope, "metric", DATE)
    x = F.col(amt).cast("double")
    total = F.sum(amt).over(w).cast("double")
    out = panel.select("*", total.alias("Sum"), F.try_divide(x, total).alias("Perc"))
    lim_c = F.lit(float(lim))
    mx = F.max("Perc").over(w)
    capped = (F.when((mx > lim_c) & (mx < 1.0),
                     F.when(F.col("Perc") == mx, F.col("Sum") * lim_c)
                      .otherwise(F.try_divide((1 - lim_c) * x, 1 - mx)))
              .otherwise(x))
    return out.select("*", mx.alias("Max"), capped.alias("Capped"))


# -------------------------------------------------------------- period links
def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of ``keys``; the keys come from ``left``."""
    l, r = left.alias("l"), right.alias("r")
    cond = None
    for k in keys:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        cond = c if cond is None else cond & c
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return l.join(r, cond, how).select("l.*", *extra)


def used_cells(cell_df: DataFrame) -> DataFrame:
    """The cells as every branch reads them.  The test holds for each cell; it
    keeps both counts in all branches, so that these share one exchange."""
    return cell_df.where((F.col("Deals") > 0) & (F.col("DealsWithAmount") >= 0))


def periods(cell_df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``(scope, date, PrevDateKey)``: a scope's periods and their predecessors.

    One row per period before the window, so the window is calendar-sized.
    """
    days = (used_cells(cell_df).groupBy(*scope, DATE)
            .agg(F.sum("CommitmentAmt").alias("_ca"), F.sum("OutstandingAmt").alias("_oa"))
            .where(F.col("_ca").isNotNull() & F.col("_oa").isNotNull()))
    w = Window.partitionBy(*scope).orderBy(DATE)
    return days.select(*scope, DATE, F.lag(DATE).over(w).alias("PrevDateKey"))


def _with_bank_count(linked: DataFrame, cell_df: DataFrame, scope: Sequence[str]) -> DataFrame:
    banks = (used_cells(cell_df).groupBy(*scope, BANK)
             .agg(F.max("CommitmentAmt").alias("_ca"), F.max("OutstandingAmt").alias("_oa"))
             .where(F.col("_ca").isNotNull() & F.col("_oa").isNotNull()))
    if scope:
        return join_on(linked, banks.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_banks")), scope)
    return linked.withColumn("n_banks", banks.agg(F.count(F.lit(1))).scalar())


def with_period_links(capped: DataFrame, cell_df: DataFrame, scope: Sequence[str] = (),
                      bank_count: bool = True) -> DataFrame:
    """Add the scope's previous period (``PrevDateKey``) and, if asked for,
    its bank count (``n_banks``; NULL otherwise)."""
    linked = join_on(capped, periods(cell_df, scope), [*scope, DATE])
    if bank_count:
        return _with_bank_count(linked, cell_df, scope)
    return linked.withColumn("n_banks", F.lit(None).cast("long"))


# ------------------------------------------------------------------------ W6
def raw_mom(linked: DataFrame, scope: Sequence[str] = (), value: str = "Capped") -> DataFrame:
    """Bank change against the scope's previous period (``perc_diff_raw``).

    Invalid (NULL) when the bank lacks either period or the prior value
    is 0.  Window per ``(scope, metric, bank)`` over that bank's months.
    """
    w = Window.partitionBy(*scope, "metric", BANK).orderBy(DATE)
    prev_d = F.lag(DATE).over(w)
    prev_v = F.lag(value).over(w)
    link = F.coalesce(prev_d == F.col("PrevDateKey"), F.lit(False))
    ok = link & F.coalesce(prev_v != 0, F.lit(False))
    return linked.select("*", F.when(ok, F.try_divide(F.col(value), prev_v) - 1).alias("perc_diff_raw"),
                         link.alias("_linked"))


# ------------------------------------------------------------------------ W7
LIMIT_COLUMNS = ["actual_data", "num_breaches_max", "num_breaches_min", "perc_breaches_max",
                 "perc_breaches_min", "lim_max", "lim_min"]


def with_limits(raw: DataFrame, scope: Sequence[str] = (), cfg: CapConfig = CapConfig()) -> DataFrame:
    """Breach shares -> the period's limits, attached to every cell.

    Window aggregates per ``(scope, metric, date)`` (no join back).
    ``missing="exclude"``: only valid changes count.  ``missing="nan"``:
    every bank of the scope counts and a missing change is an upper
    breach (NaN ordered above all numbers).
    """
    hi, lo = cfg.hi, cfg.lo
    r = F.col("perc_diff_raw")
    w = Window.partitionBy(*scope, "metric", DATE)
    valid = F.count(r).over(w)
    n_hi = F.count(F.when(r > hi, 1)).over(w)
    n_lo = F.count(F.when(r < lo, 1)).over(w)
    if cfg.missing == "nan":
        actual = F.col("n_banks")
        hi_cnt = n_hi + (F.col("n_banks") - valid)
    else:
        actual = valid
        hi_cnt = n_hi
    p_hi = F.when(actual == 0, F.lit(0.0)).otherwise(F.try_divide(hi_cnt.cast("double"), actual.cast("double")))
    p_lo = F.when(actual == 0, F.lit(0.0)).otherwise(F.try_divide(n_lo.cast("double"), actual.cast("double")))
    hbp = F.lit(float(cfg.high_breach_perc))
    # one projection; Spark de-duplicates the repeated window aggregates
    return raw.select("*", actual.cast("long").alias("actual_data"), hi_cnt.cast("long").alias("num_breaches_max"),
                      n_lo.cast("long").alias("num_breaches_min"), p_hi.alias("perc_breaches_max"),
                      p_lo.alias("perc_breaches_min"),
                      F.when(p_hi >= hbp, cfg.hi_high).otherwise(hi).alias("lim_max"),
                      F.when(p_lo >= hbp, cfg.lo_high).otherwise(lo).alias("lim_min"))


def breach_limits(limited: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """W7 as one row per ``(scope, metric, date)`` (values are constant
    within the group)."""
    return limited.groupBy(*scope, "metric", DATE).agg(*[F.max(c).alias(c) for c in LIMIT_COLUMNS])


# ------------------------------------------------------------------------ W8
# One fold step: the previous clamped value is the last element so far.
_PREV = "try_element_at(acc, -1)"
_FOLD_SQL = (
    "aggregate({arr}, CAST(array() AS ARRAY<DOUBLE>), "
    f"(acc, e) -> concat(acc, array(IF(e.l AND {_PREV} <> 0, "
    f"{_PREV} * (1 + greatest(least(try_divide(e.v, {_PREV}) - 1, e.hi), e.lo)), e.v))))"
)


def _clamp_fold(months: str) -> Column:
    """The clamped values of a bank's date-sorted months.

    ``mod_t = mod_{t-1} * (1 + clamp(v_t / mod_{t-1} - 1, lo_t, hi_t))``
    when the bank's previous month is the scope's previous period (``l``)
    and ``mod_{t-1} != 0``; otherwise the chain re-bases to ``v_t``.  Only
    the value sequence is folded (the one truly sequential part); the
    change, previous value and inclusion flag are recomputed afterwards
    as ordinary code-generated expressions with the same arithmetic.
    """
    return F.expr(_FOLD_SQL.format(arr=months))


def capped_chain(limited: DataFrame, scope: Sequence[str] = (), value: str = "Capped") -> DataFrame:
    """Recursive clamp per ``(scope, metric, bank)``.

    The group holds one element per month of that bank (the calendar
    bounds it, not the row count), so a hot bank is no heavier here than
    any other.
    """
    elem = F.struct(F.col(DATE).alias("d"), F.col("PrevDateKey").alias("p"),
                    F.col(value).cast("double").alias("v"), F.col("lim_max").alias("hi"),
                    F.col("lim_min").alias("lo"), F.col("perc_diff_raw").alias("raw"),
                    F.col("n_banks").alias("nb"), F.col("_linked").alias("l"))
    g = limited.groupBy(*scope, "metric", BANK).agg(F.array_sort(F.collect_list(elem)).alias("_m"))
    g = g.select(*scope, "metric", BANK, "_m", _clamp_fold("_m").alias("_mods"))
    prev = F.concat(F.array(F.lit(None).cast("double")), F.slice("_mods", 1, F.size("_mods") - 1))
    z = g.select(*scope, "metric", BANK,
                 F.explode(F.arrays_zip(F.col("_m").alias("i"), F.col("_mods").alias("m"),
                                        prev.alias("pm"))).alias("_e"))
    v, pm = F.col("_e.i.v"), F.col("_e.pm")
    ok = F.coalesce(F.col("_e.i.l") & (pm != 0), F.lit(False))
    chg = F.when(ok, F.greatest(F.least(F.try_divide(v, pm) - 1, F.col("_e.i.hi")), F.col("_e.i.lo")))
    return z.select(*scope, "metric", BANK,
                    F.col("_e.i.d").alias("ProcessingDateKey"), v.alias("value"),
                    F.col("_e.i.raw").alias("perc_diff_raw"), chg.alias("perc_diff"),
                    F.col("_e.m").alias("mod"), F.when(ok, pm).alias("prev_mod"), ok.alias("inc"),
                    F.col("_e.i.p").alias("PrevDateKey"), F.col("_e.i.nb").alias("n_banks"))


# ------------------------------------------------------------------------ W9
def composite(chain: DataFrame, scope: Sequence[str] = (), cfg: CapConfig = CapConfig()) -> DataFrame:
    """``sum(mod_t * inc_t) / sum(mod_{t-1} * inc_t) - 1`` per period.

    NULL in the first period and when the prior sum is 0 or NULL.  With
    ``missing="nan"`` also NULL when any bank of the scope lacks the
    period or its predecessor (the original application's NaN propagation).
    """
    g = chain.groupBy(*scope, "metric", DATE).agg(
        F.sum(F.when(F.col("inc"), F.col("mod"))).alias("curr_sum"),
        F.sum(F.when(F.col("inc"), F.col("prev_mod"))).alias("prior_sum"),
        F.count(F.lit(1)).alias("n_present"),
        F.max("PrevDateKey").alias("PrevDateKey"),
        F.max("n_banks").alias("n_banks"),
    )
    value = (F.when(F.col("PrevDateKey").isNull(), F.lit(None).cast("double"))
              .when(F.col("prior_sum").isNull() | (F.col("prior_sum") == 0) | F.col("curr_sum").isNull(),
                    F.lit(None).cast("double"))
              .otherwise(F.try_divide(F.col("curr_sum"), F.col("prior_sum")) - 1))
    if cfg.missing == "nan":
        before = g.select(*scope, "metric", F.col(DATE).alias("PrevDateKey"), F.col("n_present").alias("prev_present"))
        g = join_on(g, before, [*scope, "metric", "PrevDateKey"], "left")
        gap = (F.col("n_present") < F.col("n_banks")) | (F.col("prev_present") < F.col("n_banks"))
        value = F.when(F.coalesce(gap, F.lit(False)), F.lit(None).cast("double")).otherwise(value)
    return g.select(*scope, "metric", DATE, "curr_sum", "prior_sum", value.alias("perc_diff"))


# ---------------------------------------------------------------- E1 / J5
def raw_changes(cell_df: DataFrame, scope: Sequence[str] = (), cfg: CapConfig = CapConfig()) -> dict:
    """Everything that doesn't depend on the month-over-month caps."""
    panel = long_panel(used_cells(cell_df), scope)
    capped = cap_max_proportion(panel, scope, cfg.cell_weight)
    linked = with_period_links(capped, cell_df, scope, cfg.missing == "nan")
    return {"panel": panel, "capped": capped, "raw": raw_mom(linked, scope)}


def limited_chain(raw: DataFrame, scope: Sequence[str] = (), cfg: CapConfig = CapConfig()) -> dict:
    """W7-W9 over the raw changes."""
    limited = with_limits(raw, scope, cfg)
    chain = capped_chain(limited, scope)
    return {"limited": limited, "limits": breach_limits(limited, scope), "chain": chain,
            "composite": composite(chain, scope, cfg)}


def composite_parts(cell_df: DataFrame, scope: Sequence[str] = (), cfg: CapConfig = CapConfig()) -> dict:
    """All intermediate frames of the composite (for reports and tests)."""
    parts = raw_changes(cell_df, scope, cfg)
    return parts | limited_chain(parts["raw"], scope, cfg)


def pivot_metrics(comp: DataFrame, scope: Sequence[str] = (), value: str = "perc_diff") -> DataFrame:
    """``(scope, date, ca, oa, deals)`` - conditional aggregation over
    the three fixed metric names (no pivot-value discovery job)."""
    return comp.groupBy(*scope, DATE).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(value))).alias(m) for m, _ in METRICS])


def composites(tape: DataFrame, cfg: CapConfig = CapConfig(), scope: Sequence[str] = ()) -> DataFrame:
    """Composite change series ``(scope, ProcessingDateKey, ca, oa, deals)``."""
    return pivot_metrics(composite_parts(cells(tape, scope), scope, cfg)["composite"], scope)


# ------------------------------------------------------------------------ W12
def bank_ids(cell_df: DataFrame) -> list[str]:
    """The banks of the cells, sorted: the pivot list of ``wide_panel``."""
    found = [r[BANK] for r in cell_df.select(BANK).distinct().collect()]
    return sorted((b for b in found if b is not None), key=lambda b: (len(b), b))


def wide_panel(parts: dict, banks: Sequence[str], metric: str = "ca",
               scope: Sequence[str] = ()) -> DataFrame:
    """The original application's wide frame for one metric - per bank the capped
    value, raw change, inclusion (false where the bank has no cell), clamped
    change and clamped value, then the period's limits and composite.

    ``banks`` names the columns and must hold every bank of the panel (see
    ``bank_ids``); a bank outside the list raises when the frame is
    evaluated.  The limits ride through the chain, so the panel is computed
    once.
    """
    limits = parts["limited"].filter(F.col("metric") == metric).groupBy(*scope, DATE).agg(
        F.max("lim_max").alias("lim_max"), F.max("lim_min").alias("lim_min"))
    ch = parts["chain"].filter(F.col("metric") == metric)
    unknown = F.assert_true(F.col(BANK).isNull() | F.col(BANK).isin([str(b) for b in banks]),
                            F.concat(F.lit("bank outside the list of wide_panel: "), F.col(BANK)))
    ch = ch.where(unknown.isNull())
    aggs = []
    for b in banks:
        hit = F.col(BANK) == F.lit(str(b))
        aggs += [F.max(F.when(hit, F.col("value"))).alias(f"{b}"),
                 F.max(F.when(hit, F.col("perc_diff_raw"))).alias(f"{b}_perc_diff_raw"),
                 F.coalesce(F.max(F.when(hit, F.col("inc").cast("int"))).cast("boolean"), F.lit(False)).alias(f"{b}_inc"),
                 F.max(F.when(hit, F.col("perc_diff"))).alias(f"{b}_perc_diff"),
                 F.max(F.when(hit, F.col("mod"))).alias(f"{b}_mod")]
    wide = ch.groupBy(*scope, DATE).agg(*aggs)
    comp = parts["composite"].filter(F.col("metric") == metric).select(*scope, DATE, "perc_diff")
    return join_on(join_on(wide, limits, [*scope, DATE]), comp, [*scope, DATE])


def panel_long(parts: dict, scope: Sequence[str] = ()) -> DataFrame:
    """W12 without a column per bank: one row per metric, period and bank
    with the bank's values of ``wide_panel``, its place in that frame
    (``bank_pos``, from 1, by length and text) and the period's limits and
    composite.

    The plan has the same size for any number of banks and nothing runs while
    it is built.  A bank without a cell in a period has no row there; a null
    bank has a null place.
    """
    keys = [*scope, "metric", DATE]
    limits = parts["limited"].groupBy(*keys).agg(F.max("lim_max").alias("lim_max"), F.max("lim_min").alias("lim_min"))
    comp = parts["composite"].select(*keys, F.col("perc_diff").alias("composite"))
    banks = parts["chain"].where(F.col(BANK).isNotNull()).groupBy(BANK).agg(F.length(BANK).alias("_len"))
    places = banks.select(BANK, F.row_number().over(Window.orderBy("_len", BANK)).alias("bank_pos"))     # one row per bank
    cells = parts["chain"].select(*keys, BANK, "value", "perc_diff_raw", "inc", "perc_diff", "mod")
    return join_on(join_on(join_on(cells, places, [BANK], "left"), limits, keys), comp, keys)
