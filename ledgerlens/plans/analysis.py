"""Capped vs uncapped analysis.

The flagship: uncapped period totals with period-over-period change next
to the capped composite change, for one filter scope, many template
scopes or many cap values - always ONE scan and ONE full-size shuffle
(the cell aggregate); every later step works on banks x months.  The plans
are lazy: nothing runs or is written before the caller acts.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RESULT_COLUMNS, CapConfig
from ..operators import composite as C
from ..operators import series as S
from ..operators.filters import FilterSpec, apply_filters

DATE = "ProcessingDateKey"


def capped_vs_uncapped_from_cells(cell_df: DataFrame, scope: Sequence[str] = (),
                                  cfg: CapConfig = CapConfig()) -> DataFrame:
    totals = S.totals_from_cells(C.used_cells(cell_df), scope)
    pop = S.pop_change(totals, "core", scope)
    comp = C.pivot_metrics(C.composite_parts(cell_df, scope, cfg)["composite"], scope)
    comp = comp.select(*scope, DATE, F.col("ca").alias("ca_model_diff"),
                       F.col("oa").alias("oa_model_diff"), F.col("deals").alias("deals_model_diff"))
    return C.join_on(pop, comp, [*scope, DATE], "left").select(*scope, *RESULT_COLUMNS)


def reduced_cells(tape: DataFrame, spec: FilterSpec | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Filter + cell aggregate: the one full-size step, banks x months after it."""
    return C.cells(apply_filters(tape, spec), scope)


def capped_vs_uncapped(tape: DataFrame, spec: FilterSpec | None = None,
                       cfg: CapConfig = CapConfig(), scope: Sequence[str] = ()) -> DataFrame:
    """``RESULT_SCHEMA`` rows per period (and scope)."""
    return capped_vs_uncapped_from_cells(reduced_cells(tape, spec, scope), scope, cfg)


def cap_sensitivity(tape: DataFrame, caps: Sequence[float], spec: FilterSpec | None = None,
                    cfg: CapConfig = CapConfig()) -> DataFrame:
    """The composite for several MoM caps (``min = -c / (1 + c)``).

    What doesn't depend on the cap (W3-W6) runs once; the raw changes are
    then fanned out over the (parameter-sized) list of caps, which rides
    through limits, chain and composite as the ``cap_value`` scope key.  The
    limits of a month with many breaches (``max_mom_high``) are the same for
    every cap, so a cap above them is the wider one of the two.
    """
    raw = C.raw_changes(reduced_cells(tape, spec), (), cfg)["raw"]
    fanned = raw.withColumn("cap_value", F.explode(F.array(*[F.lit(float(c)) for c in caps])))
    scoped = CapConfig(cell_weight=cfg.cell_weight, max_mom=F.col("cap_value"),
                       max_mom_high=cfg.max_mom_high, high_breach_perc=cfg.high_breach_perc,
                       missing=cfg.missing)
    return C.pivot_metrics(C.limited_chain(fanned, ["cap_value"], scoped)["composite"], ["cap_value"])
