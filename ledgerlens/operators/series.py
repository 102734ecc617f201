"""Monthly series: totals, prior period, period-over-period change,
positional attach, base-100 index, metric summary and record-level change.

Windows here order *monthly* rows (a few hundred per scope) and are
partitioned by the scope; the record-level change (W13) ranges detail
rows over many tasks instead of one window.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOTAL
from ..functions.scalars import safe_change
from .composite import join_on

DATE = "ProcessingDateKey"
SERIES = (("CommitmentAmt", "ca_diff"), ("OutstandingAmt", "oa_diff"), ("Deals", "deals_diff"))


# ------------------------------------------------------------------------ A2-A4
def period_totals(df: DataFrame, scope: Sequence[str] = (), deals: str = "amount") -> DataFrame:
    """Uncapped totals per period.

    ``deals="amount"``: non-NULL commitment count, empty sums 0 (A2);
    ``deals="bank"``: non-NULL bank count, NULL periods dropped (A3);
    ``deals="rows"``: ``COUNT(*)``, SQL sums (NULL when empty) (A4).
    """
    if deals == "bank":
        df = df.filter(F.col(DATE).isNotNull())
    zero = F.lit(0).cast(TOTAL)
    if deals == "rows":
        ca, oa = F.sum("CommitmentAmt").cast(TOTAL), F.sum("OutstandingAmt").cast(TOTAL)
        n = F.count(F.lit(1))
    else:
        ca = F.coalesce(F.sum("CommitmentAmt").cast(TOTAL), zero)
        oa = F.coalesce(F.sum("OutstandingAmt").cast(TOTAL), zero)
        n = F.count("CommitmentAmt") if deals == "amount" else F.count("BankID")
    return df.groupBy(*scope, DATE).agg(ca.alias("CommitmentAmt"), n.alias("Deals"), oa.alias("OutstandingAmt"))


def totals_from_cells(cell_df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A2 rolled up from the (already reduced) bank cells - no second scan."""
    return cell_df.groupBy(*scope, DATE).agg(
        F.sum("CommitmentAmt").cast(TOTAL).alias("CommitmentAmt"),
        F.sum("DealsWithAmount").alias("Deals"),
        F.sum("OutstandingAmt").cast(TOTAL).alias("OutstandingAmt"))


# ------------------------------------------------------------------------ W1
def with_prior(df: DataFrame, scope: Sequence[str] = (), key: str = DATE,
               metrics=("CommitmentAmt", "OutstandingAmt", "Deals")) -> DataFrame:
    """LAG(1) of the key and metrics per scope, ordered by the key."""
    w = Window.partitionBy(*scope).orderBy(key)
    return df.select("*", F.lag(key).over(w).alias(f"{key}Prior"),
                     *[F.lag(m).over(w).alias(f"{m}Prior") for m in metrics])


# ------------------------------------------------------------------------ J1
def join_prior(df: DataFrame, scope: Sequence[str] = (), key: str = DATE,
               metrics=("CommitmentAmt", "OutstandingAmt", "Deals")) -> DataFrame:
    """Prior-period LEFT self-join on the shifted key (first prior = 0),
    null-safe on the scope; the scope columns are the left side's."""
    w = Window.partitionBy(*scope).orderBy(key)
    left = df.withColumn(f"{key}Prior", F.coalesce(F.lag(key).over(w), F.lit(0)))
    right = df.select(*scope, F.col(key).alias(f"{key}Prior"), *[F.col(m).alias(f"{m}Prior") for m in metrics])
    return join_on(left, right, [*scope, f"{key}Prior"], "left")


# ------------------------------------------------------------------------ W2
def pop_change(totals: DataFrame, variant: str = "core", scope: Sequence[str] = ()) -> DataFrame:
    """Period-over-period change in the four original variants.

    core: guard NULL/0 prior, ``cur/prior - 1``, prior key 0, prior amounts NULL.
    view: guard prior > 0, ``(cur - prior)/prior``, keys as strings
          (prior ``'0'``), prior amounts 0, model diffs NULL.
    tsv:  as core, keys ``YYYY-MM-DD`` (prior ``'0'``), then every NULL -> 0.
    seed: as core, changes rounded to 6 places, model diffs NULL.
    """
    p = with_prior(totals, scope)
    if variant in ("core", "seed"):
        cols = [F.coalesce(F.col("ProcessingDateKeyPrior"), F.lit(0)).alias("ProcessingDateKeyPrior")
                if c == "ProcessingDateKeyPrior" else F.col(c) for c in p.columns]
        for m, d in SERIES:
            ch = safe_change(F.col(m), F.col(f"{m}Prior"))
            cols.append((F.round(ch, 6) if variant == "seed" else ch).alias(d))
        if variant == "seed":
            cols += [F.lit(None).cast("double").alias(d.replace("_diff", "_model_diff")) for _, d in SERIES]
        return p.select(*cols)
    if variant == "view":
        out = p
        for m, d in SERIES:
            prior = F.col(f"{m}Prior").cast("double")
            out = out.withColumn(d, F.when(prior > 0, F.try_divide(F.col(m).cast("double") - prior, prior)))
        out = (out.withColumn("ProcessingDateKey", F.col(DATE).cast("string"))
                  .withColumn("ProcessingDateKeyPrior",
                              F.coalesce(F.col("ProcessingDateKeyPrior").cast("string"), F.lit("0"))))
        for m, _ in SERIES:
            zero = F.lit(0).cast("long") if m == "Deals" else F.lit(0).cast(TOTAL)
            out = out.withColumn(f"{m}Prior", F.coalesce(F.col(f"{m}Prior"), zero))
        for _, d in SERIES:
            out = out.withColumn(d.replace("_diff", "_model_diff"), F.lit(None).cast("double"))
        return out
    if variant == "tsv":
        out = p
        for m, d in SERIES:
            prior = F.col(f"{m}Prior").cast("double")
            out = out.withColumn(d, F.when(prior.isNull() | (prior == 0), F.lit(None).cast("double"))
                                     .otherwise(F.try_divide(F.col(m).cast("double") - prior, prior)))
        iso = lambda c: F.date_format(F.to_date(F.col(c).cast("string"), "yyyyMMdd"), "yyyy-MM-dd")
        out = (out.withColumn("ProcessingDateKeyPrior", F.coalesce(iso("ProcessingDateKeyPrior"), F.lit("0")))
                  .withColumn(DATE, iso(DATE)))
        for m, d in SERIES:
            z = F.lit(0).cast("long") if m == "Deals" else F.lit(0).cast(TOTAL)
            out = out.withColumn(f"{m}Prior", F.coalesce(F.col(f"{m}Prior"), z))
            out = out.withColumn(d, F.coalesce(F.col(d), F.lit(0.0)))
        return out
    raise ValueError(f"unknown PoP variant {variant!r}")


# ------------------------------------------------------------------------ J3
def positions(df: DataFrame, order: str | Sequence[str], scope: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Adds ``_pos``: 1, 2, ... in ``order`` within the scope.

    Rows are numbered inside a range of (scope, order) and the sizes of the
    scope's earlier ranges are added, so no task sees more than about ``rows``
    rows (default ``RANGE_ROWS``), one row per range when the sizes are summed.
    Rows equal in ``order`` are numbered by a hash of the whole row, which
    splits a hot period too; only repeated rows stay together.
    """
    order = [order] if isinstance(order, str) else list(order)
    hashed = [f.name for f in df.schema if not re.search(r"\b(map<|variant)", f.dataType.simpleString())]
    ranged = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    ranged = with_ranges(ranged, [*scope, *order, "_tie"], rows or RANGE_ROWS)
    inside = Window.partitionBy(*scope, "_range").orderBy(*order, "_tie")
    earlier = Window.partitionBy(*scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*scope, "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*scope, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = join_on(ranged.withColumn("_in", F.row_number().over(inside)), sizes, [*scope, "_range"])
    return out.withColumn("_pos", F.col("_before") + F.col("_in")).drop("_before", "_in", "_range", "_tie")


def attach_by_position(df: DataFrame, order: str | Sequence[str], series: DataFrame, series_order: str | Sequence[str],
                       columns: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Pair a series with ``df`` by position (1st with 1st, ...).

    Shorter series pad with NULL, longer ones are cut - a LEFT join on the
    position of each side within the scope.
    """
    right = positions(series, series_order, scope).select(*scope, "_pos", *columns)
    return join_on(positions(df, order, scope), right, [*scope, "_pos"], "left").drop("_pos")


# ------------------------------------------------------------------------ W10
def index_100(df: DataFrame, metrics=("CommitmentAmt", "OutstandingAmt", "Deals"),
              scope: Sequence[str] = (), key: str = DATE) -> DataFrame:
    """Base-100 index against the first period; base <= 0 or NULL -> 100.

    A value of exactly 0 stays 0 (the chart's JS truthiness would show 100).
    """
    w = Window.partitionBy(*scope).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    names = {"CommitmentAmt": "commitmentIndex", "OutstandingAmt": "outstandingIndex", "Deals": "dealsIndex"}
    for m in metrics:
        base = F.first(F.col(m), ignorenulls=False).over(w).cast("double")
        first = F.row_number().over(Window.partitionBy(*scope).orderBy(key)) == 1
        idx = (F.when(first, F.lit(100.0))
                .when(base.isNull() | (base <= 0), F.lit(100.0))
                .otherwise(F.try_divide(F.col(m).cast("double"), base) * 100))
        out = out.withColumn(names.get(m, f"{m}Index"), idx)
    return out


# ------------------------------------------------------------------------ W11
def metric_summary(df: DataFrame, metrics: str | Sequence[str], scope: Sequence[str] = (), key: str = DATE) -> DataFrame:
    """Latest and previous non-NULL value, trend and % change per scope and
    metric: the series is unpivoted and ranked once, per metric."""
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    long = df.select(*scope, key, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("_v")) for m in metrics])))
    w = Window.partitionBy(*scope, "metric").orderBy(F.col(key).desc())
    top = long.filter(F.col("_v").isNotNull()).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    g = top.groupBy(*scope, "metric").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("_v"))).alias("latest"),
        F.max(F.when(F.col("_rn") == 2, F.col("_v"))).alias("previous"))
    trend = (F.when(F.col("latest") > F.col("previous"), "up")
              .when(F.col("latest") < F.col("previous"), "down").otherwise("stable"))
    change = F.when(F.col("previous").isNull() | (F.col("previous") == 0), F.lit(0.0)).otherwise(
        F.try_divide(F.col("latest") - F.col("previous"), F.col("previous")) * 100)
    return g.select(*scope, "metric", "latest", "previous", trend.alias("trend"), change.alias("change"))


# ------------------------------------------------------------------------ W13
#: Rows of a range on average, and sampled keys for each cut point kept.
RANGE_ROWS = 1_000_000
OVERSAMPLE = 8


def with_ranges(df: DataFrame, order: Sequence[str], rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``_range``: a number that rises with ``order``, about ``rows`` rows each.

    The cut points are whole keys of any orderable types, so a hot period is
    split by the next column, a hot (period, key) pair by the one after it;
    only rows equal in all of ``order`` can't be separated.  Keys are drawn by
    their hash, so every use of the result sees the same ranges whatever the
    layout of the rows.  All of it is part of the plan (a scalar subquery; no
    job runs here): its task holds ``OVERSAMPLE`` keys for every ``rows`` rows,
    and one key for every ``rows`` rows is searched in halves for each row.
    NULLs come first, as in Spark's ascending order.
    """
    every = max(1, min(OVERSAMPLE, rows))
    drawn = df.where(F.pmod(F.xxhash64(*order), F.lit(max(1, rows // every))) == 0)
    cuts = F.filter(F.sort_array(F.collect_set(F.struct(*order))), lambda c, i: (i + 1) % every == 0)
    # the subquery is named once, so the projections merge and no row carries the cut points
    search = F.struct(F.col("_cuts").alias("cuts"), F.struct(*order).alias("key"))
    return (df.withColumn("_cuts", drawn.agg(cuts).scalar())
              .withColumn("_range", F.transform(F.array(search), _cuts_below)[0]).drop("_cuts"))


def _cuts_below(search: Column) -> Column:
    """How many of the ascending ``search.cuts`` lie below ``search.key``."""
    widest = F.floor(F.log2(F.size(search["cuts"]) + 1)).cast("int") + 1
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.reduce(
        F.sequence(widest, F.lit(0), F.lit(-1)), F.lit(0),
        lambda found, k: F.when(F.get(search["cuts"], found + power(k) - 1) < search["key"], found + power(k)).otherwise(found))


def record_pop(df: DataFrame, order: Sequence[str], metrics=("CommitmentAmt", "OutstandingAmt"),
               rows: int = RANGE_ROWS) -> DataFrame:
    """Record-level change against the previous record in ``order``.

    ``(x_i - x_{i-1}) / x_{i-1}``, 0 for the first record and for a zero
    prior; NULL when either value is NULL.  Rows equal in ``order`` follow
    each other by their metrics.  No single-task window, no stored copy and no
    job while the plan is built: the rows are shuffled once by their range
    (``with_ranges``; a hot period spans many), the previous row is found
    inside the range, and a range's first row takes the last row of the range
    before it from the same shuffle (one row per range).
    """
    cols = list(dict.fromkeys([*order, *metrics]))
    ranged = with_ranges(df.select(*cols), cols, rows).repartition("_range")
    w = Window.partitionBy("_range").orderBy(*cols)
    inside = ranged.select("*", F.row_number().over(w).alias("_rn"),
                           *[F.lag(m).over(w).alias(f"_p_{m}") for m in metrics])
    last = ranged.groupBy("_range").agg(F.max(F.struct(*cols)).alias("_last"))
    by_range = Window.orderBy("_range")          # one row per range
    carry = last.select("_range", *[F.lag(F.col(f"_last.{m}")).over(by_range).alias(f"_c_{m}") for m in metrics],
                        F.lag("_range").over(by_range).alias("_before"))
    out = join_on(inside, carry, ["_range"], "left")
    first = F.col("_rn") == 1
    short = {"CommitmentAmt": "ca_perc_diff", "OutstandingAmt": "oa_perc_diff", "Deals": "deals_perc_diff"}
    for m in metrics:
        prev = F.when(first, F.col(f"_c_{m}")).otherwise(F.col(f"_p_{m}")).cast("double")
        x = F.col(m).cast("double")
        change = (F.when(first & F.col("_before").isNull(), F.lit(0.0))
                   .when(prev.isNull() | x.isNull(), F.lit(None).cast("double"))
                   .when(prev == 0, F.lit(0.0))
                   .otherwise(F.try_divide(x - prev, prev)))
        out = out.withColumn(short.get(m, f"{m}_perc_diff"), change)
    return out.drop("_range", "_rn", "_before", *[f"_p_{m}" for m in metrics], *[f"_c_{m}" for m in metrics])
