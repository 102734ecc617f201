"""``aggregated_analytics`` as a stored table, kept up to date by month.

One row per period, partitioned by ``period`` (the processing date key).  New
rows are reduced to one partial per month before they meet the table; only
the months they touch, and the month after each (its prior values change),
are written again.  What is written is staged in the shared folder first.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TOTAL
from ..operators import series as S
from ..session import materialize

PERIOD = "period"
COLUMNS = {
    "ProcessingDateKey": "string", "CommitmentAmt": TOTAL.simpleString(), "Deals": "long", "OutstandingAmt": TOTAL.simpleString(),
    "ProcessingDateKeyPrior": "string", "CommitmentAmtPrior": TOTAL.simpleString(), "OutstandingAmtPrior": TOTAL.simpleString(),
    "DealsPrior": "long", "ca_diff": "double", "oa_diff": "double", "deals_diff": "double", "ca_model_diff": "double",
    "oa_model_diff": "double", "deals_model_diff": "double", PERIOD: "int",
}


def _partials(tape: DataFrame) -> DataFrame:
    rows = tape.filter(F.col("CommitmentAmt").isNotNull())
    return S.period_totals(rows, deals="rows").withColumn(S.DATE, F.col(S.DATE).cast("int"))


def _rows(totals: DataFrame) -> DataFrame:
    """The table's rows for totals per period (``_new`` is kept)."""
    rows = S.pop_change(totals.withColumn(PERIOD, F.col(S.DATE)), "view")
    return rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in COLUMNS.items()], *[c for c in rows.columns if c == "_new"])


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())).parquet(path)


def build_periods(tape: DataFrame, path: str) -> None:
    """Writes the table anew from the whole tape (rows without an amount don't
    count; an empty tape gives an empty table)."""
    _rows(_partials(tape)).write.mode("overwrite").partitionBy(PERIOD).parquet(path)


def _stored_totals(spark: SparkSession, path: str) -> DataFrame:
    return read_periods(spark, path).select(F.col(PERIOD).alias(S.DATE), "CommitmentAmt", "Deals", "OutstandingAmt",
                                            F.lit(False).alias("_new"))


def _publish(totals: DataFrame, path: str) -> list[int | None]:
    """Writes the months marked ``_new`` and the one after each."""
    after = F.lag("_new", 1, False).over(Window.orderBy(S.DATE))              # one row per month
    changed = _rows(totals.withColumn("_new", F.col("_new") | after)).where("_new").drop("_new")
    staged = materialize(changed, "periods")
    months = sorted((r[PERIOD] for r in staged.select(PERIOD).collect()), key=lambda m: (m is not None, m))
    if months:
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)
    return months


def add_rows(rows: DataFrame, path: str) -> list[int | None]:
    """Adds further tape rows, of any months, to the table; returns the months
    written.  The rows are counted on top of what is stored, so a batch given
    twice counts twice (``reload_months`` starts from the tape instead)."""
    part = _partials(rows).withColumn("_new", F.lit(True))
    both = materialize(_stored_totals(rows.sparkSession, path).unionByName(part), "partials")
    totals = both.groupBy(S.DATE).agg(F.sum("CommitmentAmt").cast(TOTAL).alias("CommitmentAmt"), F.sum("Deals").alias("Deals"),
                                      F.sum("OutstandingAmt").cast(TOTAL).alias("OutstandingAmt"), F.max("_new").alias("_new"))
    return _publish(totals, path)


def reload_months(tape: DataFrame, months: Sequence[int], path: str) -> list[int | None]:
    """Counts ``months`` again from the tape (only they are read of it) and
    returns the months written.  If one of them has no rows any more it
    leaves the table, which is then written whole."""
    wanted = [int(m) for m in months]
    spark = tape.sparkSession
    part = _partials(tape.where(F.col(S.DATE).isin(wanted))).withColumn("_new", F.lit(True))
    kept = _stored_totals(spark, path).where(F.col(S.DATE).isNull() | ~F.col(S.DATE).isin(wanted))
    totals = materialize(kept.unionByName(part), "partials")
    stored = read_periods(spark, path).where(F.col(PERIOD).isin(wanted)).select(F.col(PERIOD).alias(S.DATE))
    gone = stored.join(totals, S.DATE, "left_anti")
    if gone.isEmpty():
        return _publish(totals, path)
    whole = materialize(_rows(totals).drop("_new"), "periods")
    whole.write.mode("overwrite").partitionBy(PERIOD).parquet(path)
    return [r[PERIOD] for r in whole.select(PERIOD).orderBy(PERIOD).collect()]
