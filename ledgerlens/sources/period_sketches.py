"""A11 without counting again: one mergeable partial per month, stored.

A partial holds the rows with an amount, their sum, and a HyperLogLog sketch
of every column whose distinct values are counted.  Partials merge (rows and
sums add, sketches are united), so the whole-table statistics of any months
read one small row per month instead of the tape, and a late batch or a
reloaded month writes only its own months.  ``aggregates.summary_stats``
stays the exact form and the default.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TOTAL
from ..operators.filters import has_amount
from ..operators.series import DATE
from ..session import materialize

#: Statistic -> column whose distinct values it counts.
SKETCHED = {"unique_regions": "Region", "unique_lobs": "LineofBusinessId", "unique_banks": "BankID"}
#: 2**LG_K registers a sketch (one byte each).
LG_K = 12
PERIOD = "period"
SCHEMA = ", ".join([f"{DATE} string", "n long", f"ca {TOTAL.simpleString()}", *[f"{s} binary" for s in SKETCHED], f"{PERIOD} int"])


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a count from united sketches; counts far
    below the number of registers are exact."""
    return 1.04 / 2 ** (lg_k / 2)


def partials(tape: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """One partial per month (rows without an amount don't count, a null month
    is a month of its own); one partially aggregated pass over the tape."""
    sketches = [F.hll_sketch_agg(c, F.lit(lg_k)).alias(s) for s, c in SKETCHED.items()]
    cells = tape.filter(has_amount()).groupBy(DATE).agg(
        F.count(F.lit(1)).alias("n"), F.sum("CommitmentAmt").cast(TOTAL).alias("ca"), *sketches)
    return _named(cells)


def _named(cells: DataFrame) -> DataFrame:
    return cells.select(F.col(DATE).cast("string").alias(DATE), "n", "ca", *SKETCHED, F.col(DATE).cast("int").alias(PERIOD))


def merge(parts: DataFrame) -> DataFrame:
    """Partials of the same month become one; all must have the same ``lg_k``
    (Spark raises otherwise)."""
    return _named(parts.groupBy(DATE).agg(
        F.sum("n").alias("n"), F.sum("ca").cast(TOTAL).alias("ca"), *[F.hll_union_agg(s).alias(s) for s in SKETCHED]))


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def build_partials(tape: DataFrame, path: str, lg_k: int = LG_K) -> None:
    """Writes the table anew from the whole tape (an empty tape gives an empty table)."""
    partials(tape, lg_k).write.mode("overwrite").partitionBy(PERIOD).parquet(path)


def _publish(parts: DataFrame, path: str) -> None:
    """Replaces the months of ``parts``, staged in the shared folder first."""
    staged = materialize(parts, "partials")
    if not staged.isEmpty():
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)


def add_rows(rows: DataFrame, path: str, lg_k: int = LG_K) -> None:
    """Merges further rows, of any months, into their months' partials.

    ``lg_k`` must be the table's.  A batch given twice adds its rows and sums
    twice (the distinct counts don't change); ``reload_months`` starts from
    the tape instead.
    """
    new = materialize(partials(rows, lg_k), "partials")
    stored = read_partials(rows.sparkSession, path)
    touched = stored.join(new.select(F.col(PERIOD).alias("_p")), F.col(PERIOD).eqNullSafe(F.col("_p")), "left_semi")
    _publish(merge(touched.unionByName(new)), path)


def reload_months(tape: DataFrame, months: Sequence[int], path: str, lg_k: int = LG_K) -> None:
    """Counts ``months`` again from the tape; only they are read and written.
    A month without rows any more keeps a partial of no rows, which no
    statistic counts."""
    wanted = sorted({int(m) for m in months})
    if not wanted:
        return
    part = partials(tape.where(F.col(DATE).isin(wanted)), lg_k)
    names = [F.col(f.name) if f.name in (DATE, PERIOD) else (F.lit(0) if f.name == "n" else F.lit(None)).cast(f.dataType).alias(f.name)
             for f in part.schema]
    none = (tape.sparkSession.createDataFrame([(str(m), m) for m in wanted], f"{DATE} string, {PERIOD} int").select(*names))
    _publish(merge(part.unionByName(none)), path)


def stats(parts: DataFrame) -> DataFrame:
    """The columns of ``summary_stats`` from partials of any months.

    Rows, sums, months and dates are exact; distinct counts are estimates with
    the relative standard error ``standard_error(lg_k)``.
    """
    counted = parts.where("n > 0")
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_records"),
        F.count(PERIOD).alias("unique_months"),
        F.min(PERIOD).alias("earliest_date"),
        F.max(PERIOD).alias("latest_date"),
        F.sum("ca").cast(TOTAL).alias("total_commitment"),
        F.try_divide(F.sum("ca").cast("double"), F.sum("n").cast("double")).alias("avg_commitment"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(s)), F.lit(0)).cast("long").alias(s) for s in SKETCHED])
