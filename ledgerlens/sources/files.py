"""File and database sources/sinks."""

from __future__ import annotations

import logging
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TAPE_SCHEMA
from ..operators import aggregates as AG
from ..operators import series as S
from ..session import materialize

log = logging.getLogger(__name__)

NULL_TOKENS = ("NULL", "null", "")
#: Integer columns whose text must be an integer for the row to be kept.
STRICT = ("size_SortOrder", "tenor_SortOrder", "RelativeValue", "NAICSGrpCode")
# filter dimensions, most selective-by-use first (row-group clustering)
SORT_COLUMNS = ("Region", "LineofBusinessId", "CommitmentSizeGroup", "RiskGroupDesc", "BankID")


# ------------------------------------------------------------------------ S1
BAD_LINE = "_bad_line"


def read_lines(spark: SparkSession, path: str, header: list[str], sep: str = "\t") -> DataFrame:
    """The lines as text columns named by ``header``; a line with too many or
    too few fields or broken quotes is kept whole in ``BAD_LINE``."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField(BAD_LINE, T.StringType())])
    return spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("nullValue", "\u0000") \
        .option("enforceSchema", True).option("columnNameOfCorruptRecord", BAD_LINE).schema(schema).csv(path)


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_tape(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Tab-separated tape with a header; every column read as text, then
    cleaned with explicit types (no inference).  Lines that don't have the
    header's fields are left out; ``rejected_lines`` reports them."""
    raw = read_lines(spark, path, _header(spark, path, sep), sep)
    return clean_tape(raw.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE))


def rejected_lines(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Every line that ``read_tape`` leaves out: ``reason`` and ``line``.

    Reasons: ``malformed line`` (number of fields, quotes), ``no processing
    date``, ``no integer: <column>`` (the first strict column that fails).  A
    row of the tape and a rejected line together are all lines read.
    """
    header = _header(spark, path, sep)
    raw = read_lines(spark, path, header, sep)
    whole = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in header])
    reason = F.when(F.col(BAD_LINE).isNotNull(), "malformed line").otherwise(rejection(raw))
    return raw.select(reason.alias("reason"), F.coalesce(BAD_LINE, whole).alias("line")).where("reason is not null")


# ------------------------------------------------------------------------ S2
def _tape_values(raw: DataFrame) -> tuple[dict[str, Column], list[tuple[str, Column]]]:
    """The typed value of every tape column, and the strict columns with
    whether their text is good."""
    have = {c.lower(): c for c in raw.columns}
    values, checks = {}, []
    for f in TAPE_SCHEMA.fields:
        src = have.get(f.name.lower())
        if src is None:
            values[f.name] = F.lit(None).cast(f.dataType)
            continue
        txt = F.col(f"`{src}`").cast("string")
        txt = F.when(~txt.isin(*NULL_TOKENS), txt)
        if isinstance(f.dataType, T.StringType):
            val = txt
        elif isinstance(f.dataType, T.IntegerType):
            number = txt.try_cast("decimal(38,6)")
            if f.name in STRICT:
                val = F.when(number == F.floor(number), number.try_cast("int"))
                checks.append((f.name, txt.isNull() | val.isNotNull()))
            else:
                val = number.try_cast("int")
        else:
            val = txt.try_cast(f.dataType)
        if f.name == "CurrentMaturityDateKey":
            val = F.when(val != -1, val)
        values[f.name] = val
    return values, checks


def rejection(raw: DataFrame) -> Column:
    """Why ``clean_tape`` drops a row; NULL for a row that it keeps."""
    values, checks = _tape_values(raw)
    reason = F.when(values["ProcessingDateKey"].isNull(), "no processing date")
    for name, good in checks:
        reason = reason.when(~good, f"no integer: {name}")
    return reason


def clean_tape(raw: DataFrame) -> DataFrame:
    """Typed tape rows from text columns; output follows ``TAPE_SCHEMA``
    (missing columns NULL).

    NULL tokens become NULL; text is kept as it is (no trimming).  Amounts go
    straight from text to DECIMAL, so every digit counts.  Dates, amounts and
    the maturity term are lenient: what is no number is NULL; so is a
    maturity of ``-1``.  The other integer columns (``STRICT``) are strict: a
    row in which one of them is no integer is dropped, like a row without a
    processing date (``rejection`` says why).
    """
    values, checks = _tape_values(raw)
    good = F.lit(True)
    for _, check in checks:
        good &= check
    return raw.where(good).select(*[v.alias(c) for c, v in values.items()]).filter(F.col("ProcessingDateKey").isNotNull())


# ------------------------------------------------------------------------ S3
def jdbc_options(url: str, query: str | None = None, table: str | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 num_partitions: int = 64, fetchsize: int = 100_000, properties: dict | None = None) -> dict:
    """Options for Spark's JDBC source.

    A partitioned read (``partition_column`` with bounds, e.g. the
    processing date key) is split into ``num_partitions`` parallel range
    queries; since the source does not accept ``query`` together with
    ``partitionColumn``, a query is then passed as a sub-select table.
    """
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    opts = {"url": url, "fetchsize": str(fetchsize)}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds")
        opts["dbtable"] = table if table is not None else f"({query}) AS src"
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower),
                     "upperBound": str(upper), "numPartitions": str(num_partitions)})
    elif query is not None:
        opts["query"] = query
    else:
        opts["dbtable"] = table
    opts.update({k: str(v) for k, v in (properties or {}).items()})
    return opts


def read_jdbc(spark: SparkSession, url: str, **kw) -> DataFrame:
    """SQL query or table over JDBC, fetched in chunks of ``fetchsize``;
    filters and projections applied afterwards are pushed to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, **kw)).load()


# ------------------------------------------------------------------------ S4
def load_tape(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """Primary source with a file fallback; rows tagged ``source``.

    The primary is read whole and staged in the shared folder before it
    counts, so a source that fails in a later partition falls back too.
    Connection and read errors (and an empty primary) lead to the fallback
    and are logged; any other error is the caller's to see, a query that
    can't be analysed or parsed among them.
    """
    try:
        df = materialize(primary(), "primary")
        if not df.isEmpty():
            return df.withColumn("source", F.lit("database"))
        log.warning("the primary source is empty; reading the file instead")
    except (PySparkException, Py4JJavaError, OSError) as cause:
        if isinstance(cause, (AnalysisException, ParseException)) and cause.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("the primary source can't be read (%s); reading the file instead", cause)
    return fallback().withColumn("source", F.lit("csv_fallback"))


# ------------------------------------------------------------------------ S5
def write_tape(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cleaned tape as parquet, partitioned by processing month, so period
    filters prune whole directories.

    ``rebalance`` by month: one shuffle, after which adaptive execution
    splits an oversized month (say one holding a third of all rows) into
    advisory-size tasks and merges small ones - no sampling pass over the
    input and no single task writing a hot month.  Within each file rows
    are sorted by the usual filter dimensions, so parquet row-group
    statistics let pushed-down filters skip row groups.
    """
    (df.hint("rebalance", "ProcessingDateKey")
       .sortWithinPartitions("ProcessingDateKey", *SORT_COLUMNS)      # month first: the writer keeps this order
       .write.mode(mode).partitionBy("ProcessingDateKey").parquet(path))


def replace_months(df: DataFrame, path: str) -> dict[int, int]:
    """Reloads the months that ``df`` holds into the tape at ``path``; files
    of other months stay as they are.

    The new rows are staged in the shared folder first and counted there, so
    a source that fails half-way, or that holds a row without a month
    (ValueError), changes nothing.  Returns the rows written per month.  An
    empty ``df`` replaces nothing; a new month is added.
    """
    staged = materialize(df, "months")
    counts = {r["ProcessingDateKey"]: r["n"] for r in staged.groupBy("ProcessingDateKey").agg(F.count("*").alias("n")).collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no processing date")
    if counts:
        (staged.hint("rebalance", "ProcessingDateKey").sortWithinPartitions("ProcessingDateKey", *SORT_COLUMNS)
               .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy("ProcessingDateKey").parquet(path))
    return counts


def read_stored_tape(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------------------ S8
def write_bundle(bundle: dict[str, DataFrame], out_dir: str) -> None:
    """JSON lines per part, written in parallel (the raw rows are a part)."""
    for name, df in bundle.items():
        df.write.mode("overwrite").json(f"{out_dir}/{name}")


# ------------------------------------------------------------------------ S11
def register_views(spark: SparkSession, tape: DataFrame) -> None:
    """Temp views ``analytics_summary`` and ``aggregated_analytics``."""
    tape.createOrReplaceTempView("analytics_data")
    AG.analytics_summary(tape).createOrReplaceTempView("analytics_summary")
    aggregated_analytics(tape).createOrReplaceTempView("aggregated_analytics")


def aggregated_analytics(tape: DataFrame) -> DataFrame:
    """The ``aggregated_analytics`` view: rows with an amount, COUNT(*)
    deals, SQL sums, then the ``view`` PoP variant."""
    totals = S.period_totals(tape.filter(F.col("CommitmentAmt").isNotNull()), deals="rows")
    return S.pop_change(totals, "view")
