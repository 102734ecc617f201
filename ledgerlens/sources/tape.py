"""Map the driver's star-schema tables onto a monthly loan tape.

``lineitem`` rows become deals, ``orders`` give the processing month and
risk grade, ``customer -> nation -> region`` give the bank and region,
``part`` the line of business and NAICS group.  The same mapping is
available as a SQL common-table expression (``TAPE_CTE``) so that every
DuckDB oracle starts from identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AMOUNT, TAPE_COLUMNS

# --- fixed values: mapping of driver codes to tape labels ------------------
REGION_BY_NAME = (
    ("AFRICA", "Rocky Mountain"),
    ("AMERICA", "Southwest"),
    ("ASIA", "Northeast"),
    ("EUROPE", "Pacific"),
    ("MIDDLE EAST", "Southeast"),
)
RISK_BY_PRIORITY = (
    ("1", "High Quality"),
    ("2", "Pass"),
    ("3", "Special Mention"),
    ("4", "Substandard"),
    ("5", "Doubtful"),
)
# upper bound (exclusive) on l_extendedprice -> size group; last is open
SIZE_BANDS = (
    (10000, "< $250K"),
    (25000, "$250K - $1MM"),
    (50000, "$1MM - $5MM"),
    (75000, "$5MM - $10MM"),
    (90000, "$10MM - $25MM"),
)
SIZE_TOP = "> $25MM"
NULL_COMMITMENT_LINE = 7     # l_linenumber with a NULL commitment
NULL_MATURITY_SIZE = 1       # p_size with a NULL maturity date
# ---------------------------------------------------------------------------

# Columns that make a tape row unique (order used as the final tie-break).
TIE_BREAK = ["DealOrderKey", "DealLineNumber", "DealPartKey", "DealSuppKey", "DealPrice"]

TAPE_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")


def _ymd(c: Column) -> Column:
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def _lookup(c: Column, pairs, default=None) -> Column:
    expr = None
    for k, v in pairs:
        expr = (F.when(c == k, v) if expr is None else expr.when(c == k, v))
    return expr.otherwise(default) if default is not None else expr


# Column types of the driver tables we read (the data contract).
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
}


def read_tables(spark: SparkSession, sf_dir: str, names=TAPE_TABLES) -> dict[str, DataFrame]:
    """Parquet readers with the declared schemas (no footer inference)."""
    return {n: spark.read.schema(TABLE_SCHEMAS[n]).parquet(f"{sf_dir}/{n}.parquet") if n in TABLE_SCHEMAS
            else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def tape_from_tables(spark: SparkSession, sf_dir: str, with_tie_break: bool = True) -> DataFrame:
    """The loan tape as a lazy join of the driver tables.

    Join order follows the foreign keys from the fact side; no broadcast
    hints: the planner broadcasts ``nation``/``region`` from their file
    statistics and AQE re-plans the others from runtime sizes, so no side
    whose size grows with the data is forced into memory.
    """
    t = read_tables(spark, sf_dir)
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                              "l_shipdate")
    od = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cu = t["customer"].select("c_custkey", "c_nationkey")
    na = t["nation"].select("n_nationkey", "n_regionkey")
    rg = t["region"].select("r_regionkey", "r_name")
    pt = t["part"].select("p_partkey", "p_type", "p_size")

    j = (li.join(od, li.l_orderkey == od.o_orderkey)
           .join(cu, F.col("o_custkey") == cu.c_custkey)
           .join(na, F.col("c_nationkey") == na.n_nationkey)
           .join(rg, F.col("n_regionkey") == rg.r_regionkey)
           .join(pt, F.col("l_partkey") == pt.p_partkey))

    price = F.col("l_extendedprice").cast(AMOUNT)
    size = None
    for bound, label in SIZE_BANDS:
        cond = F.col("l_extendedprice") < bound
        size = F.when(cond, label) if size is None else size.when(cond, label)
    size = size.otherwise(SIZE_TOP)

    cols = {
        "ProcessingDateKey": _ymd(F.last_day(F.col("o_orderdate"))).cast("int"),
        "CommitmentAmt": F.when(F.col("l_linenumber") == NULL_COMMITMENT_LINE, F.lit(None).cast(AMOUNT))
                          .otherwise(price),
        "OutstandingAmt": (price * F.col("l_discount").cast(AMOUNT)).cast(AMOUNT),
        "Region": _lookup(F.col("r_name"), REGION_BY_NAME),
        "NAICSGrpName": F.col("p_type"),
        "CommitmentSizeGroup": size,
        "RiskGroupDesc": _lookup(F.substring("o_orderpriority", 1, 1), RISK_BY_PRIORITY),
        "LineofBusinessId": F.col("p_size").cast("string"),
        "CurrentMaturityDateKey": F.when(F.col("p_size") == NULL_MATURITY_SIZE, F.lit(None).cast("int"))
                                   .otherwise(_ymd(F.col("l_shipdate")).cast("int")),
        "BankID": F.col("n_nationkey").cast("string"),
        "size_SortOrder": F.lit(None).cast("int"),
        "MaturityTermMonths": F.col("l_quantity").cast("int"),
        "tenor_SortOrder": F.lit(None).cast("int"),
        "SpreadBPS": (F.col("l_tax") * 10000).cast("decimal(10,2)"),
        "YieldPct": F.col("l_tax").cast("decimal(10,6)"),
        "TotalCreditRelationship": F.lit(None).cast(AMOUNT),
        "RelativeValue": F.lit(None).cast("int"),
        "LineofBusiness": F.when(F.col("p_size") == 12, "SBA").otherwise("Commercial"),
        "NAICSGrpCode": F.lit(None).cast("int"),
    }
    out = [cols[c].alias(c) for c in TAPE_COLUMNS]
    if with_tie_break:
        out += [F.col("l_orderkey").alias("DealOrderKey"), F.col("l_linenumber").alias("DealLineNumber"),
                F.col("l_partkey").alias("DealPartKey"), F.col("l_suppkey").alias("DealSuppKey"),
                price.alias("DealPrice")]
    return j.select(*out)


def _sql_case(expr: str, pairs) -> str:
    whens = " ".join(f"WHEN {expr} = '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {whens} END"


def _sql_size() -> str:
    whens = " ".join(f"WHEN l.l_extendedprice < {b} THEN '{lab}'" for b, lab in SIZE_BANDS)
    return f"CASE {whens} ELSE '{SIZE_TOP}' END"


def _sql_ymd(e: str) -> str:
    return f"(year({e}) * 10000 + month({e}) * 100 + day({e}))"


TAPE_CTE = f"""tape AS (
  SELECT
    CAST({_sql_ymd('last_day(o.o_orderdate)')} AS INTEGER) AS ProcessingDateKey,
    CASE WHEN l.l_linenumber = {NULL_COMMITMENT_LINE} THEN CAST(NULL AS DECIMAL(18,2))
         ELSE CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS CommitmentAmt,
    CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS OutstandingAmt,
    {_sql_case('r.r_name', REGION_BY_NAME)} AS Region,
    p.p_type AS NAICSGrpName,
    {_sql_size()} AS CommitmentSizeGroup,
    {_sql_case('substr(o.o_orderpriority, 1, 1)', RISK_BY_PRIORITY)} AS RiskGroupDesc,
    CAST(p.p_size AS VARCHAR) AS LineofBusinessId,
    CASE WHEN p.p_size = {NULL_MATURITY_SIZE} THEN CAST(NULL AS INTEGER)
         ELSE CAST({_sql_ymd('l.l_shipdate')} AS INTEGER) END AS CurrentMaturityDateKey,
    CAST(n.n_nationkey AS VARCHAR) AS BankID,
    CAST(NULL AS INTEGER) AS size_SortOrder,
    CAST(l.l_quantity AS INTEGER) AS MaturityTermMonths,
    CAST(NULL AS INTEGER) AS tenor_SortOrder,
    CAST(l.l_tax * 10000 AS DECIMAL(10,2)) AS SpreadBPS,
    CAST(l.l_tax AS DECIMAL(10,6)) AS YieldPct,
    CAST(NULL AS DECIMAL(18,2)) AS TotalCreditRelationship,
    CAST(NULL AS INTEGER) AS RelativeValue,
    CASE WHEN p.p_size = 12 THEN 'SBA' ELSE 'Commercial' END AS LineofBusiness,
    CAST(NULL AS INTEGER) AS NAICSGrpCode,
    l.l_orderkey AS DealOrderKey, l.l_linenumber AS DealLineNumber,
    l.l_partkey AS DealPartKey, l.l_suppkey AS DealSuppKey,
    CAST(l.l_extendedprice AS DECIMAL(18,2)) AS DealPrice
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""
