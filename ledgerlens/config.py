"""Schemas, business constants and the cap configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the original application's business rules) -------------
MAX_BANK_CELL_WEIGHT = 0.5
MAX_MOM = 0.1
MAX_MOM_HIGH = 0.2
HIGH_BREACH_PERC = 0.5
RESIDUAL_LIMIT = 1000
SBA_LOB_ID = "12"
SBA_CLASSES = ("SBA", "Non-SBA")
# ---------------------------------------------------------------------------

AMOUNT = T.DecimalType(18, 2)
TOTAL = T.DecimalType(38, 2)

TAPE_SCHEMA = T.StructType([
    T.StructField("ProcessingDateKey", T.IntegerType(), False),
    T.StructField("CommitmentAmt", AMOUNT),
    T.StructField("OutstandingAmt", AMOUNT),
    T.StructField("Region", T.StringType()),
    T.StructField("NAICSGrpName", T.StringType()),
    T.StructField("CommitmentSizeGroup", T.StringType()),
    T.StructField("RiskGroupDesc", T.StringType()),
    T.StructField("LineofBusinessId", T.StringType()),
    T.StructField("CurrentMaturityDateKey", T.IntegerType()),
    T.StructField("BankID", T.StringType()),
    T.StructField("size_SortOrder", T.IntegerType()),
    T.StructField("MaturityTermMonths", T.IntegerType()),
    T.StructField("tenor_SortOrder", T.IntegerType()),
    T.StructField("SpreadBPS", T.DecimalType(10, 2)),
    T.StructField("YieldPct", T.DecimalType(10, 6)),
    T.StructField("TotalCreditRelationship", AMOUNT),
    T.StructField("RelativeValue", T.IntegerType()),
    T.StructField("LineofBusiness", T.StringType()),
    T.StructField("NAICSGrpCode", T.IntegerType()),
])

TAPE_COLUMNS = [f.name for f in TAPE_SCHEMA.fields]

RESULT_COLUMNS = [
    "ProcessingDateKey", "CommitmentAmt", "Deals", "OutstandingAmt",
    "ProcessingDateKeyPrior", "CommitmentAmtPrior", "OutstandingAmtPrior",
    "DealsPrior", "ca_diff", "oa_diff", "deals_diff",
    "ca_model_diff", "oa_model_diff", "deals_model_diff",
]

# metric short name -> cell column
METRICS = (("ca", "CommitmentAmt"), ("oa", "OutstandingAmt"), ("deals", "Deals"))


def low_limit(m):
    """Down-cap paired with an up-cap ``m`` so that up then down is neutral."""
    return -m / (1 + m)


@dataclass(frozen=True)
class CapConfig:
    """Parameters of the capped composite.

    ``max_mom`` may be a float or a Column (a per-scope cap, see
    ``cap_sensitivity``).  ``missing`` picks how a bank absent from a
    period is treated: ``"exclude"`` (not counted, not a breach,
    contributes nothing) or ``"nan"`` (counted as an upper breach and
    voids the composite of that period and the next).
    """

    cell_weight: float = MAX_BANK_CELL_WEIGHT
    max_mom: float | Column = MAX_MOM
    max_mom_high: float = MAX_MOM_HIGH
    high_breach_perc: float = HIGH_BREACH_PERC
    missing: str = "exclude"

    def __post_init__(self):
        if self.missing not in ("exclude", "nan"):
            raise ValueError("missing must be 'exclude' or 'nan'")

    def col(self, v) -> Column:
        return v if isinstance(v, Column) else F.lit(float(v))

    @property
    def hi(self) -> Column:
        return self.col(self.max_mom)

    @property
    def lo(self) -> Column:
        return low_limit(self.hi)

    @property
    def hi_high(self) -> Column:
        return self.col(self.max_mom_high)

    @property
    def lo_high(self) -> Column:
        return low_limit(self.hi_high)
