"""Filter specifications and the TSV source (FIXTURES §5)."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.operators.filters import (CommitmentRange, DateFilter, FilterSpec, iso_to_key, lob_id,
                                          normalise, predicate)
from ledgerlens.sources import files as FS

TSV = """ProcessingDateKey\tCommitmentAmt\tOutstandingAmt\tRegion\tLineofBusinessId\tBankID\tCurrentMaturityDateKey\tCommitmentSizeGroup
20240131\t1000\t500\tPacific\t12\t7\t20230101\t< $250K
20240131\tNULL\tnull\tPacific\t1\t8\t-1\t
20240229\tabc\t10\tRocky Mountain\t\t9\t20250101\tNULL
\t5\t5\tPacific\t1\t1\t\t
"""


def _tsv(tmp):
    p = os.path.join(tmp, "tape.tsv")
    with open(p, "w") as fh:
        fh.write(TSV)
    return p


def test_read_and_clean_tsv(spark):
    with tempfile.TemporaryDirectory() as tmp:
        df = FS.read_tape(spark, _tsv(tmp))
        rows = {r["BankID"]: r for r in df.collect()}
    assert set(rows) == {"7", "8", "9"}              # blank key row dropped
    assert rows["8"]["CommitmentAmt"] is None and rows["8"]["OutstandingAmt"] is None
    assert rows["8"]["CurrentMaturityDateKey"] is None   # -1 sentinel
    assert rows["9"]["CommitmentAmt"] is None            # non-numeric
    assert rows["9"]["LineofBusinessId"] is None and rows["9"]["CommitmentSizeGroup"] is None
    assert rows["7"]["LineofBusinessId"] == "12"         # ids stay text
    assert rows["8"]["LineofBusinessId"] == "1"


def test_normalise_and_labels():
    assert normalise(None) == () and normalise(["All"]) == () and normalise([]) == ()
    assert normalise("x") == ("x",)
    assert lob_id("11 - Commercial") == "11" and lob_id("12") == "12"
    assert iso_to_key("2024-01-31T23:30:00Z") == 20240131
    assert iso_to_key("2024-01-31T23:30:00-05:00") == 20240131   # own offset, no shift
    assert iso_to_key("garbage") is None
    assert not CommitmentRange(5, 1, "x").valid and not CommitmentRange(1, 5, " ").valid
    assert CommitmentRange(1, 5, "ok").valid


def _keys(spark, spec):
    rows = [(20240131, 12.0, "12", "Pacific", "7", 20230101, 500.0), (20240229, 2000.0, "1", "Pacific", "8", 20250101, 50.0),
            (20240331, 900.0, None, "Southwest", "9", None, 5.0), (20240331, 5000.0, "3", "Pacific", "7", 20240101, 5000.0)]
    df = spark.createDataFrame(rows, "ProcessingDateKey int, CommitmentAmt double, LineofBusinessId string, "
                                     "Region string, BankID string, CurrentMaturityDateKey int, OutstandingAmt double")
    p = predicate(spec)
    return sorted(r[0] for r in (df.filter(p) if p is not None else df).select("CommitmentAmt").collect())


def test_predicates(spark):
    assert _keys(spark, FilterSpec.of(sba=["SBA"])) == [12]
    assert _keys(spark, FilterSpec.of(sba=["Non-SBA"])) == [2000, 5000]          # NULL id dropped
    assert _keys(spark, FilterSpec.of(sba=["SBA", "non-sba"])) == [12, 2000, 5000]
    assert _keys(spark, FilterSpec.of(sba=["bogus"])) == [12, 900, 2000, 5000]   # unknown ignored
    assert _keys(spark, FilterSpec.of(sba=["SBA"], lob=["1", "2"])) == []       # contradiction
    assert _keys(spark, FilterSpec.of(lob=["3 - Other", "1"])) == [2000, 5000]
    assert _keys(spark, FilterSpec.of(regions=["All"])) == [12, 900, 2000, 5000]
    assert _keys(spark, FilterSpec.of(banks=[7])) == [12, 5000]
    assert _keys(spark, FilterSpec.of(ranges=[(10, 1000, "a"), (4000, 6000, "b"), (9, 1, "bad")])) == [12, 900, 5000]
    d = [DateFilter("greaterThan", "2024-02-29"), DateFilter("between", "2024-01-01")]
    assert _keys(spark, FilterSpec.of(dates=d)) == [900, 2000, 5000]
    d = [DateFilter("between", "2024-01-01T00:00:00Z", "2024-02-29"), DateFilter("equals", "nope")]
    assert _keys(spark, FilterSpec.of(dates=d)) == [12, 2000]
    assert _keys(spark, FilterSpec.of(dates=[DateFilter("lessThan", "2024-01-31")])) == [12]
    # residual: matured + small outstanding dropped; NULL maturity test dropped too
    assert _keys(spark, FilterSpec.of(residual=True)) == [2000, 5000]


def test_write_and_read_stored_tape(spark):
    with tempfile.TemporaryDirectory() as tmp:
        df = FS.read_tape(spark, _tsv(tmp))
        FS.write_tape(df, os.path.join(tmp, "stored"))
        back = FS.read_stored_tape(spark, os.path.join(tmp, "stored"))
        assert back.count() == 3
        assert back.filter(F.col("ProcessingDateKey") == 20240229).count() == 1


def test_load_tape_fallback(spark):
    def broken():
        raise ConnectionError("no database")
    df = FS.load_tape(broken, lambda: spark.range(2).withColumnRenamed("id", "x"))
    assert {r["source"] for r in df.collect()} == {"csv_fallback"}
    df = FS.load_tape(lambda: spark.range(1), lambda: spark.range(2))
    assert {r["source"] for r in df.collect()} == {"database"}


def test_jdbc_options():
    import pytest
    o = FS.jdbc_options("jdbc:postgresql://db/x", query="SELECT * FROM t", fetchsize=1000)
    assert o == {"url": "jdbc:postgresql://db/x", "fetchsize": "1000", "query": "SELECT * FROM t"}
    o = FS.jdbc_options("jdbc:x", query="SELECT * FROM t", partition_column="ProcessingDateKey",
                        lower=20200131, upper=20241231, num_partitions=48, properties={"user": "u"})
    assert o["dbtable"] == "(SELECT * FROM t) AS src" and "query" not in o
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"], o["user"]) == \
        ("ProcessingDateKey", "20200131", "20241231", "48", "u")
    assert FS.jdbc_options("jdbc:x", table="tape")["dbtable"] == "tape"
    with pytest.raises(ValueError):
        FS.jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        FS.jdbc_options("jdbc:x", table="t", partition_column="k")
