"""Sources and sinks: driver tables -> tape, TSV, JDBC, parquet, result files."""
