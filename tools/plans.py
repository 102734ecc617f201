"""Final plans in brief: python tools/plans.py [sf_dir] > PLANS.md

Runs a few queries over a stored tape and lists what the executed (adaptive)
plan scans, exchanges and reuses.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])


def brief(df) -> list[str]:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    plan = re.sub(r"#\d+L?", "", plan)
    out = []
    for scan in re.findall(r"FileScan parquet \[[^\]]*\].*", plan):
        columns = re.search(r"\[([^\]]*)\]", scan)[1]
        pushed = re.search(r"PushedFilters: \[(.*?)\](?:, ReadSchema|$)", scan)
        parts = re.search(r"PartitionFilters: \[(.*?)\](?:, PushedFilters)", scan)
        out.append(f"scan of {columns}; partition filters [{parts[1] if parts else ''}]; pushed [{pushed[1][:160] if pushed else ''}]")
    keys = re.findall(r"Exchange (?:hashpartitioning\((.*?), \d+\)|(SinglePartition)|rangepartitioning\((.*?), \d+\))", plan)
    out.append("exchanges by: " + ("; ".join("".join(k) for k in keys) or "none"))
    nodes = ("ReusedExchange", "BroadcastHashJoin", "SortMergeJoin", "Window", "Generate", "Expand", "TakeOrderedAndProject", "Python")
    out.append(", ".join(f"{n} {len(re.findall(rf'[ -]{n}', plan))}" for n in nodes))
    return out


def main() -> None:
    from ledgerlens.config import CapConfig
    from ledgerlens.operators import aggregates as AG
    from ledgerlens.operators import composite as C
    from ledgerlens.operators import series as S
    from ledgerlens.operators.filters import FilterSpec
    from ledgerlens.plans import analysis as A
    from ledgerlens.plans import report as R
    from ledgerlens.plans import templates as TP
    from ledgerlens.session import local_session
    from ledgerlens.sources import files as FS
    from ledgerlens.sources.tape import TIE_BREAK, tape_from_tables

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(os.environ.get("CHECK_CPUS", "8"))
    with tempfile.TemporaryDirectory() as tmp:
        FS.write_tape(tape_from_tables(spark, sf), f"{tmp}/tape")
        tape = FS.read_stored_tape(spark, f"{tmp}/tape")
        spec = FilterSpec.of(sba=["SBA"], dates=[{"operator": "greaterThan", "startDate": "1998-01-31"}])
        cells = A.reduced_cells(tape)
        plans = {
            "E2 capped vs uncapped": A.capped_vs_uncapped(tape),
            "E2, NaN semantics": A.capped_vs_uncapped(tape, None, CapConfig(missing="nan")),
            "E2, SBA rows since 1998": A.capped_vs_uncapped(tape, spec),
            "E3, eight templates": TP.run_templates(tape),
            "E7, three caps": A.cap_sensitivity(tape, (0.05, 0.1, 0.2)),
            "W12 wide panel": C.wide_panel(C.composite_parts(cells), C.bank_ids(tape)),
            "W13 record-level change": S.record_pop(tape, ["ProcessingDateKey", *TIE_BREAK]),
            "W11 metric summary": S.metric_summary(S.period_totals(tape), ("CommitmentAmt", "OutstandingAmt", "Deals")),
            "A10 filter options": AG.filter_options(tape),
            "A11 summary statistics": AG.summary_stats(tape),
            "A12 latest month": AG.latest_month_stats(tape),
            "O1 detail query, 1000 rows": AG.detail_query(tape, spec, 1000, TIE_BREAK),
            "E5 bundle options": R.bundle_options(tape),
        }
        print(f"# Plans in brief\n\nWritten by `tools/plans.py` over the stored tape ({os.path.basename(sf)}), after adaptive execution.")
        for name, df in plans.items():
            print(f"\n## {name}\n")
            for line in brief(df):
                print(f"- {line}")


if __name__ == "__main__":
    main()
