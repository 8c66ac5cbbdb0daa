"""Per-query physical-plan summary (after execution, AQE final plans).

Usage: python tools/plan_report.py [sf_dir]
Counts the operators each query runs on top of the study's cached tables
(cached subplans are not counted again; a subquery used several times counts
once): shuffles, broadcasts, joins, windows, sorts, top-k, scalar subqueries
and file scans. Prints a markdown table.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trolley.plans import catalog  # noqa: E402
from tools.plan_inspect import KINDS, execute, operator_counts  # noqa: E402
from trolley.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    print("| query | " + " | ".join(KINDS) + " |")
    print("| --- " * (len(KINDS) + 1) + "|")
    for name, fn in catalog.QUERIES().items():
        df = fn(spark, sf_dir)
        execute(df)
        counts = operator_counts(df)
        print(f"| {name} | " + " | ".join(str(counts[k]) for k in KINDS) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
