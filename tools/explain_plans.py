"""Write the physical plans of the key operators to docs/plans.md.

Usage: python tools/explain_plans.py [sf_dir]
Each plan is the formatted explain tree (operators, exchanges, scans with
their ReadSchema/PushedFilters), captured before execution.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from specweave.operators import metrics as M  # noqa: E402
from specweave.operators import rules as R  # noqa: E402
from specweave.operators.runs import consecutive_runs  # noqa: E402
from specweave.plans import jobs as J  # noqa: E402
from specweave.plans import views as V  # noqa: E402
from specweave.session import get_spark  # noqa: E402
from specweave.sources import fixtures as FX  # noqa: E402
from specweave.sources import parquet as PQ  # noqa: E402


def formatted(df) -> str:
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    tree, _, details = text.partition("\n\n\n")
    scans = [b.strip() for b in details.split("\n\n") if re.match(r"\(\d+\) Scan", b.strip())]
    keep = []
    for b in scans:
        lines = [ln for ln in b.splitlines() if ln.startswith(("(", "ReadSchema", "PushedFilters", "PartitionFilters", "PushedAggregation", "PushedGroupBy"))]
        keep.append("\n".join(ln[:160] for ln in lines))
    return tree.strip() + "\n\n" + "\n\n".join(keep)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    view = V.text_view(spark, sf, "hcir")
    ref = FX.molecule_ref(spark, sf)
    from specweave.plans.queries import _hcir_converted
    out = _hcir_converted(spark, sf)
    plans = {
        "J1 input: aligned text -> parsed lines (line numbers, alignment join)": J.hcir_parsed(spark, view, 0, 64),
        "J2 input: enrichment join of the target lines, then the one exchange of lines": J.msms_parsed(spark, view, ref),
        "E1/E2 split summary over the fixture": M.hcir_split_summary(V.hcir(spark, sf).where(F.col("error").isNull())),
        "C16 first error per split": R.first_error_per_split(V.hcir(spark, sf, bad=True)),
        "E8 first 10 mismatches per split (rank filter)": M.mismatch_examples(V.msms(spark, sf).where(F.col("error").isNull())),
        "W1 consecutive runs (bucketed segmented scan)": consecutive_runs(FX.metric_samples(spark, sf), "user_id", "event_id",
                                                                          F.col("value") <= 20, 3),
        "F2 first rows of a written split (only the needed files)": PQ.first_rows(spark, f"{out}/split=test", 16),
    }
    with PQ._footer_aggregates(spark):  # planned while the footers' source is on
        counted = formatted(PQ.footer_counts(PQ.read_path(spark, out), "split"))
    parts = ["# Physical plans of the key operators\n",
             f"Generated by `tools/explain_plans.py` at `{sf}` (local session, AQE on; before execution,",
             "so AQE's runtime broadcast/coalesce decisions are not shown). Scan details list ReadSchema and",
             "pushed filters only.\n"]
    for title, df in plans.items():
        parts.append(f"## {title}\n\n```\n{formatted(df)}\n```\n")
    parts.append(f"## A10 row counts (answered by footers)\n\n```\n{counted}\n```\n")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans.md")
    with open(path, "w") as f:
        f.write("\n".join(parts))
    print("wrote", path)


if __name__ == "__main__":
    main()
