"""Write PLANS.md: physical-plan summary of the main operators (lazy end-to-end plans).

usage: python -m tools.plans [sf_dir]
"""
from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")


NOTES = """## Notes

* Written stages: the six feature tables, customer payments, event store, source days, the overdue candidates, value counts
  of quantiles and ranks.
* S7 below event level reads one table of at most `horizon_days + 1` rows per source.
* RE-8 scores narrow candidates, takes the top rows, and only then reads their predictions.
* Quantiles rank distinct values (range partitions and prefix counts); no window orders rows.
* Broadcasts: one-row scalars, winner dates (bounded by the horizon), class counts, partition offsets, top-k unions.
"""


def summary(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "exchanges": plan.count("Exchange "), "scans": len(re.findall(r"Scan parquet", plan)),
        "sort_merge_joins": plan.count("SortMergeJoin"), "broadcast_joins": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow\b", plan)), "python_udfs": len(re.findall(r"ArrowEvalPython|BatchEvalPython", plan)),
        "partial_aggs": plan.count("partial_"),
    }


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from ledgerlake.session import build_session
    from ledgerlake.plans.registry import pipe
    from ledgerlake.operators import features as fe, position as po
    spark = build_session("local[8]", 16)
    p = pipe(spark, sf_dir)
    ops = {
        "customer_features (CF-13)": fe.customer_features(p.t, p.cfg),
        "payment_scores (PS-3)": fe.payment_scores(p.customer_features, p.cfg),
        "invoice_features (IF-6)": fe.invoice_features(p.t, p.cfg),
        "collections_features (CO-5)": fe.collections_features(p.t, p.customer_features, p.cfg),
        "vendor_features (VF-8)": fe.vendor_features(p.t, p.cfg), "bill_features (BF-5)": fe.bill_features(p.t, p.cfg),
        "s1_predictions (PP-3)": p.s1_predictions, "s3_detail (S3-6)": p.s3_detail, "s4_detail (S4-6)": p.s4_detail,
        "event_store (S7-7)": p.event_store, "source_days": po.source_days(p.raw_events), "daily_position (S7-10)": p.daily,
        "weekly_position (S7-11)": po.weekly_position(p.daily), "recommendations (RE-8)": p.recommendations,
    }
    lines = ["# PLANS", "",
             "Physical plans of the main operators as the job runs them: from the scans of the stages written before",
             f"(inputs of `{sf_dir}`, 16 shuffle partitions, AQE on; small inputs, so more broadcast joins than at scale).",
             "Generated by `python -m tools.plans`.", "",
             "| operator | exchanges | scans | sort-merge joins | broadcast joins | windows | partial aggs | python UDFs |",
             "|---|---|---|---|---|---|---|---|"]
    for name, df in ops.items():
        s = summary(df)
        lines.append(f"| {name} | {s['exchanges']} | {s['scans']} | {s['sort_merge_joins']} | {s['broadcast_joins']} | "
                     f"{s['windows']} | {s['partial_aggs']} | {s['python_udfs']} |")
    lines += ["", NOTES]
    open("PLANS.md", "w").write("\n".join(lines))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
