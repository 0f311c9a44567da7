"""Headline queries at one scale, timed; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names) choose the run.
"""

from __future__ import annotations

import json
import os
import time

from gradeloom.queries import REGISTRY, runner
from gradeloom.session import local_session

HEADLINE = (
    "overlap_pairs", "overlap_copies", "rubric_health", "letter_distribution", "score_stats", "class_aggregate", "curve_target_mean",
    "late_deduction", "grade_export", "three_way_merge", "effective_due", "extension_plan", "due_date_plan", "quiz_review",
    "attendance_totals", "risk_overall", "a11y_issues", "style_rules_authoring", "a11y_forecast", "policy_coverage", "rewrite_gate",
    "sanitize_corpus", "mask_roster", "mask_pii", "audit_verify", "word_diff", "text_survival", "kwic", "message_assets", "risk_incremental")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="gradeloom-bench")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the JVM's readers before the clock
    times = {}
    for name in names if names != ["all"] else list(REGISTRY):
        start = time.time()
        runner(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
