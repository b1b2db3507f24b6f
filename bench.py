"""Headline timings: one JSON line with wall-clock seconds per query.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Every query is computed
in full and its rows are discarded, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from auditloom.plans import catalogue  # noqa: E402
from auditloom.session import local_session  # noqa: E402

HEADLINE = [
    "line_explode", "risk_by_source", "pattern_scan", "base64_runs", "unicode_scan", "build_section_scan", "all_warnings",
    "tag_escape", "md_sanitize", "sanitized_findings", "scope_manifest", "loc_by_source", "text_matches",
    "pack_price_feeds", "pack_structural", "value_flow_union", "transition_graph", "ir_line_scan", "call_edges",
    "leads_union", "lead_route", "protocol_match", "dedup_severity", "assign_ids", "upsert", "apply_verdicts",
    "bulk_triage", "severity_distribution", "agent_tally", "pack_budget", "token_cost", "running_cost", "log_tail",
    "latest_progress", "rate_breaches", "report_sections",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8, "auditloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.auditloom.scan.partitions", cpus)  # the test tables are one row group each
    registered = catalogue.load()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("token_estimate")
    seconds = {name: run(name) for name in HEADLINE}
    print(json.dumps({"metric": "catalogue_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
