"""Headline timings. Prints one JSON line; each query is run to the end through a no-op sink."""

from __future__ import annotations

import json
import os
import time

from scanlake.queries import QUERIES
from scanlake.session import local_session

HEADLINE = (
    "credential_mix", "embedded_credentials", "rule_scan", "context_evidence", "multi_pass_receipts", "file_receipts", "snapshot_digests", "snapshot_drift",
    "review_regions", "risk_signals", "dedupe_observations", "reduced_findings", "finding_identities", "combined_candidates", "compare_scans", "policy_pass",
    "calibrated_severity", "triage_state", "remediation_audit", "finalize_check", "version_ranges", "dependency_status", "triage_backlog", "stack_rank",
    "manifest_dependencies", "severity_mix", "diff_lines", "touching_added",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.conf.set("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
