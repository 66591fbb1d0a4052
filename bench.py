"""Time the headline queries: prints one JSON line.

Inputs: $BENCH_SF_DIR (default /root/testdata/sf0.1) and $BENCH_CPUS (default 8).  Each query is
run once to warm up the JVM's code paths and once for the clock; the result is produced in full
and written to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from attestry.queries import QUERIES
from attestry.session import drop_stages, local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "read_corpus", "jd_clone", "scan_integrity", "redact_corpus", "residual_pii_audit",
    "injection_lexicon", "read_pages", "requirement_scan", "structure_resume", "analyze_skills",
    "match_requirements", "compose_score", "total_years", "role_overlap", "extract_claims",
    "judge_skill", "judge_metric", "authenticity_rollup", "assess_authenticity", "auroc",
    "bootstrap_ci", "latest_per_key", "rate_audit", "check_narratives", "screen_corpus",
)
# whole plans stage their tables on every call, so one run is enough
ONCE = {"assess_authenticity", "screen_corpus"}


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    drop_stages(spark)
    return seconds


def main() -> None:
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        if name not in ONCE:
            run(spark, name)
        seconds[name] = round(run(spark, name), 3)
    screened = spark.read.parquet(f"{SF_DIR}/customer.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
                "screenings_per_second": round(screened / seconds["screen_corpus"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
