"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of threads,
``BENCH_QUERIES`` an optional list of names or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from findmill.plans.registry import registered  # noqa: E402
from findmill.session import build_session  # noqa: E402

HEADLINE = [
    "severity_summary", "dedup_first", "findings_query", "findings_by_risk", "text_search", "finding_enrich", "report_blocks",
    "redact", "source_lines", "context_join", "snippet_fallback", "secret_scan", "rule_scan", "rule_scan_calls",
    "ingest_bandit", "ingest_opengrep", "ingest_report_envelope", "union_engines", "diff_parse", "interval_coalesce",
    "diff_interval_match", "scan_findings", "scan_admission", "scan_summary", "event_seq", "progress_changes", "triage_apply",
    "rule_governance", "archive_audit", "stream_dedup", "stream_event_buffer",
]


def run(spark, name: str, fn, sf: str) -> float:
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def dealt(spark, sf: str, cpus: int) -> str:
    """A copy of the tables with as many files as cores: the stored ones are single row groups, which no reader splits."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in sorted(Path(sf).glob("*.parquet")):
        spark.read.parquet(str(table)).repartition(cpus).write.parquet(f"{folder}/{table.name}")
    return folder


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = registered()
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = dealt(spark, sf, int(cpus))
    # Start the JVM's compiler and the readers before anything is timed.
    run(spark, "warm-up", queries["severity_counts"][0], folder)
    times: dict[str, float] = {}
    for name in names:
        times[name] = round(run(spark, name, queries[name][0], sf if name.startswith("stream_") else folder), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total seconds over headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
