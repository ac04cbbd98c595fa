"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from certmill.session import local_session
from checks import queries as q

HEADLINE = [
    "target_limit", "first_match_per_cert", "rule_first_match", "pred_logic", "decode_entries",
    "decode_audit", "cert_projection", "pem_encode", "sct_lookup", "sct_summary", "roots_by_log",
    "root_coverage", "name_verdict", "cert_verdict", "require_icann", "dns_enrich", "nxdomain_filter",
    "skip_known", "session_unique_count", "dedupe_matches", "export_row_index", "greedy_hits",
    "session_hits", "stream_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the workers and load classes before the clock runs.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        q.run(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
