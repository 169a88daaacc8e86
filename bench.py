"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_QUERIES (comma-separated names, default the list below). Each query runs once to
warm up and once timed, from building its plan to the last row (noop sink).
"""

from __future__ import annotations

import json
import os
import time

from credence.session import build_session
from credence.testbed.catalog import QUERIES
from credence.testbed.tables import Tables

HEADLINE = [
    "clean_reports",
    "company_features",
    "stratified_sample",
    "company_risk_rows",
    "stored_reports",
    "stored_edges",
    "unknown_edge_ends",
    "input_guard",
    "split_documents",
    "encode_chunks",
    "vector_topk",
    "graph_expand_1",
    "graph_expand_2",
    "rerank",
    "ask_responses",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_warm_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
