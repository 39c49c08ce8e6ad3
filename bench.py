"""Times the headline queries and prints one JSON line.

Every query runs to the end into Spark's no-op sink, after one untimed run that warms the JVM.
"""

from __future__ import annotations

import json
import os
import time

from workload.check import session
from workload.queries import QUERIES

HEADLINE = (
    "chunks_per_file", "chunk_significant", "running_significant", "chunk_entities", "file_rollup", "reply_normalize",
    "entity_records", "upsert_records", "file_list_pages", "gitignore_filter", "import_edges", "graph_nodes",
    "knn_search", "similar_topn", "search_text", "file_report",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(run(QUERIES[name], spark, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
