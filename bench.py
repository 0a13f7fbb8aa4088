"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads. Every query runs once
to warm up at the smallest scale, then once measured, results written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from newsweave.plans import QUERIES  # noqa: E402
from newsweave.session import build_session  # noqa: E402

HEADLINES = [
    "word_cloud",
    "newest_news_per_source",
    "upsert_fields",
    "page_news",
    "standard_dates",
    "event_time_update",
    "standard_names",
    "clean_edges",
    "name_index",
    "mapped_targets",
    "edge_table",
    "renumbered_events",
    "encoded_triples",
    "group_digests",
    "fact_bank",
    "top_hot_events",
    "similar_texts",
    "merge_map",
    "density_clusters",
    "nearest_entities",
    "corrected_relations",
    "stream_task_rollup",
    "incremental_run",
]
WARM_UP = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        if Path(WARM_UP).is_dir():
            QUERIES[name](spark, WARM_UP).write.format("noop").mode("overwrite").save()
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
