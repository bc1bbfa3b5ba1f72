"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1) with
local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  A small warm-up runs first
and is not timed: one native query (JVM code paths) and one identity
``mapInPandas`` over one partition per core, which starts the Python
workers that a long-running cluster keeps alive.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from refract.plans import catalog  # noqa: E402
from refract.session import local_session  # noqa: E402

HEADLINE = [
    "eval_results",            # end-to-end: dataset -> embed -> k-NN -> hits
    "accuracy_breakdown",
    "eval_cumulative_runs",
    "build_dataset",
    "extractive_answers",
    "knn_cosine_top1",
    "knn_cosine_topk",
    "knn_l2_topk",
    "knn_lsh_recall",
    "extract_main_text",
    "extract_main_text_flat",
    "hash_embedding",
    "split_context_3",
    "index_upsert",
    "index_records",
    "multi_source_union",
    "mean_pool_embedding",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in sys.argv[1:]]
    catalog.load_all()
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app_name="refract-bench")
    warm = catalog.QUERIES["word_count"](spark, sf_dir)
    warm.write.format("noop").mode("overwrite").save()
    cores = spark.sparkContext.defaultParallelism
    (spark.range(0, cores * 64, numPartitions=cores)
     .mapInPandas(lambda batches: batches, "id long")
     .write.format("noop").mode("overwrite").save())
    times = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
