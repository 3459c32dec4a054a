"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built from the raw tables and written to the ``noop`` sink.  The
headline queries are timed in turns with a plain single-statement SQL version
of the same question (``tools/plain_sql.py``): after two warm-up runs of each,
every repetition runs the library's query and then its SQL twin, so both see
the same machine state; medians are reported.  Prints one JSON line.
"""

from __future__ import annotations

import gc
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfsense.plans.catalog import QUERIES, SALES_TABLES  # noqa: E402
from shelfsense.session import build_session  # noqa: E402
from tools.plain_sql import PLAIN  # noqa: E402

BASELINE_QUERIES = ["cluster_top", "stocking_suggestions", "discontinue_suggestions",
                    "price_optimum", "price_box_stats", "price_histogram", "price_kde"]
EXTRA_QUERIES = ["recommendation_report", "store_ranking", "national_top", "price_points",
                 "price_fit", "property_clusters"]


def once(make) -> float:
    t0 = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    gc.collect()  # releases what the query shared between its branches
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = BASELINE_QUERIES + EXTRA_QUERIES
    if len(sys.argv) > 1:
        names = sys.argv[1:]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          app_name="shelfsense-bench")
    for t in SALES_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    times: dict[str, float] = {}
    plain: dict[str, float] = {}
    for name in names:
        makes = [lambda name=name: QUERIES[name](spark, sf_dir)]
        if name in PLAIN:
            makes.append(lambda name=name: spark.sql(PLAIN[name]))
        for _ in range(2):
            for make in makes:
                once(make)
        samples = [[once(make) for make in makes] for _ in range(reps)]
        medians = [round(statistics.median(s), 3) for s in zip(*samples)]
        times[name] = medians[0]
        plain.update({name: medians[1]} if name in PLAIN else {})
    base = [times[q] for q in BASELINE_QUERIES if q in times]
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "sum_median_sec_baseline_queries",
        "value": round(sum(base), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "plain_sql": plain,
        "ratio_to_plain_sql": {q: round(times[q] / t, 2) for q, t in plain.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
