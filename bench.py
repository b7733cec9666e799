"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores, and
BENCH_QUERIES optionally a comma-separated list of query names.
"""

from __future__ import annotations

import json
import os
import time

from lexmill.plans import catalog
from lexmill.session import local_session

HEADLINE = (
    "flagship_eval_balance",
    "p1_hash_split",
    "p9_clean_review",
    "a8_describe_prices",
    "a16_ecdf",
    "t4_term_counts",
    "t5_build_vocab",
    "t8_tfidf_l2",
    "t14_word_index",
    "t17_encode_fixed",
    "d1_with_index",
    "d7_batch",
    "m3_train_and_evaluate",
    "e10_classification_report",
    "e11_roc_per_class",
    "w6_lr_finder",
    "t35_cross_group_neighbours",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, "lexmill-bench", partitions=max(2, int(cpus)))
    known = catalog.queries()
    known["p12_equality_filter"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not timed
    times = {}
    for name in names:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
