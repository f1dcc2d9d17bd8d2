"""Seconds per headline query on the given scale; prints one JSON line.

Each query runs twice into a no-op sink: the first run is reported as cold, the
second one counts.  Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_ALL=1 for all.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rankloom.plans.registry import registered
from rankloom.session import local_session, ship_package

HEADLINE = (
    "analysis_mart domain_features entity_signals serp_items onpage_signals backlinks pages passages entities "
    "page_metrics ordinal_ranks average_ranks within_zscore two_level_medians site_scale upsert_new combined_runs "
    "missing_urls url_functions overlap_score blocked_domains contract_report centroid_cosine correlations "
    "false_discovery slopes regressions influence specification newton_step entity_associations ndcg out_of_fold "
    "content_fields mention_associations"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"), "bench")
    ship_package(spark)
    known = registered()
    names = list(known) if os.environ.get("BENCH_ALL") else HEADLINE
    warm, cold = {}, {}
    for name in names:
        for times in (cold, warm):
            start = time.perf_counter()
            known[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total seconds of the headline queries (second run)",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
        "spark_conf": {"shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), "adaptive": "on"},
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
