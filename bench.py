"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list; default HEADLINE).
Each query is executed in full (``noop`` sink: every row is produced, nothing
is collected to the driver) after one warm-up run of the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "features_by_source",
    "agg6_dedup_first_wins",
    "ioc_long",
    "dic1_technique_tags",
    "join1_technique_tags_vocabulary",
    "join1_technique_tags_automaton",
    "ent1_entities",
    "kg_edges",
    "kg12_degree_centrality",
    "smp5_stratified_split",
    "met5_roc_auc",
    "adv1_tfidf",
    "scr_threat_scores",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidewatch.session import build_session
    from tidewatch.plans.catalog import QUERIES

    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or \
        [n for n in HEADLINE if n in QUERIES]
    spark = build_session(f"local[{cpus}]")
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
