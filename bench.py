"""Bench: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS]. Prints ONE JSON line.

Each query is fully executed (noop sink) and timed; the value is the sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import get_session  # noqa: E402
from tessera.plans import registry  # noqa: E402

HEADLINE = [
    "G2_describe",            # profiling
    "G13_missing_values",
    "G7_G9_G10_length_profile",
    "A10_A13_encode_batch",   # encode batch (flagship)
    "R1_stratified_split",    # split
    "R3_stratified_kfold",
    "N8_conservative_preset",  # augmentation
    "M1_auc",                 # AUC
    "M8_best_f1_threshold",   # threshold sweep
    "M6_W7_roc_curve",
    "J5_nearest_codebook",    # nearest codebook
    "A16_embedding_bag",
    "F3_ml_feature_table",
    "N12_smote",              # oversampling (exact kNN inside)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cpus=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="tessera-bench")
    # JVM / codegen / Python-worker warm-up on a tiny table (not timed)
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    region.groupBy("r_name").count().collect()
    region.mapInPandas(lambda it: it, schema=region.schema).collect()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
