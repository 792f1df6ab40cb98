"""Time the headline queries; prints one JSON line.

The driver's tables are single files of one row group, which a scan cannot share out. A table of a cluster
has many files, so the tables are first rewritten to one file per core; that is not timed.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailprism.plans.queries import QUERIES  # noqa: E402
from mailprism.session import local_session  # noqa: E402

HEADLINE = (
    "text_features", "url_features", "mail_header_features", "flat_features_92", "preprocess",
    "text_profile", "mail_url_corpus", "typosquatting", "json_flatten", "union_clean",
    "dedup_keep_first", "corpus_summary", "text_length_profile", "class_ratio_sample",
    "stratified_split", "stratified_folds", "metrics", "roc_curve_fine", "fusion", "batch_table",
)
#: Training and explaining; timed once, in the second pass.
MODELS = (
    "header_forest_verdicts", "url_forest_verdicts", "text_scores", "forest_importances",
)


def spread_tables(spark, sf_dir: str, files: int) -> str:
    out = tempfile.mkdtemp(prefix="run-")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            table = spark.read.parquet(f"{sf_dir}/{name}")
            table.repartition(files).write.parquet(f"{out}/{name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "mailprism-bench")
    tables = spread_tables(spark, sf_dir, int(cpus))
    runs = [{}, {}]  # the first pass compiles and starts the Python workers, the second counts
    for times, names in zip(runs, (HEADLINE, HEADLINE + MODELS)):
        for name in names:
            start = time.perf_counter()
            # every column of every row is computed, nothing is kept
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    cold, times = runs
    headline = round(sum(times[n] for n in HEADLINE), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": headline,
                "unit": "sec", "queries": times, "first_pass": round(sum(cold.values()), 3),
                "models": round(sum(times.values()) - headline, 3),
                "cpus": int(cpus), "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
