"""Benchmark the headline profiling queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
and prints one JSON line. Each query is forced to completion with the
``noop`` sink (nothing is collected to the driver); times are wall-clock
seconds of the second run, after one warm-up run of the whole set.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from tidemark.plans.registry import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "dimensions",
    "nulls_per_row",
    "exact_duplicates_rows",
    "duplicate_row_keys_documents",
    "column_inventory",
    "identifier_candidates",
    "empty_constant_columns",
    "type_profile",
    "fold_text",
    "text_problems_documents",
    "category_frequencies",
    "equivalent_categories",
    "numeric_summary_lineitem",
    "numeric_outliers",
    "date_conversion",
    "temporal_inconsistencies",
    "validation_summary",
)


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="bench")
    names = [n for n in HEADLINE if n in QUERIES]
    for n in names:  # warm-up: JIT, Python workers, file listing caches
        run(spark, n, sf_dir)
    times = {n: round(run(spark, n, sf_dir), 3) for n in names}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "profile_headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
