"""Times headline queries and prints one JSON line.

Each query is built and run to the end into a sink that discards the rows, so all columns are
computed. The tables that several queries start from are timed on their own, under the names that
begin with ``build``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from trendspark.session import build_session
from workload.queries import QUERIES
from workload.tables import predictions, read, scored, snapshots

HEADLINE = (
    "viral_score", "rates_per_hour", "canonical_snapshots", "deduplicated_snapshots", "deduplicated_texts",
    "completeness", "score_thresholds_by_source", "metric_statistics", "metric_correlations", "score_summary",
    "histogram_right_closed", "text_features", "detected_language", "training_examples", "sampled_rows",
    "stratified_by_tenths", "rebalanced", "exact_split", "weighted_resample", "percentiles", "percentiles_by_region",
    "spearman", "metrics_by_language", "blend_grid", "simplex_search", "final_blend_report", "pairwise_hinge_loss",
    "preference_pairs", "prepared_regression_set", "ragged_csv_documents", "attached_embeddings", "ingested_events",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    read(spark, folder, "lineitem").count()
    times: dict[str, float] = {}

    def clock(name: str, run) -> None:
        begun = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - begun, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    clock("build_snapshots", lambda: snapshots(spark, folder))
    clock("build_scored", lambda: scored(spark, folder))
    clock("build_predictions", lambda: predictions(spark, folder))
    for name in names:
        clock(name, lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
