"""Headline timings: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from riskgraph.operators import cluster_metrics as cm
from riskgraph.operators.clustering import gaussian_mixture, kmeans
from riskgraph.operators.features import engineer_features
from riskgraph.operators.iforest import isolation_forest
from riskgraph.operators.scaling import prepare_features
from riskgraph.plans.catalog import QUERIES
from riskgraph.plans.catalog.base import LINE_KEY, lines
from riskgraph.session import checkpointed

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Registered queries that are timed as they are, over whole tables.
TIMED = [
    "s10_table_info", "s13_describe", "f1_effective_price", "f25_transaction_velocity",
    "f33_product_unique_customers", "f36_time_since_last_trans", "f43_feature_totals",
    "a3_guest_free_aggregates", "l1_quantile_labels", "l2_zscore_label", "l11_davies_bouldin",
    "l20_weighted_vote", "l22_keyed_sample", "k2_dense_ids", "g6_buys_edges",
    "g10_transaction_mapping", "g11_graph_summary", "p1_mean_neighbors", "p5_one_layer",
    "b1_random_split", "b3_stratified_folds", "e4_roc_auc", "e6_evaluation_record",
    "e9_comparison_table", "x4_level_summary",
]


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("riskgraph-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    drain(lines(spark, SF_DIR))  # start-up cost is not part of any query
    times = {}
    for name in TIMED:
        times[name] = timed(lambda: drain(QUERIES[name](spark, SF_DIR)))
        print(name, times[name], file=sys.stderr, flush=True)
    # Fits on the fifteen clustering features of all lines, features excluded.
    features = checkpointed(engineer_features(lines(spark, SF_DIR), LINE_KEY))
    vectors = checkpointed(prepare_features(features, ["txn_key"]))
    fits = {
        "fit_kmeans_k2": lambda: drain(kmeans(vectors, k=2)),
        "fit_isolation_forest_100": lambda: drain(isolation_forest(vectors)),
        "fit_gmm_2_full": lambda: drain(gaussian_mixture(vectors, k=2)),
        "fit_gmm_2_diag": lambda: drain(gaussian_mixture(vectors, k=2, covariance="diag")),
        "silhouette_squared": lambda: cm.silhouette_squared(
            cm.minority_flag(vectors.join(kmeans(vectors, k=2, starts=1), "txn_key"))
        ),
    }
    for name, run in fits.items():
        times[name] = timed(run)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
