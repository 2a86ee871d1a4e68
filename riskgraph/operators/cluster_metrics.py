"""Cluster validity measures and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.functions.expressions import flag
from riskgraph.operators.keys import shuffled_row_number
from riskgraph.operators.sampling import keyed_sample
from riskgraph.operators.scaling import ml_vector
from riskgraph.operators.small import broadcast_when_small
from riskgraph.operators.tiles import distance_sums, worst_similarities
from riskgraph.session import checkpointed

# Fallbacks, score weights and bands.
NO_SILHOUETTE, NO_DAVIES_BOULDIN, NO_CALINSKI = 0.0, 999.0, 0.0
MIN_CLUSTERED_ROWS = 100
SHARE_LOW, SHARE_HIGH = 0.07, 0.15
WEIGHTS = {"silhouette": 0.35, "davies_bouldin": 0.25, "calinski_harabasz": 0.20, "share": 0.20}
CALINSKI_CAP = 1000
BANDS = {
    "silhouette": (0.3, 0.1),
    "davies_bouldin": (1.0, 2.0),
    "calinski_harabasz": (100, 50),
}
SILHOUETTE_SAMPLE = 10_000
SUMMARY_COLUMNS = [
    "method", "composite_score", "silhouette", "davies_bouldin", "fraud_rate", "n_clusters",
    "fraud_count",
]


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


def centroids(df: DataFrame, dims: int, x: str = "x", cluster: str = "cluster") -> DataFrame:
    mean = F.array(*[F.avg(F.col(x)[i]) for i in range(dims)])
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), mean.alias("centroid"))


def _dims(df: DataFrame, x: str) -> int:
    row = df.select(F.size(x)).first()
    return row[0] if row else 0


def cluster_spread(
    df: DataFrame, x: str = "x", cluster: str = "cluster", dims: int | None = None
) -> DataFrame:
    """Per cluster: size, centroid, mean distance and squared distance sum to it."""
    centers = broadcast_when_small(centroids(df, dims or _dims(df, x), x, cluster))
    square = squared_distance(F.col(x), F.col("centroid"))
    return (
        df.select(cluster, x)
        .join(centers, cluster)
        .groupBy(cluster)
        .agg(
            F.first("n").alias("n"),
            F.first("centroid").alias("centroid"),
            F.avg(F.sqrt(square)).alias("spread"),
            F.sum(square).alias("within"),
        )
    )


def centroid_metrics(
    df: DataFrame, x: str = "x", cluster: str = "cluster", noise_label: int | None = None
) -> DataFrame:
    """One row with Davies-Bouldin and Calinski-Harabasz.

    ``noise_label`` rows are left out; with one cluster, or no more than 100 rows left after
    that, the fallback values stand. Clusters are compared tile by tile, so their number may
    grow with the table.
    """
    kept = df if noise_label is None else df.filter(F.col(cluster) != noise_label)
    dims = _dims(kept, x)
    spread = checkpointed(cluster_spread(kept, x, cluster, dims))
    c = F.col("centroid")
    k, total, within, *sums = spread.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("within"), *[F.sum(F.col("n") * c[i]) for i in range(dims)]
    ).first()
    davies, calinski = NO_DAVIES_BOULDIN, NO_CALINSKI
    if k > 1 and (noise_label is None or total > MIN_CLUSTERED_ROWS):
        # Weighted mean of the centroids is the mean of all rows.
        mean = F.array(*[F.lit(v / total) for v in sums])
        between = spread.agg(F.sum(F.col("n") * squared_distance(c, mean))).first()[0]
        calinski = 1.0 if within == 0 else (between * (total - k)) / (within * (k - 1))
        placed = shuffled_row_number(spread, [cluster], name="place", rows=k).select(
            "place", F.lit(0).alias("group"), F.concat(F.array("spread"), c).alias("x")
        )
        davies = worst_similarities(placed, k).agg(F.avg("worst")).first()[0]
    return df.sparkSession.createDataFrame(
        [(davies, calinski)], "davies_bouldin double, calinski_harabasz double"
    )


def silhouette_squared(
    df: DataFrame, x: str = "x", cluster: str = "cluster", noise_label: int | None = None
) -> float:
    """Mean silhouette under squared Euclidean distance, linear in the number of rows."""
    kept = df if noise_label is None else df.filter(F.col(cluster) != noise_label)
    size, low, high = kept.agg(F.count(F.lit(1)), F.min(cluster), F.max(cluster)).first()
    too_few = noise_label is not None and size <= MIN_CLUSTERED_ROWS
    if size == 0 or low == high or too_few:
        return NO_SILHOUETTE
    scored = ml_vector(kept, x).withColumn("prediction", F.col(cluster).cast("double"))
    return ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(scored)


def silhouette_rows(
    df: DataFrame,
    keys: Sequence[str],
    x: str = "x",
    cluster: str = "cluster",
    sample_size: int = SILHOUETTE_SAMPLE,
    noise_label: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Exact Euclidean silhouette of every row of a keyed sample of any size.

    Rows are laid out cluster by cluster in tiles; distances are summed tile against tile, one
    figure per row and cluster met. The work grows with the square of the sample, its memory
    does not. A cluster of one row has silhouette 0; fewer than two clusters give no rows.
    """
    spark = df.sparkSession
    narrow = df.select(*keys, cluster, x)
    chosen = checkpointed(keyed_sample(narrow, keys, sample_size, seed))
    schema = T.StructType([*narrow.schema.fields, T.StructField("silhouette", T.DoubleType())])
    if noise_label is not None and chosen.filter(F.col(cluster) == noise_label).limit(1).count():
        chosen = chosen.filter(F.col(cluster) != noise_label)
        if chosen.count() <= MIN_CLUSTERED_ROWS:
            return spark.createDataFrame([], schema)
    # One row per cluster: its size, its number, and the place of its first row.
    order = Window.orderBy("_c")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sizes = checkpointed(
        chosen.groupBy(F.col(cluster).alias("_c"))
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_group", F.row_number().over(order).cast("long"))
        .withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    )
    clusters, rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    if clusters < 2:
        return spark.createDataFrame([], schema)
    small = broadcast_when_small(sizes)
    numbered = shuffled_row_number(chosen, keys, seed, "_rn", within=[cluster], rows=rows)
    placed = checkpointed(
        numbered.join(small, F.col(cluster).eqNullSafe(F.col("_c")))
        .withColumn("_place", F.col("_first") + F.col("_rn"))
        .drop("_rn", "_first", "_c")
    )
    points = placed.select(
        F.col("_place").alias("place"), F.col("_group").alias("group"), F.col(x).alias("x")
    )
    other = sizes.select(F.col("_group").alias("group"), F.col("_size").alias("size"))
    sums = distance_sums(points, rows).withColumnRenamed("place", "_place")
    met = sums.join(broadcast_when_small(other), "group").join(
        placed.select("_place", "_group"), "_place"
    )
    own = F.col("group") == F.col("_group")
    figures = met.groupBy("_place").agg(
        F.max(F.when(own, F.col("total"))).alias("_own"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("_outer"),
    )
    inner = F.col("_own") / F.greatest(F.col("_size") - 1, F.lit(1))
    top = F.greatest(inner, F.col("_outer"))
    value = F.when((F.col("_size") == 1) | (top <= 0), 0.0).otherwise((F.col("_outer") - inner) / top)
    return placed.join(figures, "_place").select(*narrow.columns, value.alias("silhouette"))


def silhouette_summary(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean silhouette per cluster and size."""
    return rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette")
    )


def flagged_share(df: DataFrame, label: str = "flag") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(label).cast("long").alias("fraud_count"),
        F.avg(label).alias("fraud_rate"),
    )


def cluster_statistics(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Cluster count and sizes over non-negative labels, and the outlier share."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col(cluster) >= 0, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col(cluster) == -1, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.count(real).alias("n_clusters"),
        F.coalesce(F.min(real), F.lit(0)).alias("min_cluster_size"),
        F.coalesce(F.max(real), F.lit(0)).alias("max_cluster_size"),
        F.coalesce(F.avg(real), F.lit(0.0)).alias("avg_cluster_size"),
        F.coalesce(F.stddev_pop(real), F.lit(0.0)).alias("std_cluster_size"),
        noise.alias("n_outliers"),
        F.coalesce(F.try_divide(noise, F.sum("n")), F.lit(0.0)).alias("outlier_rate"),
    )


def validity_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "fraud_rate_valid": F.col("fraud_rate").between(SHARE_LOW, SHARE_HIGH),
            "silhouette_valid": F.col("silhouette") > 0.1,
            "davies_bouldin_valid": F.col("davies_bouldin") < 2.0,
        }
    )


def composite_score(df: DataFrame) -> DataFrame:
    """Weighted score of the three measures and the flagged share, higher is better."""
    share = F.col("fraud_rate")
    share_score = (
        F.when(share < SHARE_LOW, share / SHARE_LOW)
        .when(share > SHARE_HIGH, SHARE_HIGH / share)
        .otherwise(1.0)
    )
    silhouette = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("silhouette") + 1) / 2))
    davies = 1 / (1 + F.col("davies_bouldin"))
    calinski = F.least(F.col("calinski_harabasz") / CALINSKI_CAP, F.lit(1.0))
    score = (
        silhouette * WEIGHTS["silhouette"]
        + davies * WEIGHTS["davies_bouldin"]
        + calinski * WEIGHTS["calinski_harabasz"]
        + share_score * WEIGHTS["share"]
    )
    return df.withColumn("composite_score", score)


def rank_runs(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("composite_score"), "method", "params")


def ranking_summary(df: DataFrame) -> DataFrame:
    return rank_runs(df).select(*SUMMARY_COLUMNS)


def top_runs(df: DataFrame, n: int = 3) -> DataFrame:
    return rank_runs(df).limit(n)


def quality_bands(df: DataFrame) -> DataFrame:
    """good / fair / poor per measure."""

    def band(measure: str) -> Column:
        good, fair = BANDS[measure]
        value = F.col(measure)
        if measure == "davies_bouldin":
            return F.when(value < good, "good").when(value < fair, "fair").otherwise("poor")
        return F.when(value > good, "good").when(value > fair, "fair").otherwise("poor")

    return df.withColumns({f"{m}_band": band(m) for m in BANDS})


def measurable_runs(df: DataFrame) -> DataFrame:
    """Runs whose Davies-Bouldin index is a real value, not the fallback."""
    return df.filter(F.col("davies_bouldin") < 900)


def best_run(df: DataFrame, metric: str = "silhouette") -> DataFrame:
    """Lowest Davies-Bouldin, or highest of any other metric; first run among equals."""
    order = F.asc(metric) if metric == "davies_bouldin" else F.desc(metric)
    return df.orderBy(order, "run_id").limit(1)


def best_per_algorithm(df: DataFrame, metric: str = "silhouette") -> DataFrame:
    pick = F.struct(F.col(metric).alias("m"), (-F.col("run_id")).alias("r"))
    others = [c for c in df.columns if c != "algorithm"]
    best = df.groupBy("algorithm").agg(F.max_by(F.struct(*others), pick).alias("b"))
    return best.select("algorithm", "b.*")


def minority_flag(df: DataFrame, cluster: str = "cluster", name: str = "flag") -> DataFrame:
    """1 for rows of the smallest cluster, the lowest id among equals."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min_by(cluster, F.struct("n", cluster))).first()[0]
    return df.withColumn(name, flag(F.col(cluster) == F.lit(smallest)))


def outlier_flag(df: DataFrame, cluster: str = "cluster", name: str = "flag") -> DataFrame:
    return df.withColumn(name, flag(F.col(cluster) == -1))
