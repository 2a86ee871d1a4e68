"""Labels, cluster measures, ensembles and rankings on SQL-made clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgraph.operators import cluster_metrics as cm
from riskgraph.operators import features as fe
from riskgraph.operators import labels as lab
from riskgraph.operators.ensemble import weighted_vote
from riskgraph.operators.sampling import keyed_sample
from riskgraph.operators.scaling import CLUSTERING_FEATURES, standardize, with_vector
from riskgraph.plans.catalog.base import (
    KEY_SQL,
    LINE_KEY,
    lines,
    query,
    rounded,
    sql_round,
    with_lines,
)
from riskgraph.plans.catalog.feature_queries import FEATURE_CTES
from riskgraph.session import checkpointed

CUTS_CTE = (
    "cuts as (select quantile_cont(discounted_total_price,0.99) as q99,"
    " quantile_cont(discounted_total_price,0.95) as q95,"
    " quantile_cont(discounted_total_price,0.90) as q90, avg(discounted_total_price) as mean,"
    " stddev_pop(discounted_total_price) as sd from lines)"
)


@query(
    "l1_quantile_labels",
    with_lines(
        f"select {KEY_SQL}, (discounted_total_price>q99)::int as quantile_99,"
        " (discounted_total_price>q95)::int as quantile_95,"
        " (discounted_total_price>q90)::int as quantile_90 from lines, cuts",
        CUTS_CTE,
    ),
)
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.quantile_labels(lines(spark, sf_dir)).select(*LINE_KEY, *lab.LABEL_QUANTILES)


@query(
    "l2_zscore_label",
    with_lines(
        f"select {KEY_SQL}, ((discounted_total_price-mean)/sd>3)::int as z_score from lines, cuts",
        CUTS_CTE,
    ),
)
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.zscore_label(lines(spark, sf_dir)).select(*LINE_KEY, "z_score")


@query(
    "l3_label_source",
    with_lines(
        f"select {KEY_SQL}, (amount>(select quantile_cont(amount,0.95) from lines))::int"
        " as fraud_label from lines"
    ),
)
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    without_prices = lines(spark, sf_dir).select(*LINE_KEY)
    return lab.ensure_label(without_prices, 0.95)


@query(
    "l4_standardized_features",
    with_lines(
        f"select {KEY_SQL}, "
        + ", ".join(
            sql_round(f"({c}-avg({c}) over ())/stddev_pop({c}) over ()") + f" as {c}"
            for c in CLUSTERING_FEATURES
        )
        + " from features",
        *FEATURE_CTES,
    ),
)
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = fe.engineer_features(lines(spark, sf_dir), LINE_KEY)
    # Moments and rows read the same features: they are computed and written once.
    narrow = checkpointed(features.select(*LINE_KEY, *CLUSTERING_FEATURES))
    scaled = standardize(narrow, CLUSTERING_FEATURES)
    return rounded(scaled, CLUSTERING_FEATURES)


# --- measures on clusters made from the amount ------------------------------------------

SPACE = ["unit_price", "discounted_total_price", "total_discount_amount"]
CLUSTER_SQL = "case when amount>35 then 2 when amount>12 then 1 else 0 end"
SCALED_CTE = (
    f"scaled as (select {KEY_SQL}, cust_id, {CLUSTER_SQL} as cluster, "
    + ", ".join(
        f"({c}-avg({c}) over ())/stddev_pop({c}) over () as x{i}" for i, c in enumerate(SPACE)
    )
    + " from lines)"
)
CENTROID_CTE = (
    "cent as (select cluster, count(*) as n, avg(x0) as m0, avg(x1) as m1, avg(x2) as m2"
    " from kept group by cluster),"
    " spread as (select c.cluster, any_value(c.n) as n, any_value(m0) as m0, any_value(m1) as m1,"
    " any_value(m2) as m2, avg(sqrt((x0-m0)*(x0-m0)+(x1-m1)*(x1-m1)+(x2-m2)*(x2-m2))) as s,"
    " sum((x0-m0)*(x0-m0)+(x1-m1)*(x1-m1)+(x2-m2)*(x2-m2)) as w"
    " from kept k join cent c on k.cluster=c.cluster group by c.cluster)"
)
DAVIES_SQL = (
    "(select avg(worst) from (select max((a.s+b.s)/sqrt((a.m0-b.m0)*(a.m0-b.m0)+(a.m1-b.m1)"
    "*(a.m1-b.m1)+(a.m2-b.m2)*(a.m2-b.m2))) as worst from spread a join spread b"
    " on a.cluster<>b.cluster group by a.cluster))"
)
CALINSKI_SQL = (
    "(select (sum(n*((m0-g0)*(m0-g0)+(m1-g1)*(m1-g1)+(m2-g2)*(m2-g2)))*(sum(n)-count(*)))"
    "/(sum(w)*(count(*)-1)) from spread, (select avg(x0) as g0, avg(x1) as g1, avg(x2) as g2"
    " from kept))"
)
ALL_KEPT = "kept as (select * from scaled)"


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with three standardised price columns as ``x`` and clusters by amount."""
    amount = F.col("amount")
    cluster = F.when(amount > 35, 2).when(amount > 12, 1).otherwise(0)
    kept = lines(spark, sf_dir).select(*LINE_KEY, "cust_id", *SPACE)
    scaled = standardize(kept.withColumn("cluster", cluster), SPACE)
    return with_vector(scaled, SPACE).drop(*SPACE)


@query(
    "l6_minority_flag",
    with_lines(
        f"select {KEY_SQL}, (cluster=(select cluster from scaled group by cluster"
        " order by count(*), cluster limit 1))::int as flag from scaled",
        SCALED_CTE,
    ),
)
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.minority_flag(clustered(spark, sf_dir)).select(*LINE_KEY, "flag")


@query("l10a_silhouette_squared")
def l10a(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = cm.silhouette_squared(clustered(spark, sf_dir))
    return spark.createDataFrame([(value,)], "silhouette double")


SAMPLE_CTE = (
    f"sample as (select *, row_number() over (order by {KEY_SQL}) as i from (select * from scaled"
    " order by md5(concat_ws('|', '42', trans_id, product_code, store_code, amount)),"
    f" {KEY_SQL} limit 10000))"
)
PAIRS_CTE = (
    "means as (select a.i, any_value(a.cluster) as own, b.cluster as other, count(*) as n,"
    " sum(sqrt((a.x0-b.x0)*(a.x0-b.x0)+(a.x1-b.x1)*(a.x1-b.x1)+(a.x2-b.x2)*(a.x2-b.x2))) as d"
    " from sample a, sample b group by a.i, b.cluster),"
    " sil as (select i, max(d/(n-1)) filter (own=other) as a, min(d/n) filter (own<>other) as b"
    " from means group by i)"
)


@query(
    "l10b_silhouette_rows",
    with_lines(
        f"select {KEY_SQL}, {sql_round('(b-a)/greatest(a,b)')} as silhouette"
        " from sample join sil using (i)",
        SCALED_CTE,
        SAMPLE_CTE,
        PAIRS_CTE,
    ),
)
def l10b(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cm.silhouette_rows(clustered(spark, sf_dir), LINE_KEY)
    return rounded(out.select(*LINE_KEY, "silhouette"), ["silhouette"])


@query(
    "l10b_silhouette_summary",
    with_lines(
        f"select cluster, count(*) as n, {sql_round('avg((b-a)/greatest(a,b))')} as silhouette"
        " from sample join sil using (i) group by cluster",
        SCALED_CTE,
        SAMPLE_CTE,
        PAIRS_CTE,
    ),
)
def l10b_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cm.silhouette_rows(clustered(spark, sf_dir), LINE_KEY)
    return rounded(cm.silhouette_summary(out), ["silhouette"])


@query(
    "l11_davies_bouldin",
    with_lines(
        f"select {sql_round(DAVIES_SQL)} as davies_bouldin", SCALED_CTE, ALL_KEPT, CENTROID_CTE
    ),
)
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cm.centroid_metrics(clustered(spark, sf_dir)).select("davies_bouldin")
    return rounded(out, ["davies_bouldin"])


@query(
    "l12_calinski_harabasz",
    with_lines(
        f"select {sql_round(CALINSKI_SQL, 3)} as calinski_harabasz",
        SCALED_CTE,
        ALL_KEPT,
        CENTROID_CTE,
    ),
)
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cm.centroid_metrics(clustered(spark, sf_dir)).select("calinski_harabasz")
    return rounded(out, ["calinski_harabasz"], 3)


@query(
    "l13_metric_fallbacks",
    with_lines(
        f"select 'noise excluded' as kind, {sql_round(DAVIES_SQL)} as davies_bouldin,"
        f" {sql_round(CALINSKI_SQL, 3)} as calinski_harabasz"
        " union all select 'one cluster', 999.0e0, 0.0e0",
        SCALED_CTE,
        "kept as (select * from scaled where cluster<>2)",
        CENTROID_CTE,
    ),
)
def l13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clustered(spark, sf_dir)
    noisy = df.withColumn("cluster", F.when(F.col("cluster") == 2, -1).otherwise(F.col("cluster")))
    parts = [
        cm.centroid_metrics(noisy, noise_label=-1).withColumn("kind", F.lit("noise excluded")),
        cm.centroid_metrics(df.withColumn("cluster", F.lit(0))).withColumn(
            "kind", F.lit("one cluster")
        ),
    ]
    real = rounded(parts[0], ["davies_bouldin"])
    return rounded(real, ["calinski_harabasz"], 3).unionByName(parts[1])


@query(
    "l14_flagged_share",
    with_lines(
        f"select count(*) as rows, count(*) filter (cluster=2) as fraud_count,"
        f" {sql_round('avg((cluster=2)::int)')} as fraud_rate from scaled",
        SCALED_CTE,
    ),
)
def l14(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clustered(spark, sf_dir).withColumn("flag", (F.col("cluster") == 2).cast("int"))
    return rounded(cm.flagged_share(df), ["fraud_rate"])


# --- runs, ensembles, rankings ----------------------------------------------------------

# One run per store bucket and algorithm; its measures come from the lines.
RUNS_CTE = (
    "runs as (select row_number() over (order by algorithm, bucket) as run_id, algorithm,"
    " algorithm as method, 'bucket='||bucket as params, * exclude (algorithm) from ("
    "select case store_code%4 when 0 then 'kmeans' when 1 then 'dbscan' when 2 then"
    " 'isolation_forest' else 'gmm' end as algorithm, store_code%12//4 as bucket,"
    " avg(discounted_total_price/(discounted_total_price+unit_price))-0.5 as silhouette,"
    " case when min(amount)=max(amount) then 999.0e0 else avg(amount)/20 end as davies_bouldin,"
    " avg(unit_price)/10 as calinski_harabasz,"
    " avg((discounted_total_price>70000)::int) as fraud_rate,"
    " sum((discounted_total_price>70000)::int)::bigint as fraud_count,"
    " count(distinct amount%7) as n_clusters from lines group by 1, 2))"
)
SCORE_SQL = (
    "0.35e0*greatest(0.0e0,least(1.0e0,(silhouette+1)/2))+0.25e0/(1+davies_bouldin)"
    "+0.20e0*least(calinski_harabasz/1000,1.0e0)+0.20e0*(case when fraud_rate<0.07e0 then"
    " fraud_rate/0.07e0 when fraud_rate>0.15e0 then 0.15e0/fraud_rate else 1.0e0 end)"
)
RUN_REALS = ["silhouette", "davies_bouldin", "calinski_harabasz", "fraud_rate"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve labelling runs with measures taken from the lines."""
    store = F.col("store_code")
    total = F.col("discounted_total_price")
    names = F.array(*[F.lit(n) for n in ("kmeans", "dbscan", "isolation_forest", "gmm")])
    high = (total > 70000).cast("int")
    grouped = (
        lines(spark, sf_dir)
        .withColumn("algorithm", names[store % 4])
        .withColumn("bucket", F.floor(store % 12 / 4))
        .groupBy("algorithm", "bucket")
        .agg(
            (F.avg(total / (total + F.col("unit_price"))) - 0.5).alias("silhouette"),
            F.when(F.min("amount") == F.max("amount"), 999.0)
            .otherwise(F.avg("amount") / 20)
            .alias("davies_bouldin"),
            (F.avg("unit_price") / 10).alias("calinski_harabasz"),
            F.avg(high).alias("fraud_rate"),
            F.sum(high).alias("fraud_count"),
            F.count_distinct(F.col("amount") % 7).alias("n_clusters"),
        )
    )
    # At most twelve rows are numbered here.
    run_id = F.row_number().over(Window.orderBy("algorithm", "bucket"))
    return grouped.select(
        run_id.alias("run_id"),
        "algorithm",
        F.col("algorithm").alias("method"),
        F.concat(F.lit("bucket="), F.col("bucket")).alias("params"),
        *RUN_REALS,
        "fraud_count",
        "n_clusters",
    )


@query(
    "l18_best_run",
    with_lines(
        "(select 'silhouette' as metric, run_id, algorithm, params from runs order by"
        " silhouette desc, run_id limit 1) union all (select 'davies_bouldin', run_id, algorithm,"
        " params from runs order by davies_bouldin, run_id limit 1)",
        RUNS_CTE,
    ),
)
def l18(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = runs(spark, sf_dir)
    picked = [
        cm.best_run(df, m).select(F.lit(m).alias("metric"), "run_id", "algorithm", "params")
        for m in ("silhouette", "davies_bouldin")
    ]
    return picked[0].unionByName(picked[1])


@query(
    "l19_best_per_algorithm",
    with_lines(
        f"select algorithm, run_id, params, {sql_round('silhouette')} as silhouette from (select *,"
        " row_number() over (partition by algorithm order by silhouette desc, run_id) as rn"
        " from runs) where rn=1",
        RUNS_CTE,
    ),
)
def l19(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cm.best_per_algorithm(runs(spark, sf_dir))
    return rounded(best.select("algorithm", "run_id", "params", "silhouette"), ["silhouette"])


FLAG_SQL = {
    "kmeans": "discounted_total_price>70000",
    "dbscan": "amount>48",
    "isolation_forest": "unit_price>5000",
    "other": "total_discount_amount>20000",
}


@query(
    "l20_weighted_vote",
    with_lines(
        f"select {KEY_SQL}, score, (score>=0.3e0)::int as label from (select {KEY_SQL}, "
        + "+".join(
            f"{w}*({FLAG_SQL[a]})::int"
            for a, w in (
                ("kmeans", "1.0e0"),
                ("dbscan", "1.0e0"),
                ("isolation_forest", "1.5e0"),
                ("other", "0.25e0"),
            )
        )
        + " as score from lines)"
    ),
)
def l20(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.array(
        *[
            F.struct(F.lit(a).alias("algorithm"), F.expr(text).cast("int").alias("flag"))
            for a, text in FLAG_SQL.items()
        ]
    )
    flags = lines(spark, sf_dir).select(F.struct(*LINE_KEY).alias("key"), F.inline(votes))
    return weighted_vote(flags, "key").select("key.*", "score", "label")


@query(
    "l22_keyed_sample",
    with_lines(
        f"select {KEY_SQL}, cust_id from scaled order by"
        f" md5(concat_ws('|', '42', trans_id, product_code, store_code, amount)), {KEY_SQL}"
        " limit 10000",
        SCALED_CTE,
    ),
)
def l22(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).select(*LINE_KEY, "cust_id")
    return keyed_sample(df, LINE_KEY, 10_000)


@query(
    "e13_cluster_statistics",
    with_lines(
        "select count(*) filter (cluster>=0) as n_clusters, min(n) filter (cluster>=0) as"
        " min_cluster_size, max(n) filter (cluster>=0) as max_cluster_size,"
        f" {sql_round('avg(n) filter (cluster>=0)')} as avg_cluster_size,"
        f" {sql_round('stddev_pop(n) filter (cluster>=0)')} as std_cluster_size,"
        " coalesce(sum(n) filter (cluster=-1),0)::bigint as n_outliers,"
        f" {sql_round('coalesce(sum(n) filter (cluster=-1),0)/sum(n)')} as outlier_rate"
        " from (select cluster-1 as cluster, count(*) as n from scaled group by 1)",
        SCALED_CTE,
    ),
)
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clustered(spark, sf_dir).withColumn("cluster", F.col("cluster") - 1)
    reals = ["avg_cluster_size", "std_cluster_size", "outlier_rate"]
    return rounded(cm.cluster_statistics(df), reals)


@query(
    "o8_noise_and_clusters",
    with_lines(
        "select count(distinct cluster) filter (cluster>=0) as n_clusters,"
        f" {sql_round('avg((cluster=-1)::int)')} as outlier_rate"
        " from (select cluster-1 as cluster from scaled)",
        SCALED_CTE,
    ),
)
def o8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clustered(spark, sf_dir).withColumn("cluster", F.col("cluster") - 1)
    stats = cm.cluster_statistics(df).select("n_clusters", "outlier_rate")
    return rounded(stats, ["outlier_rate"])


@query(
    "e14_validity_flags",
    with_lines(
        "select run_id, (fraud_rate between 0.07e0 and 0.15e0) as fraud_rate_valid,"
        " silhouette>0.1e0 as silhouette_valid, davies_bouldin<2.0e0 as davies_bouldin_valid"
        " from runs",
        RUNS_CTE,
    ),
)
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.validity_flags(runs(spark, sf_dir)).select(
        "run_id", "fraud_rate_valid", "silhouette_valid", "davies_bouldin_valid"
    )


@query(
    "e15_composite_score",
    with_lines(f"select run_id, {sql_round(SCORE_SQL)} as composite_score from runs", RUNS_CTE),
)
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cm.composite_score(runs(spark, sf_dir)).select("run_id", "composite_score")
    return rounded(scored, ["composite_score"])


RANK_SQL = (
    "select method, {score} as composite_score, {sil} as silhouette, {db} as davies_bouldin,"
    " {share} as fraud_rate, n_clusters, fraud_count from (select *, {raw} as s from runs)"
    " order by s desc, method, params"
).format(
    score=sql_round("s"),
    sil=sql_round("silhouette"),
    db=sql_round("davies_bouldin"),
    share=sql_round("fraud_rate"),
    raw=SCORE_SQL,
)
RANK_REALS = ["composite_score", "silhouette", "davies_bouldin", "fraud_rate"]


@query("e16_ranking_summary", with_lines(RANK_SQL, RUNS_CTE))
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cm.ranking_summary(cm.composite_score(runs(spark, sf_dir))), RANK_REALS)


@query("e16_top_three", with_lines(RANK_SQL + " limit 3", RUNS_CTE))
def e16_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = cm.top_runs(cm.composite_score(runs(spark, sf_dir)), 3).select(*cm.SUMMARY_COLUMNS)
    return rounded(top, RANK_REALS)


@query(
    "e19_quality_bands",
    with_lines(
        "select run_id, case when silhouette>0.3e0 then 'good' when silhouette>0.1e0 then 'fair'"
        " else 'poor' end as silhouette_band, case when davies_bouldin<1 then 'good' when"
        " davies_bouldin<2 then 'fair' else 'poor' end as davies_bouldin_band,"
        " case when calinski_harabasz>100 then 'good' when calinski_harabasz>50 then 'fair'"
        " else 'poor' end as calinski_harabasz_band from runs where davies_bouldin<900",
        RUNS_CTE,
    ),
)
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = cm.quality_bands(cm.measurable_runs(runs(spark, sf_dir)))
    return banded.select("run_id", *[f"{m}_band" for m in cm.BANDS])
