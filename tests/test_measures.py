"""Quantiles, classification measures, cluster measures and recorded results."""

import numpy as np
import pytest

from riskgraph.operators import cluster_metrics as cm
from riskgraph.operators import evaluate as ev
from riskgraph.operators.ensemble import weighted_vote
from riskgraph.operators.quantiles import exact_quantiles
from riskgraph.operators.sampling import keyed_sample


@pytest.mark.parametrize("limit", [10, 300, 10_000])
def test_quantiles_equal_a_full_sort(spark, limit):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 3000), np.full(1500, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    wanted = [0.0, 0.25, 0.5, 0.55, 0.9, 0.99, 1.0]
    found = exact_quantiles(df, {"v": wanted}, limit)["v"]
    assert [found[q] for q in wanted] == pytest.approx(list(np.quantile(values, wanted)), rel=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, {"v": [0.5]}) == {"v": {0.5: None}}


# Recorded confusion matrices (tn, fp, fn, tp) with their precision, recall and F1.
RECORDED = [
    (0, 11511, 0, 2278, 0.16520414823409965, 1.0, 0.2835625816891766),
    (0, 12581, 0, 1208, 0.08760606280368409, 1.0, 0.16109888644395545),
    (13687, 0, 102, 0, 0.0, 0.0, 0.0),
    (0, 12716, 0, 1073, 0.07781565015592139, 1.0, 0.14439510160139954),
    (62201, 8286, 38, 644, 0.07211646136618141, 0.9442815249266863, 0.13399916770703288),
]


@pytest.mark.parametrize("row", RECORDED)
def test_rates_of_recorded_matrices(spark, row):
    counts = spark.createDataFrame([row[:4]], "tn long, fp long, fn long, tp long")
    found = ev.rates(counts).first()
    assert [found[c] for c in ("precision", "recall", "f1")] == pytest.approx(row[4:])


# Recorded runs: silhouette, Davies-Bouldin, Calinski-Harabasz, flagged percent, score.
RANKED = [
    (0.4410195430229946, 1.0162800235404843, 159122.1730517812, 9.168, 0.7761691341566246),
    (0.2572597957687748, 0.659745148484782, 134247.2460289675, 10.4449, 0.7706459986846432),
    (0.46199537120692974, 1.0842457410684028, 181329.5913026327, 6.4631, 0.7604566582822215),
    (0.3961140743494011, 1.4142235372531253, 163070.56125994952, 15.5125, 0.741265351214811),
    (0.7711710198857764, 0.83582772330052, 80321.16868803454, 0.5899, 0.6629875695088903),
    (0.0, 999.0, 0.0, 4.9999, 0.31810428571428573),
    (0.0, 999.0, 0.0, 0.9231, 0.2016242857142857),
]


def test_composite_score_of_recorded_runs(spark):
    df = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3] / 100, r[4]) for r in RANKED],
        "silhouette double, davies_bouldin double, calinski_harabasz double, fraud_rate double,"
        " expected double",
    )
    for row in cm.composite_score(df).collect():
        assert row["composite_score"] == pytest.approx(row["expected"], abs=1e-9)


def test_auc_averages_ties_and_handles_one_class(spark):
    rows = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.9)]
    df = spark.createDataFrame(rows, "label int, probability double")
    wins = sum(
        (p > q) + 0.5 * (p == q) for y, p in rows if y == 1 for z, q in rows if z == 0
    )
    assert ev.roc_auc(df).first()[0] == pytest.approx(wins / 6)
    assert ev.roc_auc(df.filter("label = 0")).first()[0] == 0.5


def test_top_k_needs_enough_rows(spark):
    df = spark.createDataFrame(
        [(i, int(i < 30), 1 - i / 200) for i in range(150)], "id int, label int, probability double"
    )
    assert [tuple(r) for r in ev.top_k_precision(df, ["id"]).collect()] == [(100, 0.3)]


def points(spark, rows):
    return spark.createDataFrame(
        [(f"{i:04d}", c, [float(v) for v in x]) for i, (c, x) in enumerate(rows)],
        "k string, cluster int, x array<double>",
    )


def test_two_clusters_with_known_measures(spark):
    df = points(spark, [(0, (0, 0)), (0, (0, 2)), (1, (10, 0)), (1, (10, 2))])
    row = cm.centroid_metrics(df).first()
    assert row["davies_bouldin"] == pytest.approx(0.2)
    assert row["calinski_harabasz"] == pytest.approx(100 * 2 / 4)
    inner, outer = 2.0, (10 + np.sqrt(104)) / 2
    rows = cm.silhouette_rows(df, ["k"]).collect()
    assert [r["silhouette"] for r in rows] == pytest.approx([(outer - inner) / outer] * 4)


def test_noise_needs_more_than_a_hundred_rows(spark):
    df = points(spark, [(0, (0, 0)), (1, (5, 5)), (-1, (9, 9))])
    row = cm.centroid_metrics(df, noise_label=-1).first()
    assert tuple(row) == (999.0, 0.0)
    assert cm.silhouette_squared(df, noise_label=-1) == 0.0
    assert cm.silhouette_rows(df, ["k"], noise_label=-1).count() == 0


def test_minority_ties_take_the_lowest_id(spark):
    df = points(spark, [(2, (0,)), (1, (0,)), (0, (0,)), (0, (0,))])
    flagged = {r["cluster"]: r["flag"] for r in cm.minority_flag(df).collect()}
    assert flagged == {0: 0, 1: 1, 2: 0}


def test_vote_weights(spark):
    rows = [("a", "other", 1), ("a", "kmeans", 0), ("b", "isolation_forest", 1), ("b", "gmm", 1)]
    flags = spark.createDataFrame(rows, "txn_key string, algorithm string, flag int")
    found = {r["txn_key"]: (r["score"], r["label"]) for r in weighted_vote(flags).collect()}
    assert found == {"a": (0.25, 0), "b": (2.5, 1)}
    shares = {r["txn_key"]: r["score"] for r in weighted_vote(flags, normalize=True).collect()}
    assert shares == {"a": 0.2, "b": 1.0}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    first = {r["k"] for r in keyed_sample(df, ["k"], 700).collect()}
    again = {r["k"] for r in keyed_sample(df.repartition(5), ["k"], 700).collect()}
    assert len(first) == 700 and first == again
    assert keyed_sample(df, ["k"], 9000).count() == 5000


def test_dense_ids_beyond_one_task(spark, monkeypatch):
    from riskgraph.operators import keys

    monkeypatch.setattr(keys, "SMALL_IDS", 10)
    df = spark.range(3000).selectExpr("id * id + 7 as k")
    rows = keys.dense_ids(df, "k").orderBy("k").collect()
    assert [r["idx"] for r in rows] == list(range(3000))
