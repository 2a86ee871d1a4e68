"""Ordered buckets, brackets that do not shrink, missing values and tree samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.operators import evaluate as ev
from riskgraph.operators import keys, quantiles
from riskgraph.operators.iforest import tree_samples
from riskgraph.operators.profile import describe_numeric, missing_values


@pytest.mark.parametrize("bucket_rows", [1, 7, 400, 10_000])
def test_buckets_keep_the_order(spark, bucket_rows):
    rng = np.random.default_rng(2)
    values = [None, *map(float, rng.lognormal(size=3000)), *[1.0] * 500]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    count, placed = quantiles.with_ordered_bucket(df, "v", bucket_rows)
    rows = sorted((r["v"], r["_ordered"]) for r in placed.filter("v is not null").collect())
    assert count == 3500 and len(rows) == 3500 and placed.count() == 3501
    order = [b for _, b in rows]
    assert order == sorted(order)
    sizes = np.unique(order, return_counts=True)[1]
    if bucket_rows == 7:
        assert len(sizes) > 300 and np.sort(sizes)[-2] < 70
    if bucket_rows == 10_000:
        assert len(sizes) == 1


def test_score_table_is_the_same_with_any_buckets(spark):
    rng = np.random.default_rng(4)
    data = [(int(rng.random() < 0.4), float(rng.integers(0, 900)) / 7) for _ in range(4000)]
    df = spark.createDataFrame(data, "label int, score double").cache()
    tables = [
        sorted(map(tuple, ev.score_table(df, "label", "score", bucket_rows=n).collect()))
        for n in (1, 20, 10**6)
    ]
    assert tables[0] == tables[1] == tables[2]


def test_dense_ids_with_thousands_of_buckets(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id * id - 50 as k")
    monkeypatch.setattr(keys, "SMALL_IDS", 1)
    rows = keys.dense_ids(df, "k").orderBy("k").collect()
    assert [r["idx"] for r in rows] == list(range(6000))


def test_brackets_left_wide_are_ordered_in_buckets(spark, monkeypatch):
    """Sketches that never narrow leave whole columns; the result is the same."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=2000)
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    monkeypatch.setattr(quantiles, "_place", lambda *a: False)
    found = quantiles.exact_quantiles(df, {"v": [0.0, 0.13, 0.5, 1.0]}, limit=50)["v"]
    for q, value in found.items():
        assert value == pytest.approx(np.quantile(v, q), abs=1e-12)


def test_nan_counts_as_missing(spark):
    data = [(1.0, 1), (float("nan"), 2), (3.0, None), (None, 4)]
    df = spark.createDataFrame(data, "a double, b int")
    rows = {r["column"]: r for r in describe_numeric(df).collect()}
    assert (rows["a"]["count"], rows["a"]["mean"], rows["a"]["p50"], rows["a"]["max"]) == (2, 2.0, 2.0, 3.0)
    assert (rows["b"]["count"], rows["b"]["min"], rows["b"]["max"]) == (3, 1.0, 4.0)
    assert {r["column"]: r["missing"] for r in missing_values(df).collect()} == {"a": 2, "b": 1}
    empty = {r["column"]: r for r in describe_numeric(df.limit(0)).collect()}
    assert empty["a"]["count"] == 0 and empty["a"]["p50"] is None


@pytest.mark.parametrize("total", [0, 20, 300, 5000])
def test_tree_samples_are_the_smallest_hashes(spark, total):
    df = spark.range(total).select(
        F.col("id").cast("string").alias("k"), F.array(F.col("id").cast("double")).alias("x")
    )
    found = tree_samples(df.repartition(5), "k", trees=12, rows=64, seed=3).collect()
    hashes = df.select(
        F.col("x")[0].alias("v"), *[F.xxhash64(F.lit(3), F.lit(t), F.col("k")).alias(f"h{t}") for t in range(12)]
    ).collect()
    for t in range(12):
        want = {r["v"] for r in sorted(hashes, key=lambda r: r[f"h{t}"])[:64]}
        assert {r["x"][0] for r in found if r["tree"] == t} == want
    assert len(found) == 12 * min(64, total)
