"""Frames are written as columns, lines are read once, and only points in reach are sent or found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskgraph.operators.features import engineer_features
from riskgraph.operators.neighbors import _sent, closest
from riskgraph.session import checkpointed

LINES = [
    "id as trans_id", "timestamp_seconds(1714557600 + 60 * id) as trans_date",
    "cast(id % 3 + 1 as int) as store_code", "id % 4 + 1 as cust_id", "id % 5 + 1 as product_code",
    "id as barcode", "cast(id % 7 + 1 as int) as amount", "1.5d + id as unit_price",
    "1.5d + id as no_discount", "1.0d + id as discounted_unit_price",
    "2.0d * id as discounted_total_price", "0.5d as total_discount_amount",
    "0.0d as unit_campaign_discount",
]


def test_later_steps_read_the_columns_they_need(spark):
    frame = checkpointed(spark.range(10).select("id", F.col("id").cast("string").alias("text")))
    plan = frame.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    assert sorted(r["text"] for r in frame.collect()) == [str(i) for i in range(10)]


def test_features_read_their_source_once(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(40).selectExpr(*LINES).write.parquet(path)
    out = engineer_features(spark.read.parquet(path), ["trans_id"])
    assert out.count() == 40
    assert not [f for f in out.inputFiles() if path in f]


def test_nothing_beyond_the_radius_is_found():
    query = {"vid": pa.array(["q"]), "radius": pa.array([1.0])}
    tile = {"keys": pa.array([["a"], ["b"], ["c"]])}
    found = closest(3)(np.array([[0.0]]), np.array([[0.5], [1.0], [7.0]]), query, tile)
    assert found["keys"].to_pylist() == [["a"], ["b"]]


def test_only_points_in_reach_of_a_leaf_are_sent(spark):
    points = [0.0, 0.0, 5.0, 0.0]
    schema = "leaf long, block long, x array<double>, vid array<string>, radius array<double>"
    blocks = spark.createDataFrame([(1, 0, points, ["p", "q"], [1.0, 5.0])], schema)
    schema = "leaf long, block long, target long, lo array<double>, hi array<double>"
    reach = spark.createDataFrame(
        [(1, 0, 1, [0.0, 0.0], [5.0, 0.0]), (1, 0, 2, [8.0, 0.0], [9.0, 1.0])], schema
    )
    sent = {r["target"]: (r["vid"], r["x"]) for r in _sent(blocks, reach, 2).collect()}
    assert sent == {1: (["p", "q"], points), 2: (["q"], [5.0, 0.0])}
