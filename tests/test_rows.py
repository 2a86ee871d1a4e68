"""Small hand-made tables with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import features as fe
from riskgraph.operators import graph as gr
from riskgraph.operators import keys
from riskgraph.operators import v1
from riskgraph.operators.labels import ensure_label
from riskgraph.operators.scaling import prepare_features, standardize
from riskgraph.operators.score import level_summary, predict_at, risk_level
from riskgraph.sources import transactions as src


def day(text):
    return dt.datetime.fromisoformat(text)


def gaps(spark, rows, keep=("time_since_last_trans", "is_rapid_transaction")):
    df = spark.createDataFrame(rows, "txn_key string, cust_id long, trans_date timestamp")
    out = fe.customer_gap_features(df)
    return {r["txn_key"]: tuple(r[c] for c in keep) for r in out.collect()}


def test_comma_prices(spark):
    df = spark.createDataFrame([("12,50",), ("7",), ("",), ("x",), (None,)], "t string")
    values = [r[0] for r in df.select(src.comma_double(F.col("t"))).collect()]
    assert values == [12.5, 7.0, None, None, None]


def test_bad_dates_become_null(spark):
    df = spark.createDataFrame([("2024-05-01 10:00:00",), ("2024-13-01",), ("",)], "t string")
    values = [r[0] for r in df.select(src.lenient_timestamp(F.col("t"))).collect()]
    assert values == [day("2024-05-01 10:00:00"), None, None]


def test_layout_rule_and_validation(spark):
    assert src.layout_of("/x/combined_sales_1.csv") == "headered"
    assert src.layout_of("/x/2024_05.csv") == "headerless"
    with pytest.raises(ValueError, match="unit_price"):
        src.validate_required_columns(spark.range(1).withColumnRenamed("id", "trans_id"))
    with pytest.raises(ValueError):
        src.require_rows(spark.range(3), 5)
    with pytest.raises(ValueError):
        src.require_both_labels(spark.createDataFrame([(1,), (1,)], "fraud_label int"))


def test_gaps_with_ties_and_missing_dates(spark):
    found = gaps(
        spark,
        [
            ("a", 1, day("2024-05-01 23:00:00")),
            ("b", 1, day("2024-05-02 01:00:00")),
            ("c", 1, day("2024-05-02 01:00:00")),
            ("d", 1, None),
            ("e", 2, None),
            ("f", 2, None),
            ("g", 3, day("2024-05-02 01:00:00")),
            ("h", 1, day("2024-05-05 01:30:00")),
        ],
    )
    assert found == {
        "a": (999.0, 0), "b": (2.0, 0), "c": (0.0, 1), "d": (999.0, 0), "e": (999.0, 0),
        "f": (999.0, 0), "g": (999.0, 0), "h": (72.5, 0),
    }


def test_velocity_counts_elapsed_days(spark):
    df = spark.createDataFrame(
        [(day("2024-05-01 23:00:00"), day("2024-05-02 01:00:00"))], "a timestamp, b timestamp"
    )
    assert df.select(fe.active_days("a", "b")).first()[0] == 1


def test_zero_and_missing_prices(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1.0, 2, 0.0), (None, 5.0, 1.0, 2, 1.0), (10.0, 8.0, None, 0, 0.0)],
        "no_discount double, discounted_unit_price double, total_discount_amount double,"
        " amount int, unit_campaign_discount double",
    )
    rows = fe.discount_features(df).collect()
    assert [r["discount_rate"] for r in rows] == [0.0, 0.0, 0.2]
    assert rows[0]["discount_percentage"] == pytest.approx(1.0 / 0.01 * 100)
    assert rows[1]["discount_percentage"] == 0.0
    assert rows[2]["discount_per_unit"] is None
    assert [r["campaign_no_discount"] for r in rows] == [0, 0, 0]


def test_cleanup_handles_nan_and_infinity(spark):
    df = spark.createDataFrame(
        [(math.nan, 1, "s"), (math.inf, None, None), (-math.inf, 2, "t"), (3.5, 3, "u")],
        "v double, i int, s string",
    )
    rows = fe.cleanup(df).collect()
    assert [r["v"] for r in rows] == [0.0, 0.0, 0.0, 3.5]
    assert [r["i"] for r in rows] == [1, 0, 2, 3]
    assert [r["s"] for r in rows] == ["s", None, "t", "u"]


def test_monday_is_zero(spark):
    df = spark.createDataFrame(
        [(day("2024-05-05 12:00:00"),), (day("2024-05-06 23:00:00"),)], "trans_date timestamp"
    )
    rows = fe.time_features(df).collect()
    assert [(r["day_of_week"], r["is_weekend"]) for r in rows] == [(6, 1), (0, 0)]
    assert [r["is_night_transaction"] for r in rows] == [0, 1]
    assert [r["is_night_transaction"] for r in v1.v1_time_features(df).collect()] == [0, 1]


def test_txn_key_is_unique_for_copies(spark, monkeypatch):
    monkeypatch.setattr(keys, "COPIES_PER_BLOCK", 7)
    rows = [(1, "a")] * 50 + [(2, None), (2, None), (3, "b")]
    out = keys.with_txn_key(spark.createDataFrame(rows, "id long, t string"))
    assert sorted((r["id"], r["t"] or "") for r in out.collect()) == sorted(
        (i, t or "") for i, t in rows
    )
    assert out.select("txn_key").distinct().count() == len(rows)


def test_keys_of_different_rows_differ(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "-"), ("-", None), ("\u0000", None), ("", "1:a"), ("1:a", "")]
    df = spark.createDataFrame(rows, "s string, t string")
    for out in (keys.with_txn_key(df), keys.with_row_key(df, ["s", "t"])):
        assert out.select("txn_key").distinct().count() == len(rows)


def test_unknown_ids_fall_to_zero(spark):
    ids = spark.createDataFrame([(5, 0), (9, 1)], "cust_id long, idx long")
    df = spark.createDataFrame([(9,), (7,), (None,)], "cust_id long")
    out = keys.lookup_ids(df, ids, "cust_id", "customer_idx")
    found = {r["cust_id"]: (r["customer_idx"], r["is_known_cust_id"]) for r in out.collect()}
    assert found == {9: (1, 1), 7: (0, 0), None: (0, 0)}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in standardize(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError, match="absent"):
        prepare_features(df.withColumn("k", F.lit(1)), ["k"], ["a", "absent"])


def test_single_store_figures_are_scaled(spark):
    df = spark.createDataFrame(
        [(7, 1, 1, 10.0), (7, 2, 1, 30.0)],
        "store_code int, cust_id long, product_code long, total_price double",
    )
    row = gr.store_nodes(df).first()
    assert tuple(row) == (7, 0.002, 20.0, 0.02, 0.01)


def test_invalid_ids_are_dropped(spark):
    rows = [(1, 1, 1), (0, 1, 1), (-1, 1, 1), (1, 0, 1), (1, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "cust_id long, product_code long, store_code int")
    assert gr.valid_lines(df).count() == 1


def test_risk_levels_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.7,), (1.0,)], "fraud_probability double")
    scored = risk_level(predict_at(df))
    assert [r["fraud_risk_level"] for r in scored.collect()] == [
        None, "Low", "Medium", "Medium", "High",
    ]
    assert tuple(level_summary(scored).first()) == (5, 3, 0.6, 1, 2, 1)


def test_existing_label_is_kept(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "amount int, fraud_label int")
    assert ensure_label(df) is df


def test_features_keep_every_row(spark):
    rows = [
        (1, day("2024-05-01 10:00:00"), 1, 0, 5, 50, 1, 2.0, 2.0, 2.0, 2.0, 0.0, 0.0),
        (1, day("2024-05-01 10:00:00"), 1, 0, 5, 50, 1, 2.0, 2.0, 2.0, 2.0, 0.0, 0.0),
        (2, None, 1, None, 6, 60, 2, math.nan, None, None, None, None, None),
    ]
    schema = (
        "trans_id long, trans_date timestamp, store_code int, cust_id long, product_code long,"
        " barcode long, amount int, unit_price double, no_discount double,"
        " discounted_unit_price double, discounted_total_price double,"
        " total_discount_amount double, unit_campaign_discount double"
    )
    out = fe.engineer_features(spark.createDataFrame(rows, schema))
    found = out.orderBy("trans_id", "time_since_last_trans").collect()
    assert len(found) == 3 and fe.missing_features(out) == []
    assert [r["time_since_last_trans"] for r in found] == [0.0, 999.0, 999.0]
    assert [r["customer_transaction_count"] for r in found] == [2, 2, 0]
    assert found[2]["product_popularity"] == 1 and found[2]["unit_price"] == 0.0


def test_lines_without_customer_share_product_gaps(spark):
    rows = [
        ("a", None, 5, day("2024-05-01 10:00:00")),
        ("b", None, 5, day("2024-05-01 12:00:00")),
        ("c", 1, 5, day("2024-05-01 13:00:00")),
        ("d", 1, None, day("2024-05-01 14:00:00")),
        ("e", 1, None, day("2024-05-03 14:00:00")),
    ]
    schema = "txn_key string, cust_id long, product_code long, trans_date timestamp"
    out = fe.product_gap_features(spark.createDataFrame(rows, schema))
    found = {r["txn_key"]: r["same_product_time_gap"] for r in out.collect()}
    assert found == {"a": 999.0, "b": 2.0, "c": 999.0, "d": 999.0, "e": 48.0}
