"""The earlier, smaller feature set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.expressions import flag
from riskgraph.operators.features import active_days

# Definitions of the earlier feature set.
GUEST = 0
NIGHT_FROM, NIGHT_UNTIL = 22, 6
HIGH_VALUE = 5000
BULK_AMOUNT = 10
UNUSUAL_FACTOR = 3
CUSTOMER_COLUMNS = [
    "transaction_count",
    "total_spent",
    "avg_transaction_value",
    "transaction_velocity",
    "unique_stores",
    "return_rate",
]


def v1_price_features(df: DataFrame) -> DataFrame:
    negative = flag(F.col("unit_price") < 0)
    return df.withColumns(
        {"total_price": F.col("amount") * F.col("unit_price"), "is_return": negative}
    )


def v1_time_features(df: DataFrame) -> DataFrame:
    hour, dow = F.hour("trans_date"), F.weekday("trans_date")
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": dow,
            "day_of_month": F.dayofmonth("trans_date"),
            "is_weekend": flag(dow >= 5),
            "is_night_transaction": flag((hour >= NIGHT_FROM) | (hour <= NIGHT_UNTIL)),
        }
    )


def without_guests(df: DataFrame) -> DataFrame:
    # A missing customer id is not the guest id, but no group holds it either.
    return df.filter((F.col("cust_id") != GUEST) | F.col("cust_id").isNull())


def v1_customer_aggregates(df: DataFrame) -> DataFrame:
    count = F.col("transaction_count")
    return (
        without_guests(df)
        .filter(F.col("cust_id").isNotNull())
        .groupBy("cust_id")
        .agg(
            F.count("trans_id").alias("transaction_count"),
            F.coalesce(F.sum("total_price"), F.lit(0.0)).alias("total_spent"),
            F.avg("total_price").alias("avg_transaction_value"),
            F.count_distinct("store_code").alias("unique_stores"),
            F.min("trans_date").alias("_first"),
            F.max("trans_date").alias("_last"),
            F.sum("is_return").alias("return_count"),
        )
        .withColumn("days_active", active_days("_first", "_last"))
        .withColumn("transaction_velocity", count / F.col("days_active"))
        .withColumn("return_rate", F.try_divide(F.col("return_count"), count))
        .drop("_first", "_last")
    )


def v1_customer_features(df: DataFrame) -> DataFrame:
    aggregates = v1_customer_aggregates(df).select("cust_id", *CUSTOMER_COLUMNS)
    joined = df.join(aggregates, "cust_id", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CUSTOMER_COLUMNS}
    )


def product_median_amount(df: DataFrame) -> DataFrame:
    """Median amount per product from an amount histogram, so hot products stay small."""
    histogram = df.groupBy("product_code", "amount").agg(F.count(F.lit(1)).alias("n"))
    return histogram.groupBy("product_code").agg(
        F.percentile("amount", F.lit(0.5), F.col("n")).alias("product_median_amount")
    )


def v1_product_aggregates(df: DataFrame) -> DataFrame:
    known = without_guests(df).filter(F.col("product_code").isNotNull())
    moments = known.groupBy("product_code").agg(
        F.avg("unit_price").alias("product_avg_price"),
        F.stddev_samp("unit_price").alias("product_price_std"),
        F.avg("amount").alias("product_avg_amount"),
        F.count("trans_id").alias("product_popularity"),
    )
    return moments.join(product_median_amount(known), "product_code")


def v1_product_features(df: DataFrame) -> DataFrame:
    joined = df.join(v1_product_aggregates(df), "product_code", "left")
    gap = F.abs(F.col("unit_price") - F.col("product_avg_price"))
    unusual = F.col("amount") > F.col("product_median_amount") * UNUSUAL_FACTOR
    return joined.withColumns(
        {
            "price_deviation": F.coalesce(gap, F.lit(0.0)),
            "is_unusual_amount": flag(unusual),
        }
    )


def v1_value_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "is_negative_price": flag(F.col("unit_price") < 0),
            "is_high_value": flag(F.col("total_price") > HIGH_VALUE),
            "is_bulk_purchase": flag(F.col("amount") > BULK_AMOUNT),
        }
    )


def v1_engineer_features(df: DataFrame) -> DataFrame:
    steps = (
        v1_price_features,
        v1_time_features,
        v1_customer_features,
        v1_product_features,
        v1_value_flags,
    )
    for step in steps:
        df = df.transform(step)
    helpers = ("product_avg_price", "product_price_std", "product_median_amount")
    return df.drop(*helpers).fillna(0)
