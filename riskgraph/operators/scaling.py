"""Standardised feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The features used for clustering.
CLUSTERING_FEATURES = [
    "price_deviation", "return_rate", "transaction_velocity", "is_unusual_amount",
    "unique_stores", "product_popularity", "total_price", "is_night_transaction",
    "is_bulk_purchase", "avg_transaction_value", "discount_rate", "has_campaign",
    "is_high_discount", "customer_discount_rate", "product_discount_frequency",
]


def require_features(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing features: {missing}")


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean, unit population deviation; a constant column becomes 0."""
    require_features(df, columns)
    moments = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, std = moments[f"m{i}"], moments[f"s{i}"]
        scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)
    return df.withColumns(scaled)


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "x") -> DataFrame:
    """Columns as one array of doubles."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))


def prepare_features(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Keys and the standardised feature array ``x``."""
    columns = list(columns or CLUSTERING_FEATURES)
    scaled = standardize(df.select(*keys, *[c for c in columns if c in df.columns]), columns)
    return with_vector(scaled, columns).select(*keys, "x")


def ml_vector(df: DataFrame, source: str = "x", name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(source))
