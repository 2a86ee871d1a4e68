"""Rule labels from price quantiles and z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.expressions import flag
from riskgraph.operators.quantiles import exact_quantiles

# The four rule labels.
LABEL_QUANTILES = {"quantile_99": 0.99, "quantile_95": 0.95, "quantile_90": 0.90}
Z_LIMIT = 3
LABEL_NAMES = [*LABEL_QUANTILES, "z_score"]
PRICE_SOURCES = ("discounted_total_price", "amount")


def label_source(df: DataFrame) -> str:
    """Column the rule labels read."""
    for name in PRICE_SOURCES:
        if name in df.columns:
            return name
    raise ValueError("No price column found")


def quantile_labels(
    df: DataFrame, column: str | None = None, quantiles: dict[str, float] | None = None
) -> DataFrame:
    """1 where the value is strictly above the quantile."""
    column = column or label_source(df)
    quantiles = quantiles or LABEL_QUANTILES
    cuts = exact_quantiles(df.select(column), {column: list(quantiles.values())})[column]
    return df.withColumns(
        {name: flag(F.col(column) > F.lit(cuts[q])) for name, q in quantiles.items()}
    )


def zscore_label(df: DataFrame, column: str | None = None, name: str = "z_score") -> DataFrame:
    """1 where the value lies more than three population deviations above the mean."""
    column = column or label_source(df)
    mean, std = df.agg(F.avg(column), F.stddev_pop(column)).first()
    score = F.try_divide(F.col(column) - F.lit(mean), F.lit(std))
    return df.withColumn(name, flag(score > Z_LIMIT))


def rule_labels(df: DataFrame) -> DataFrame:
    """All four rule labels as columns."""
    return df.transform(quantile_labels).transform(zscore_label)


def ensure_label(df: DataFrame, quantile: float = 0.99, name: str = "fraud_label") -> DataFrame:
    """Keep an existing label, else derive one from the price, else from the amount."""
    if name in df.columns:
        return df
    return quantile_labels(df, None, {name: quantile})


def label_rate(df: DataFrame, by: str, label: str = "fraud_label") -> DataFrame:
    """Rows and label rate per value of ``by``."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(label).cast("long").alias("positives"),
        F.avg(label).alias("label_rate"),
    )


def class_weights(df: DataFrame, label: str = "fraud_label", name: str = "weight") -> DataFrame:
    """Weight 1 for label 0 and (1 - r) / r for label 1, r being the label rate."""
    rate = df.agg(F.avg(label)).first()[0]
    positive = (1 - rate) / rate if rate else 1.0
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(1.0)))


def weighted_log_loss(
    df: DataFrame, label: str, probability: str, weights: Sequence[float], name: str = "log_loss"
) -> DataFrame:
    """Weighted mean of -log(probability of the true class)."""
    truth = F.col(label) == 1
    weight = F.when(truth, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    p_true = F.when(truth, F.col(probability)).otherwise(1 - F.col(probability))
    return df.agg((F.sum(weight * -F.log(p_true)) / F.sum(weight)).alias(name))
