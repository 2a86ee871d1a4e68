"""Row, customer, product and purchase-gap features of sales lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import (
    MICROS_PER_DAY,
    MICROS_PER_HOUR,
    clip_lower,
    double_columns,
    flag,
    micros,
    nan_to_null,
    numeric_columns,
)
from riskgraph.operators.keys import Pairs, with_distinct_counts, with_row_key
from riskgraph.operators.quantiles import exact_quantiles
from riskgraph.session import checkpointed

# Thresholds and defaults of the feature definitions.
UNUSUAL_AMOUNT = 5
BULK_AMOUNT = 3
PRICE_FLOOR = 0.01
STD_GUARD = 1e-6
HIGH_DISCOUNT_PERCENT = 20
NIGHT_BEFORE, NIGHT_AFTER = 6, 22
BUSINESS_FROM, BUSINESS_TO = 9, 18
HOLIDAY_MONTHS = (11, 12, 1)
NO_PREVIOUS_PURCHASE = 999.0
RAPID_HOURS = 1
REPEAT_HOURS = 24
EXTREME_QUANTILE = 0.99

UNDATED = -(2**62)
CUSTOMER_GAP = ["cust_id"]
PRODUCT_GAP = ["_product", "_customer"]
NO_ID = -(2**62)

# The feature catalogue.
FEATURE_NAMES = [
    "effective_price", "total_price", "price_deviation", "is_high_price", "is_low_price",
    "is_unusual_amount", "is_bulk_purchase",
    "discount_rate", "discount_percentage", "has_campaign", "has_discount",
    "discount_per_unit", "is_high_discount", "campaign_no_discount",
    "hour", "day_of_week", "day_of_month", "month", "year", "is_weekend",
    "is_night_transaction", "is_business_hours", "is_holiday_season",
    "customer_transaction_count", "customer_total_spending", "avg_transaction_value",
    "customer_unique_products", "unique_stores", "return_rate", "transaction_velocity",
    "customer_discount_rate", "customer_campaign_rate",
    "product_popularity", "product_avg_price", "product_price_deviation",
    "product_unique_customers", "product_discount_frequency",
    "is_extreme_value", "time_since_last_trans", "is_rapid_transaction",
    "same_product_time_gap", "is_repeated_product_purchase",
]


def feature_names() -> list[str]:
    return list(FEATURE_NAMES)


def missing_features(df: DataFrame) -> list[str]:
    return [c for c in FEATURE_NAMES if c not in df.columns]


@dataclass(frozen=True)
class PriceStats:
    """Table-wide price figures, a handful of scalars."""

    median: float | None
    std: float | None
    q25: float | None
    q75: float | None
    extreme_total: float | None


def price_stats(df: DataFrame) -> PriceStats:
    """Exact price thresholds of a table with unit and total price."""
    unit, total = "discounted_unit_price", "discounted_total_price"
    narrow = df.select(unit, total)
    std = narrow.agg(F.stddev_samp(unit)).first()[0]
    cuts = exact_quantiles(narrow, {unit: [0.25, 0.5, 0.75], total: [EXTREME_QUANTILE]})
    return PriceStats(
        median=cuts[unit][0.5],
        std=std,
        q25=cuts[unit][0.25],
        q75=cuts[unit][0.75],
        extreme_total=cuts[total][EXTREME_QUANTILE],
    )


def _number(value: float | None):
    return F.lit(value).cast("double")


def price_features(df: DataFrame, stats: PriceStats | None = None) -> DataFrame:
    stats = stats or price_stats(df)
    price = F.col("discounted_unit_price")
    amount = F.col("amount")
    return df.withColumns(
        {
            "effective_price": price,
            "total_price": F.col("discounted_total_price"),
            "price_deviation": F.abs(price - _number(stats.median))
            / (_number(stats.std) + F.lit(STD_GUARD)),
            "is_high_price": flag(price > _number(stats.q75)),
            "is_low_price": flag(price < _number(stats.q25)),
            "is_unusual_amount": flag(amount > UNUSUAL_AMOUNT),
            "is_bulk_purchase": flag(amount >= BULK_AMOUNT),
        }
    )


def discount_features(df: DataFrame) -> DataFrame:
    full = F.col("no_discount")
    given = F.col("total_discount_amount")
    campaign = flag(F.col("unit_campaign_discount") > 0)
    discount = flag(given > 0)
    percent = F.coalesce(
        given / clip_lower(full * F.col("amount"), PRICE_FLOOR) * F.lit(100), F.lit(0.0)
    )
    rate = (full - F.col("discounted_unit_price")) / clip_lower(full, PRICE_FLOOR)
    return df.withColumns(
        {
            "discount_rate": F.coalesce(rate, F.lit(0.0)),
            "discount_percentage": percent,
            "has_campaign": campaign,
            "has_discount": discount,
            "discount_per_unit": given / clip_lower(F.col("amount"), 1),
            "is_high_discount": flag(percent > HIGH_DISCOUNT_PERCENT),
            "campaign_no_discount": campaign * (1 - discount),
        }
    )


def time_features(df: DataFrame, ts: str = "trans_date") -> DataFrame:
    when = F.col(ts)
    hour, dow = F.hour(when), F.weekday(when)
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": dow,
            "day_of_month": F.dayofmonth(when),
            "month": F.month(when),
            "year": F.year(when),
            "is_weekend": flag(dow >= 5),
            "is_night_transaction": flag((hour < NIGHT_BEFORE) | (hour > NIGHT_AFTER)),
            "is_business_hours": flag(hour.between(BUSINESS_FROM, BUSINESS_TO)),
            "is_holiday_season": flag(F.month(when).isin(*HOLIDAY_MONTHS)),
        }
    )


def active_days(first: str, last: str):
    """Whole elapsed 24-hour periods between two instants, plus one."""
    elapsed = micros(F.col(last)) - micros(F.col(first))
    return F.floor(elapsed / F.lit(MICROS_PER_DAY)) + 1


def customer_aggregates(df: DataFrame, pairs: Pairs | None = None) -> DataFrame:
    """One row per customer; distinct counts beside the other figures."""
    known = df.filter(F.col("cust_id").isNotNull())
    figures = known.groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("customer_transaction_count"),
        F.sum("total_price").alias("customer_total_spending"),
        F.avg(flag(F.col("amount") == 1)).alias("return_rate"),
        F.avg("has_discount").alias("customer_discount_rate"),
        F.avg("has_campaign").alias("customer_campaign_rate"),
        F.min("trans_date").alias("_first"),
        F.max("trans_date").alias("_last"),
    )
    counted = {"customer_unique_products": "product_code", "unique_stores": "store_code"}
    grouped = with_distinct_counts(figures, known, "cust_id", counted, pairs=pairs).select(
        *figures.columns[:3], *counted, *figures.columns[3:]
    )
    count = F.col("customer_transaction_count")
    # A sum over nothing but missing prices is 0, as is the velocity without any date.
    spending = F.coalesce(F.col("customer_total_spending"), F.lit(0.0))
    return grouped.withColumns(
        {
            "customer_total_spending": spending,
            "avg_transaction_value": spending / count,
            "transaction_velocity": count / F.greatest(active_days("_first", "_last"), F.lit(1)),
        }
    ).withColumn(
        "transaction_velocity", F.when(F.col("_last").isNotNull(), F.col("transaction_velocity"))
    ).drop("_first", "_last")


def customer_features(df: DataFrame) -> DataFrame:
    return df.join(customer_aggregates(df), "cust_id", "left")


def product_aggregates(df: DataFrame, pairs: Pairs | None = None) -> DataFrame:
    """One row per product; the distinct count beside the other figures."""
    known = df.filter(F.col("product_code").isNotNull())
    figures = known.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("product_popularity"),
        F.avg("effective_price").alias("product_avg_price"),
        F.avg("has_discount").alias("product_discount_frequency"),
    )
    counted = {"product_unique_customers": "cust_id"}
    return with_distinct_counts(figures, known, "product_code", counted, pairs=pairs).select(
        *figures.columns[:3], *counted, *figures.columns[3:]
    )


def with_product_deviation(df: DataFrame) -> DataFrame:
    mean = F.col("product_avg_price")
    gap = F.abs(F.col("effective_price") - mean) / clip_lower(mean, PRICE_FLOOR)
    return df.withColumn("product_price_deviation", gap)


def product_features(df: DataFrame) -> DataFrame:
    return with_product_deviation(df.join(product_aggregates(df), "product_code", "left"))


def with_instant(df: DataFrame, ts: str = "trans_date") -> DataFrame:
    """Microsecond instant of a line; lines without a date share one marker value."""
    return df.withColumn("_at", F.coalesce(micros(F.col(ts)), F.lit(UNDATED)))


def purchase_moments(
    df: DataFrame, keys: Sequence[str], ts: str = "trans_date", row_key: str = "txn_key"
) -> DataFrame:
    """Distinct instants per key with the instant before each of them.

    Tied lines share one instant; ``_carrier`` is the line that keeps the gap to the
    previous instant, the others have gap 0. The look-back runs inside one key and day,
    plus one row per key and day for the step across midnight, so a key with a third of
    all rows is spread over its days. Days are joined on from the left, so that a caller who
    does not read the gap does not pay for them.
    """
    known = [F.col(c).isNotNull() for c in keys]
    moments = (
        with_instant(df, ts)
        .filter(reduce(Column.__and__, known))
        .groupBy(*keys, "_at")
        .agg(F.min(row_key).alias("_carrier"))
        .withColumn("_day", F.floor(F.col("_at") / F.lit(MICROS_PER_DAY)))
    )
    inside = F.lag("_at").over(Window.partitionBy(*keys, "_day").orderBy("_at"))
    day_before = F.lag("_day_end").over(Window.partitionBy(*keys).orderBy("_day"))
    days = (
        moments.groupBy(*keys, "_day")
        .agg(F.max("_at").alias("_day_end"))
        .withColumn("_before_day", F.nullif(day_before, F.lit(UNDATED)))
        .drop("_day_end")
    )
    return (
        moments.withColumn("_inside", inside)
        .join(days, [*keys, "_day"], "left")
        .withColumn("_previous", F.coalesce("_inside", "_before_day"))
        .select(*keys, "_at", "_carrier", "_previous")
    )


def gap_hours(row_key: str = "txn_key"):
    """Gap of a line joined to its moment; null without a date or an earlier line."""
    hours = (F.col("_at") - F.col("_previous")) / F.lit(MICROS_PER_HOUR)
    dated = F.col("_at") != UNDATED
    return F.when(dated & (F.col(row_key) == F.col("_carrier")), hours).when(
        dated & F.col("_carrier").isNotNull(), F.lit(0.0)
    )


def join_moments(df: DataFrame, frame: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Attach a per-moment frame to its lines and compute the gap column ``name``."""
    return (
        df.join(frame, [*keys, "_at"], "left")
        .withColumn(name, gap_hours())
        .drop("_carrier", "_previous")
    )


def with_pair_keys(df: DataFrame) -> DataFrame:
    """Product and customer of a line, a missing id counting as one more id."""
    ids = {"_product": "product_code", "_customer": "cust_id"}
    return df.withColumns(
        {name: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)) for name, c in ids.items()}
    )


def customer_gap_flags(df: DataFrame) -> DataFrame:
    gap = F.col("time_since_last_trans")
    return df.withColumns(
        {
            "is_rapid_transaction": flag(gap < RAPID_HOURS),
            "time_since_last_trans": F.coalesce(gap, F.lit(NO_PREVIOUS_PURCHASE)),
        }
    )


def product_gap_flags(df: DataFrame) -> DataFrame:
    gap = F.coalesce(F.col("same_product_time_gap"), F.lit(NO_PREVIOUS_PURCHASE))
    return df.withColumns(
        {
            "same_product_time_gap": gap,
            "is_repeated_product_purchase": flag(gap < REPEAT_HOURS),
        }
    )


def customer_gap_features(df: DataFrame, ts: str = "trans_date") -> DataFrame:
    """Gap to the customer's previous line; needs a unique ``txn_key``."""
    moments = purchase_moments(df, CUSTOMER_GAP, ts)
    joined = join_moments(with_instant(df, ts), moments, CUSTOMER_GAP, "time_since_last_trans")
    return customer_gap_flags(joined.drop("_at"))


def product_gap_features(df: DataFrame, ts: str = "trans_date") -> DataFrame:
    """Gap to the customer's previous line of the same product; needs ``txn_key``."""
    paired = with_pair_keys(df)
    moments = purchase_moments(paired, PRODUCT_GAP, ts)
    joined = join_moments(with_instant(paired, ts), moments, PRODUCT_GAP, "same_product_time_gap")
    return product_gap_flags(joined.drop("_at", *PRODUCT_GAP))


def extreme_value_flag(df: DataFrame, stats: PriceStats | None = None) -> DataFrame:
    stats = stats or price_stats(df)
    return df.withColumn(
        "is_extreme_value", flag(F.col("total_price") > _number(stats.extreme_total))
    )


def cleanup(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Drop helper columns; missing and infinite numbers become 0."""
    kept = df.drop(*drop)
    doubles = set(double_columns(kept))

    def clean(name: str):
        value = F.coalesce(F.col(name), F.lit(0))
        if name in doubles:
            value = F.when(F.isnan(name) | (F.abs(F.col(name)) == float("inf")), 0.0).otherwise(
                value
            )
        return value.cast(kept.schema[name].dataType)

    return kept.withColumns({c: clean(c) for c in numeric_columns(kept)})


def _feature_order(source: Sequence[str]) -> list[str]:
    """Customer id, the other given columns and the key, row features, figures and gaps."""
    late = [
        "customer_transaction_count", "customer_total_spending", "customer_unique_products",
        "unique_stores", "return_rate", "customer_discount_rate", "customer_campaign_rate",
        "avg_transaction_value", "transaction_velocity", "time_since_last_trans",
        "product_popularity", "product_avg_price", "product_unique_customers",
        "product_discount_frequency", "same_product_time_gap", "product_price_deviation",
        "is_rapid_transaction", "is_repeated_product_purchase",
    ]
    row = [c for c in FEATURE_NAMES if c not in late]
    given = [c for c in source if c not in (*row, *late)]
    return [*dict.fromkeys(["cust_id", *given]), *row, *late]


def engineer_features(df: DataFrame, key_columns: Sequence[str] | None = None) -> DataFrame:
    """All features, one output row per input row.

    ``key_columns`` names columns that identify a line; without them a key is built from
    the whole row. Every aggregate is computed from the row features alone, and customer
    and product figures travel with the purchase moments: fact rows are joined twice, on
    keys much finer than a customer or a product. Lines are written once; the joins carry
    the given columns only, what follows from a row alone is computed behind them.
    """
    lines = nan_to_null(df)
    derived = bool(key_columns) and "txn_key" not in df.columns
    # A key built from columns is computed where it is compared; any other one is kept.
    facts = checkpointed(lines if derived else with_row_key(lines, key_columns))
    stats = price_stats(facts)
    keyed = with_row_key(facts, key_columns)
    base = discount_features(price_features(keyed, stats))
    # Bytes of a digest order as its text does and take half the room.
    tagged = base.withColumn("_tag", F.unhex("txn_key") if derived else F.col("txn_key"))

    def moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return purchase_moments(rows, keys, row_key="_tag")

    def attach(rows: DataFrame, frame: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        joined = with_row_key(rows.join(frame, [*keys, "_at"], "left"), key_columns)
        carried = joined.withColumn("_tag", F.unhex("txn_key") if derived else F.col("txn_key"))
        timed = carried.withColumn(name, gap_hours("_tag")).drop("_carrier", "_previous", "_tag")
        return timed.drop("txn_key") if derived else timed

    customers = moments(tagged, CUSTOMER_GAP).join(customer_aggregates(base), "cust_id")
    figures = product_aggregates(base).withColumnRenamed("product_code", "_product")
    products = moments(with_pair_keys(tagged), PRODUCT_GAP).join(figures, "_product", "left")
    # The narrower figures first: they are carried through the second join.
    paired = with_pair_keys(with_instant(facts))
    joined = attach(paired, products, PRODUCT_GAP, "same_product_time_gap").drop(*PRODUCT_GAP)
    joined = attach(joined, customers, CUSTOMER_GAP, "time_since_last_trans")
    priced = discount_features(price_features(with_row_key(joined, key_columns), stats))
    rows = extreme_value_flag(time_features(priced), stats)
    flagged = product_gap_flags(customer_gap_flags(with_product_deviation(rows)))
    return cleanup(flagged, drop=["_at"]).select(*_feature_order(keyed.columns))
