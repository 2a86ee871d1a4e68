"""CSV transaction sources, layout rules and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.functions.expressions import comma_double, lenient_timestamp, nan_to_null

# The two file layouts.
ID_FIELDS = [
    ("trans_id", T.LongType()),
    ("trans_date", T.StringType()),
    ("store_code", T.IntegerType()),
    ("cust_id", T.LongType()),
    ("product_code", T.LongType()),
    ("barcode", T.LongType()),
    ("amount", T.IntegerType()),
]
PRICE_COLUMNS = [
    "unit_price",
    "no_discount",
    "discounted_unit_price",
    "discounted_total_price",
    "total_discount_amount",
    "unit_campaign_discount",
]
REQUIRED_COLUMNS = [
    "trans_id",
    "trans_date",
    "store_code",
    "cust_id",
    "product_code",
    "barcode",
    "amount",
    "unit_price",
]
HEADERED_PATH_MARKS = ("combined_sales", "Copy of")
COLUMN_MAPPING = {name.upper(): name for name in REQUIRED_COLUMNS}

HEADERLESS_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in ID_FIELDS] + [T.StructField("unit_price", T.DoubleType())]
)
HEADERED_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in ID_FIELDS]
    + [T.StructField(c, T.StringType()) for c in PRICE_COLUMNS]
)


def placeholder_prices() -> dict[str, Column]:
    """Price columns a source without discounts lacks."""
    price = F.col("unit_price")
    return {
        "no_discount": price,
        "discounted_unit_price": price,
        "discounted_total_price": price * F.col("amount"),
        "total_discount_amount": F.lit(0.0),
        "unit_campaign_discount": F.lit(0.0),
    }


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    """Eight columns without a header; the discount columns are filled in."""
    raw = spark.read.schema(HEADERLESS_SCHEMA).option("header", False).csv(path)
    return raw.withColumn("trans_date", lenient_timestamp(F.col("trans_date"))).withColumns(
        placeholder_prices()
    )


def read_headered(spark: SparkSession, path: str) -> DataFrame:
    """Thirteen columns with a header and comma decimals."""
    raw = spark.read.schema(HEADERED_SCHEMA).option("header", True).csv(path)
    return raw.withColumn("trans_date", lenient_timestamp(F.col("trans_date"))).withColumns(
        {c: comma_double(F.col(c)) for c in PRICE_COLUMNS}
    )


READERS = {"headerless": read_headerless, "headered": read_headered}


def layout_of(path: str) -> str:
    return "headered" if any(mark in path for mark in HEADERED_PATH_MARKS) else "headerless"


def load_transactions(
    spark: SparkSession, path: str, layout: str | None = None, limit: int | None = None
) -> DataFrame:
    """Read one of the two layouts; without ``layout`` the path decides."""
    layout = layout or layout_of(path)
    if layout not in READERS:
        raise ValueError(f"unknown layout {layout!r}; expected one of {sorted(READERS)}")
    df = nan_to_null(READERS[layout](spark, path))
    return df.limit(limit) if limit else df


def rename_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Apply the upper-case to lower-case name map; absent names are ignored."""
    return df.withColumnsRenamed(mapping or COLUMN_MAPPING)


def validate_required_columns(df: DataFrame, required: list[str] | None = None) -> bool:
    missing = [c for c in required or REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return True


def require_rows(df: DataFrame, minimum: int = 1) -> DataFrame:
    """Raise unless the frame has at least ``minimum`` rows; reads no more than that."""
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"Need at least {minimum} rows, found {found}")
    return df


def require_both_labels(df: DataFrame, label: str = "fraud_label") -> DataFrame:
    """Raise unless both label values occur."""
    low, high = df.agg(F.min(label), F.max(label)).first()
    if low is None or low == high:
        raise ValueError(f"Column {label} must hold both 0 and 1, found only {low}")
    return df


def first_rows(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows: of a stated order, or of the scan when none is given."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def date_window(
    df: DataFrame,
    start: str,
    end: str,
    n: int | None = None,
    ts: str = "trans_date",
    tie_break: tuple[str, ...] = ("trans_id",),
) -> DataFrame:
    """Rows between two instants, both included; the ``n`` earliest when ``n`` is given."""
    bounds = [F.lit(t).cast("timestamp") for t in (start, end)]
    kept = df.filter(F.col(ts).between(*bounds))
    return kept if n is None else kept.orderBy(F.asc_nulls_last(ts), *tie_break).limit(n)
