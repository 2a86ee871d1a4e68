"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def clip_lower(value: Column, low: float) -> Column:
    """Lower bound that keeps nulls (``greatest`` alone would replace them)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(low)))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def comma_double(text: Column) -> Column:
    """Comma-decimal text to double, unreadable text and ``NaN`` to null."""
    number = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(number), number)


def lenient_timestamp(text: Column) -> Column:
    """Timestamp of ISO-like text, null when it cannot be read."""
    return text.try_cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hash_text(columns: Sequence[str], seed: int) -> Column:
    """md5 over seed and key columns: a reproducible shuffle order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_unit(columns: Sequence[str], seed: int) -> Column:
    """Reproducible uniform number in [0, 1) from key columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), 11)
    return bits.cast("double") / F.lit(float(2**53))


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark orders NaN above every number, so missing values are kept as null."""
    names = double_columns(df)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names}) if names else df
