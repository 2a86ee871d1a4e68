"""Table profiles and comparison of two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.expressions import numeric_columns
from riskgraph.operators.quantiles import nan_as_null, quantiles_and

ENTITY_COLUMNS = {"customers": "cust_id", "products": "product_code", "stores": "store_code"}


def table_info(df: DataFrame) -> DataFrame:
    """One row: size, date range, distinct entities, null count and type per column; NaN is null."""
    df = nan_as_null(df, df.columns)
    has = set(df.columns)
    figures = [F.count(F.lit(1)).alias("rows")]
    figures += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    for name, agg in (("date_min", F.min), ("date_max", F.max)):
        source = agg("trans_date") if "trans_date" in has else F.lit(None).cast("timestamp")
        figures.append(source.alias(name))
    for name, key in ENTITY_COLUMNS.items():
        figures.append((F.count_distinct(key) if key in has else F.lit(0)).alias(name))
    flat = df.agg(*figures)
    nulls = F.map_from_arrays(
        F.array(*[F.lit(c) for c in df.columns]),
        F.array(*[F.col(f"null_{c}") for c in df.columns]),
    )
    types = F.map_from_arrays(
        F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.lit(t) for _, t in df.dtypes])
    )
    return flat.select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        "date_min",
        "date_max",
        *ENTITY_COLUMNS,
        nulls.alias("null_counts"),
        types.alias("dtypes"),
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max, one row per numeric column; NaN is missing."""
    columns = columns or numeric_columns(df)
    marks = (0.25, 0.5, 0.75)
    figures = {}
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        figures |= {
            f"_mean{i}": F.avg(value),
            f"_std{i}": F.stddev_samp(value),
            f"_min{i}": F.min(value),
            f"_max{i}": F.max(value),
            f"_count{i}": F.count(value),
        }
    cuts, found = quantiles_and(df, {c: marks for c in columns}, figures)
    rows = [
        (
            c, found[f"_count{i}"], found[f"_mean{i}"], found[f"_std{i}"], found[f"_min{i}"],
            *[cuts[c][q] for q in marks], found[f"_max{i}"],
        )
        for i, c in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, count long, mean double, std double, min double, p25 double, p50 double,"
        " p75 double, max double",
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column; NaN is missing."""
    df = nan_as_null(df, df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"), F.col("_rows"))
            for c in df.columns
        ]
    )
    percent = F.try_divide(F.col("missing"), F.col("_rows")) * 100
    return counted.select(F.inline(pairs)).select(
        "column", "missing", F.coalesce(percent, F.lit(0.0)).alias("missing_pct")
    )


def compare_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """``column, side`` with side in common / removed / new."""
    before, after = set(old.columns), set(new.columns)
    side = {c: "common" for c in before & after}
    side |= {c: "removed" for c in before - after}
    side |= {c: "new" for c in after - before}
    return old.sparkSession.createDataFrame(sorted(side.items()), "column string, side string")


def compare_types(old: DataFrame, new: DataFrame) -> DataFrame:
    """Type of every common column on both sides."""
    spark = old.sparkSession
    frames = [
        spark.createDataFrame(df.dtypes, f"column string, {name} string")
        for df, name in ((old, "old_dtype"), (new, "new_dtype"))
    ]
    joined = reduce(lambda a, b: a.join(b, "column"), frames)
    return joined.withColumn("changed", F.col("old_dtype") != F.col("new_dtype"))


def comparison_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles of both tables as two rows."""
    keep = ["rows", "columns", "date_min", "date_max"]
    sides = [
        table_info(df).select(F.lit(name).alias("dataset"), *keep)
        for name, df in (("old", old), ("new", new))
    ]
    return sides[0].unionByName(sides[1])
