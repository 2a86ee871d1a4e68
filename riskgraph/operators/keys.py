"""Row identity, global row numbers and dense node ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import hash_text
from riskgraph.operators.quantiles import cumulative, with_ordered_bucket
from riskgraph.session import checkpointed

COPIES_PER_BLOCK = 100_000
# Hash buckets for ranks: 4,096 up to a few billion rows, a million beyond.
HASH_PREFIX, WIDE_HASH_PREFIX = 3, 5
WIDE_ROWS = 4_000_000_000
# Distinct ids numbered in one task.
SMALL_IDS = 100_000
# Distinct pairs of two columns, by the names of both.
Pairs = Mapping[frozenset[str], DataFrame]


def _row_text(columns: Sequence[str]) -> Column:
    """Text that differs for different rows: every value goes behind its length."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(
        *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    )


def with_txn_key(df: DataFrame, name: str = "txn_key") -> DataFrame:
    """Add a reproducible unique key built from the row's own values.

    Copies of one row are first collapsed to a count and then laid out again in blocks, so
    a row repeated billions of times never sits in one task.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    last_block = F.floor((F.col("_copies") - 1) / F.lit(COPIES_PER_BLOCK)).cast("long")
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    spread = blocks.filter("_copies > %d" % COPIES_PER_BLOCK).repartition("_block", *columns[:1])
    # Rows with few copies stay where the aggregation left them.
    laid_out = blocks.filter("_copies <= %d" % COPIES_PER_BLOCK).unionByName(spread)
    first = F.col("_block") * COPIES_PER_BLOCK
    last = F.least(first + COPIES_PER_BLOCK, F.col("_copies")) - 1
    return (
        laid_out.withColumn("_copy", F.explode(F.sequence(first, last)))
        .withColumn(name, F.concat_ws("-", F.md5(_row_text(columns)), F.col("_copy")))
        .select(name, *columns)
    )


def with_row_key(
    df: DataFrame, key_columns: Sequence[str] | None = None, name: str = "txn_key"
) -> DataFrame:
    """Key from identifying columns, a narrow step; from the whole row when none are named."""
    if name in df.columns:
        return df
    if not key_columns:
        return with_txn_key(df, name)
    return df.withColumn(name, F.md5(_row_text(key_columns)))


def global_row_number(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    name: str = "rn",
    within: Sequence[str] = (),
) -> DataFrame:
    """0-based row number in a global order, without a one-partition window."""
    numbered = cumulative(df.withColumn("_one", F.lit(1)), order, bucket, {name: "_one"}, within)
    return numbered.withColumn(name, F.col(name) - 1).drop("_one")


def shuffled_row_number(
    df: DataFrame,
    keys: Sequence[str],
    seed: int = 42,
    name: str = "rn",
    within: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """0-based position of every row in the md5 order of its key.

    ``rows`` is the row count when the caller knows it; it sets the number of buckets.
    """
    rows = df.count() if rows is None else rows
    hashed = df.withColumn("_hash", hash_text(keys, seed))
    prefix = F.substring("_hash", 1, HASH_PREFIX if rows < WIDE_ROWS else WIDE_HASH_PREFIX)
    order = [F.col("_hash"), *map(F.col, keys)]
    return global_row_number(hashed, order, prefix, name, within).drop("_hash")


def dense_ids(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """``key -> 0..n-1`` over the distinct values, in the order of the key."""
    # Cut points, bucket totals and numbers all read the values, so these are written once.
    distinct = checkpointed(df.select(key).filter(F.col(key).isNotNull()).distinct())
    count, placed = with_ordered_bucket(distinct, key, SMALL_IDS)
    if count <= SMALL_IDS:
        numbered = distinct.withColumn(name, F.row_number().over(Window.orderBy(key)) - 1)
    else:
        numbered = global_row_number(placed, [F.col(key)], F.col("_ordered"), name)
    return numbered.select(key, F.col(name).cast("long").alias(name))


def with_distinct_counts(
    grouped: DataFrame,
    df: DataFrame,
    key: str,
    counted: Mapping[str, str],
    nulls: bool = False,
    pairs: Pairs | None = None,
) -> DataFrame:
    """Add how many distinct values columns of ``df`` take per key.

    Pairs of key and value are shuffled alone; distinct counts among other aggregates would
    send the buffers of all of them with every pair. ``nulls`` says that the key may be null.
    ``pairs`` are the distinct pairs of ``df`` where they are known already.
    """
    same = F.col(key).eqNullSafe(F.col("_key")) if nulls else F.col(key) == F.col("_key")
    for name, column in counted.items():
        source = df if pairs is None else pairs[frozenset((key, column))]
        distinct = source.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
        if pairs is None:
            distinct = distinct.distinct()
        counts = distinct.groupBy("_key").agg(F.count("_value").alias(name))
        grouped = grouped.join(counts, same, "left").drop("_key")
    return grouped


def lookup_ids(
    df: DataFrame, id_map: DataFrame, key: str, name: str, default: int = 0
) -> DataFrame:
    """Attach node ids; unknown keys get ``default`` and ``is_known_<key>`` = 0."""
    known = id_map.select(F.col(key).alias("_key"), F.col(id_map.columns[-1]).alias("_idx"))
    joined = df.join(known, df[key] == F.col("_key"), "left")
    return joined.withColumns(
        {
            name: F.coalesce(F.col("_idx"), F.lit(default)).cast("long"),
            f"is_known_{key}": F.col("_idx").isNotNull().cast("int"),
        }
    ).drop("_key", "_idx")
