"""Reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import hash_text

PREFIX = 4


def keyed_sample(df: DataFrame, keys: Sequence[str], m: int, seed: int = 42) -> DataFrame:
    """``m`` rows without replacement: the first in the md5 order of their key.

    A count per hash prefix finds the prefix that covers ``m`` rows, so the final sort
    meets little more than the sample itself.
    """
    hashed = df.withColumn("_hash", hash_text(keys, seed))
    prefix = F.substring("_hash", 1, PREFIX)
    upto = F.sum("count").over(Window.orderBy("prefix"))
    cutoff = (
        hashed.groupBy(prefix.alias("prefix"))
        .count()
        .withColumn("upto", upto)
        .filter(F.col("upto") >= m)
        .agg(F.min("prefix"))
        .first()[0]
    )
    kept = hashed if cutoff is None else hashed.filter(prefix <= cutoff)
    return kept.orderBy("_hash", *keys).limit(m).drop("_hash")
