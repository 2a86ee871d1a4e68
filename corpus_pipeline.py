"""Corpus pipeline: quality rules, near duplicates, decontamination, personal data, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import bpe, decontaminate, jaccard, pii, quality
from riskgraph.llm.common import BROADCAST_IDS, saved, shared_path, table, unwrapped, wrapped

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _identity(*columns: str) -> Column:
    """A row's identity: rows of one id with different texts are judged one by one."""
    return F.xxhash64("doc_id", "text", *columns)


def _without(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose identity is not among those of the one-column frame ``rows``."""
    rows = saved(rows.distinct())
    dropped = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    plain = wrapped(docs, "doc_id", "text", *columns).withColumn("_identity", _identity(*columns))
    return unwrapped(plain.join(dropped, "_identity", "left_anti"), docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the certified rules; repeated rows share their fate.

    Texts are measured once; their counts are saved and judged.
    """
    plain = wrapped(docs, "doc_id", "text", "lang").drop("row")
    counted = quality.with_stats(plain.withColumn("_identity", _identity("lang"))).drop("text")
    judged = quality.judge_measured(saved(counted), table(spark, sf_dir, "labels"))
    return _without(docs, judged.filter("not _quality.kept").select("_identity"), "lang")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: that of the smallest id, then of the least text hash.

    Of rows that repeat its id and text one stays. Rows without an id, or without shingles, are
    no copies and stay.
    """
    tagged = docs.select("doc_id", "text", _identity().alias("tag"))
    groups = saved(jaccard.tagged_duplicates(tagged).filter("doc_id is not null and n_shingles > 0"))
    rows = groups.groupBy("root", "doc_id", "tag").agg(F.count(F.lit(1)).alias("rows"))
    first = groups.groupBy("root").agg(
        F.min(F.struct("doc_id", "tag")).alias("first"), F.count(F.lit(1)).alias("total")
    )
    several = saved(rows.join(first.filter("total > 1").drop("total"), "root"))
    stays = F.expr("doc_id = first.doc_id and tag = first.tag")
    kept = _without(docs, several.filter(~stays).select(F.col("tag").alias("_identity")))
    repeated = saved(several.filter(stays & (F.col("rows") > 1)).select(F.col("tag").alias("_identity")))
    if not repeated.head(1):
        return kept
    small = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    plain = wrapped(kept, "doc_id", "text").withColumn("_identity", _identity())
    # Partial aggregates reduce the copies of a row before they are shuffled.
    again = plain.join(small, "_identity", "left_semi").groupBy("_identity").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "text", "row")]
    )
    single = plain.join(small, "_identity", "left_anti")
    return unwrapped(single, docs.columns).unionByName(unwrapped(again, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, with or without an id."""
    rows = docs.select(_identity().alias("doc_id"), "text")
    hits = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.select(F.col("doc_id").alias("_identity")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    found = pii.find(wrapped(docs, "text", "n_chars"), pii.train(docs.select("text")))
    clean = F.col("_redacted")
    counted = F.length(clean).cast(found.schema["n_chars"].dataType)
    changed = found.withColumns(
        {"text": clean, "n_chars": F.when(F.size("_spans") > 0, counted).otherwise(F.col("n_chars"))}
    )
    return unwrapped(changed, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and digests of ids and decoded bytes."""
    texts = docs.select("doc_id", "text")
    return bpe.token_digests(bpe.round_trip(texts, RANK_FILE, public_tokenizers.PATTERN))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]

# Certified cutoffs, edit distance, personal data and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
