"""Queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.llm import (
    bpe, chat, codes, decontaminate, factors, jaccard, pii, quality, sharding, substring, toxicity, turns, warc,
)
from riskgraph.llm.common import saved, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_digests(bpe.round_trip(docs, RANK_FILE, public_tokenizers.PATTERN))


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema
    )
    return chat.read_back(chat.format_chats(turns.unionByName(more)))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = saved(quality.with_stats(docs).drop("text"))
    judged = quality.judge_measured(measured, table(spark, sf_dir, "labels"))
    names = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    ]
    return judged.select("doc_id", *[F.col(f"_quality.{n}").alias(n) for n in names])


@query
def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), sharding.SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# sha256 over role, newline, text, newline of every turn; one control string escaped adds one
# character to the 19 of the template.
ORACLES["op3_chat_format"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(t, r)
), sized as (
  select *, len(regexp_extract_all(role || chr(10) || text, '<\\*/?s>|\[\\*/?INST\]')) as escapes
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
         as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, ''
              order by turn, role, text), '')) as loss_sha256,
       cast(sum(length(role) + length(text) + escapes + 20) as bigint) as formatted_chars
from sized group by conv_id
"""

ORACLES["op5_warc"] = """
with p as (
  select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as digest,
         strlen(coalesce(html, '')) as bytes from pages
), k as (
  select digest, min(page_id) as kept, count(*) as copies from p where bytes >= 100 group by digest
)
select page_id, cast(bytes as bigint) as payload_bytes, p.digest as payload_digest,
       case when copies > 1 and page_id <> kept then 'revisit' else 'response' end as record_type,
       case when copies > 1 and page_id <> kept then kept end as refers_to
from p left join k on p.digest = k.digest
"""


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op6_ngram_jaccard"] = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(lower_az, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz') as lower_az from documents)
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
         else list_distinct(list_transform(range(1, len(ws) - 3),
              lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w
), e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as c
  from e x join e y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id
), l as (select a, b from p where 100 * c >= 80 * (n + m - c)),
both_ways as (select a, b from l union all select b, a from l),
reach as (
  select doc_id as a, doc_id as b from s
  union
  select r.a, l.b from reach r join both_ways l on r.b = l.a
)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, m.component_id
from s join (select a, min(b) as component_id from reach group by a) m on m.a = s.doc_id
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLES["op2_substring_dedup"] = r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') as ws from documents
), p as (
  select doc_id, unnest(range(1, len(ws) - 48)) as i, ws from w where len(ws) >= 50
), h as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from p),
f as (select h, min(doc_id) as first from h group by h),
r as (
  select doc_id, unnest(range(i, i + 50)) as j from h join f using (h) where first < doc_id
), g as (select distinct doc_id, j from r),
words as (select doc_id, generate_subscripts(ws, 1) as j, unnest(ws) as word from w where len(ws) > 0),
k as (
  select doc_id, count(g.j) as n_removed,
         string_agg(case when g.j is null then word end, ' ' order by j) as kept
  from words left join g using (doc_id, j) group by doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id)
"""


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["kind"].isin(*pii.KINDS))

    def count(kind: str):
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")

    def text(spans):
        return F.concat_ws(
            ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        )

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("_spans")).alias("spans"),
    )


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(table(spark, sf_dir, "conversations"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes_with_label_errors(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int) -> str:
    """Kept vectors cut into integer parts, full searches for the nearest entry, floored means."""
    with_parts = """
with kept as (
  select vec_id, label, embedding from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
  select vec_id, label, p as part,
         list_transform(embedding[p * (len(embedding) // 16) + 1 : (p + 1) * (len(embedding) // 16)],
                        lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from kept, range(16) r(p)
), b0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, v from parts
  where vec_id in (select vec_id from kept order by vec_id limit 64)
)"""
    one_round = """, a{0} as (
  select vec_id, any_value(label) as label, x.part,
         min((list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))),
              entry)) as best, any_value(x.v) as v
  from parts x join b{0} b on x.part = b.part group by vec_id, x.part
)"""
    replaced = """, b{1} as (
  select b.part, b.entry, coalesce(m.v, b.v) as v from b{0} b left join (
    select part, entry, list(cast(floor(s / n) as bigint) order by i) as v from (
      select part, best[2] as entry, i, sum(v[i]) as s, count(*) as n
      from (select part, best, v, unnest(range(1, len(v) + 1)) as i from a{0}) group by all
    ) group by part, entry
  ) m on m.part = b.part and m.entry = b.entry
)"""
    text = with_parts
    for k in range(rounds):
        text += one_round.format(k) + replaced.format(k, k + 1)
    return text + one_round.format(rounds) + f""", c as (
  select vec_id, any_value(label) as label, string_agg(printf('%02x', best[2]), '' order by part) as code,
         cast(sum(best[1]) as bigint) as error from a{rounds} group by vec_id
), d as (
  select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as codebooks_sha256
  from b{rounds}
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       codebooks_sha256 from c, d
"""


ORACLES["op12_vector_codes"] = _codes_sql(codes.ROUNDS)


@query
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return factors.score(docs, factors.fit(docs, table(spark, sf_dir, "labels")))
