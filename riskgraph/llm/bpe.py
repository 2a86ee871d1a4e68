"""Byte-level BPE: texts to rank ids and back to raw bytes, with a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskgraph.llm.common import released

# Rank files up to this size are sent to the executors.
MAX_RANK_BYTES = 64 << 20
# Longer texts are encoded in blocks of about so many characters.
BLOCK_CHARS = 1 << 16
# Runs of white space from this length on are merged without the pattern: its look-ahead would
# need a stack as deep as the run.
LONG_RUN = 1 << 12

# White space of the pattern (fixed by Unicode; Python's \s also takes the separators 0x1C to 0x1F).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# No match holds a character followed by white space unless it is white space itself, nor a
# letter next to a number, nor a letter or number next to punctuation or a symbol, except for
# an apostrophe before a letter. A text may be cut there without moving any match.
_CUT = regex.compile(
    rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=\p{{L}})(?=[\p{{N}}\p{{P}}\p{{S}}])"
    r"|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])|(?<=[\p{P}\p{S}--'])(?=[\p{L}\p{N}])",
    regex.V1,
)

_CODECS: dict[str, tiktoken.Encoding] = {}


def _codec(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _CODECS:
        table = {
            base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in ranks.splitlines() if line.strip())
        }
        _CODECS[key] = tiktoken.Encoding(
            "local", pat_str=pattern, mergeable_ranks=table, special_tokens={}
        )
    return _CODECS[key]


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Parts of a text whose ids, joined, are the ids of the text.

    A part is longer than two sizes only where one match or run of white space is.
    """
    at = 0
    while len(text) - at > 2 * size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def parts(text: str, size: int = BLOCK_CHARS, run: int = LONG_RUN) -> Iterator[tuple[str, bool]]:
    """Parts as of ``blocks``, and whether a part is one match by itself.

    A run of white space is one match, without its last character where a text follows: that one
    belongs to what follows. Runs of at least ``run`` characters are handed over as such matches.
    """
    at = 0
    for found in regex.finditer(rf"[{_SPACE}]{{{max(run, 2)},}}", text):
        if found.start() > at:
            yield from ((part, False) for part in blocks(text[at : found.start()], size))
        at = found.end() if found.end() == len(text) else found.end() - 1
        yield text[found.start() : at], True
    if at < len(text):
        yield from ((part, False) for part in blocks(text[at:], size))


def encode_text(codec: tiktoken.Encoding, text: str) -> np.ndarray:
    if len(text) <= 2 * BLOCK_CHARS:
        return codec.encode_to_numpy(text, disallowed_special=())
    ids = [
        np.array(codec._encode_single_piece(part), dtype=np.uint32)
        if whole
        else codec.encode_to_numpy(part, disallowed_special=())
        for part, whole in parts(text)
    ]
    return np.concatenate(ids)


def _rank_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        ranks = file.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return ranks


def encode(
    df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """Add the array of rank ids of a text column.

    A null text counts as empty and gives an empty array. Every match of ``pattern`` is merged
    separately; strings that look like special tokens are ordinary text. Texts of any length are
    taken: long ones are cut at places where no match can cross, and long runs of white space are
    merged as the one match that they are; ``pattern`` must match words, numbers, other characters
    and white space in such runs. Repeated rows are encoded like all others. An existing column
    named ``ids`` is replaced. The rank file (at most 64 MiB) is read by the driver and sent to the
    executors.
    """
    return _coded(df, rank_file, pattern, text, ids, None)


def round_trip(
    df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: the ids go to one Python task only."""
    return _coded(df, rank_file, pattern, text, ids, decoded)


def _coded(df: DataFrame, rank_file: str, pattern: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(_rank_bytes(rank_file))
    kept = [c for c in df.columns if c not in (ids, decoded)]
    schema = T.StructType([df.schema[c] for c in kept]).add(ids, T.ArrayType(T.IntegerType(), False))
    schema = schema.add(decoded, T.BinaryType()) if decoded else schema
    item = pa.list_(pa.field("element", pa.int32(), nullable=False))
    arrow = _with(to_arrow_schema(schema), ids, item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, text):
                arrays = [encode_text(codec, t or "") for t in part[text].to_pylist()]
                ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                flat = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), type=item)]
                if decoded:
                    columns.append(pa.array([_bytes(codec, x.tolist()) for x in arrays], type=pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *columns], schema=arrow)
        released()

    return df.mapInArrow(run, schema)


def _bytes(codec: tiktoken.Encoding, ids: list[int] | None) -> bytes:
    return codec.decode_bytes(ids) if ids else b""


def decode(
    df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Add the raw bytes that the ids stand for; null ids give empty bytes.

    The bytes need not be valid UTF-8 when the ids are a cut-out of a text. An id outside the
    rank file raises an error.
    """
    shared = df.sparkSession.sparkContext.broadcast(_rank_bytes(rank_file))
    kept = [c for c in df.columns if c != decoded]
    schema = T.StructType([df.schema[c] for c in kept]).add(decoded, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, ids):
                column = pa.array([_bytes(codec, x) for x in part[ids].to_pylist()], type=pa.binary())
                names = [*kept, decoded]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), column], names=names)
        released()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of one column, so long values don't add up."""
    at, total = 0, 0
    for i, size in enumerate(_sizes(batch[column])):
        total += int(size)
        if total >= limit:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _sizes(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    if pa.types.is_list(array.type):
        return pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False) * 4
    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)


def _with(schema: pa.Schema, name: str, kind: pa.DataType) -> pa.Schema:
    return schema.set(schema.get_field_index(name), pa.field(name, kind))


def token_digests(df: DataFrame) -> DataFrame:
    """Count and digests of encoded and decoded documents."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
