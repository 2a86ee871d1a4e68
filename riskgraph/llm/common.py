"""Helpers shared by the corpus operators: saved tables, id filters, words and their hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.session import ensure_checkpoint_dir

# Word separators: space and the five control characters 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
# At most so many 8-byte ids are sent to every executor.
BROADCAST_IDS = 1_000_000
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: lineage ends here."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id", known: int | None = None) -> DataFrame:
    """Rows of ``df`` whose key is in the distinct one-column frame ``ids``.

    The ids are broadcast up to ``BROADCAST_IDS`` of them (their number is counted first);
    beyond that both sides are shuffled.
    """
    count = ids.count() if known is None else known
    small = F.broadcast(ids) if count <= BROADCAST_IDS else ids
    return df.join(small, key, "left_semi")


def wrapped(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, null strings where missing, and all others inside the column ``row``.

    Whatever the others are called, they cannot clash with columns that an operator adds.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in named]
    own = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in named]
    return docs.select(*own, F.struct(*(rest or [F.lit(0).alias("_")])).alias("row"))


def unwrapped(df: DataFrame, columns: list[str], *named: str) -> DataFrame:
    """The columns of the table that ``wrapped`` took, then the named ones of ``df``."""
    inner = df.schema["row"].dataType.names
    kept = [F.col(f"row.`{c}`").alias(c) if c in inner else F.col(c) for c in columns]
    return df.select(*kept, *named)


def released() -> None:
    """Hand freed Arrow memory back at the end of a task, so that waiting Python workers hold little."""
    pa.default_memory_pool().release_unused()


def pack_rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SEGMENT = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(_BASE, _SEGMENT)
_INV = _powers(pow(_BASE, -1, 1 << 64), _SEGMENT)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows: byte bounds in ``data``, hashes, and bounds per row."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # word bounds of the rows, one more than rows
    hashes: np.ndarray

    def rows(self) -> np.ndarray:
        """Row (within the chunk) of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word, taken from running sums over the bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = int(np.searchsorted(ends, base + _SEGMENT, side="right"))
        if stop <= at:  # one word longer than a segment
            word, h = data[base : ends[at]], 0
            for i in range(0, len(word), _SEGMENT):
                part = word[i : i + _SEGMENT].astype(np.uint64) + np.uint64(1)
                h += int((part * _POW[: len(part)]).sum()) * pow(_BASE, i, 1 << 64)
            out[at] = h & _MASK
            at += 1
            continue
        part = data[base : ends[stop - 1]].astype(np.uint64) + np.uint64(1)
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _POW[: len(part)], out=run[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (run[e] - run[s]) * _INV[s]
        at = stop
    return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


_TABLES = [_POW, _INV]


def stretch_hashes(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the words ``first`` to ``first + size - 1`` for every stretch, from running sums."""
    if len(hashes) > len(_TABLES[0]):
        _TABLES[0] = _powers(_BASE, 2 * len(hashes))
        _TABLES[1] = _powers(pow(_BASE, -1, 1 << 64), 2 * len(hashes))
    run = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _TABLES[0][: len(hashes)], out=run[1:])
    return mix((run[first + size] - run[first]) * _TABLES[1][first] + size.astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; entry i covers words i to i + n - 1.

    Built by doubling, so a long window costs the logarithm of its length.
    """
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    base = 0xD6E8FEB86659FD93 | 1
    power, width, done = hashes, 1, None
    covered, rest = 0, n
    while rest:
        if rest & 1:
            if done is None:
                done, covered = power, width
            else:
                m = min(len(done), len(power) - covered)
                factor = np.uint64(pow(base, covered, 1 << 64))
                done = done[:m] + power[covered : covered + m] * factor
                covered += width
        rest >>= 1
        if rest:
            power = power[:-width] + power[width:] * np.uint64(pow(base, width, 1 << 64))
            width *= 2
    return mix(done[: len(hashes) - n + 1])


def chunks(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Words of a string column, in chunks of whole rows of about ``CHUNK_BYTES``."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, at + 1), len(texts))
        part = whole[offsets[at] : offsets[stop]]
        bounds = offsets[at : stop + 1] - offsets[at]
        inside = ~_IS_SPACE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        begins[cuts] |= inside[cuts]
        closes[cuts - 1] |= inside[cuts - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        if lower:
            part = _LOWER[part]
        yield Words(
            at, part, starts, ends, np.searchsorted(starts, bounds), _hash_words(part, starts, ends)
        )
        at = stop
