"""Vector code compression: product codes whose codebooks are learned by ball k-means.

Vectors are cut into consecutive parts of integers. Every part position has a codebook of at most
64 entries; the parts nearest to an entry form its ball, whose radius is that of its farthest
part. Once parts have an entry, later assignments use the balls:

* only entries at most two radii away are neighbours of an entry; others can't be nearer to any
  part of the ball;
* a part less than half as far from its entry as the nearest neighbour lies in the ball's stable
  core and stays without another distance;
* the rest lies in rings between neighbours sorted by distance: a part meets only the neighbours
  at most twice as far from its entry as itself.

All comparisons are made on squared integers, so results equal those of a full search. A pass over
the rows returns sums, counts and radii of the balls, summed by Spark: a fixed number of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskgraph.llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Components below this keep every squared distance and error inside 64 bits.
LARGEST = 1 << 19
# Distances that are held at once in a task.
STEP_DISTANCES = 1 << 21
# Neighbours by which one ring is wider than the next.
RING = 16


@dataclass
class Codebooks:
    """Integer entries (part, entry, position) and an upper bound of each ball's squared radius."""

    entries: np.ndarray
    radii: np.ndarray | None = None

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``floor(256 x)``, by part."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST} or more are not supported")
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(vectors), PARTS, dim // PARTS)


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to entries, exact in 64-bit integers."""
    out = np.zeros((len(points), len(entries)), dtype=np.int64)
    for column in range(points.shape[1]):
        out += (points[:, column, None] - entries[None, :, column]) ** 2
    return out


def assign_all(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every point and the squared distance; ties go to the lower index."""
    index = np.empty(len(points), dtype=np.int64)
    least = np.empty(len(points), dtype=np.int64)
    step = max(1, STEP_DISTANCES // len(entries))
    for at in range(0, len(points), step):
        squares = _squares(points[at : at + step], entries)
        index[at : at + step] = squares.argmin(axis=1)
        least[at : at + step] = squares.min(axis=1)
    return index, least


def assign_balls(
    points: np.ndarray, entries: np.ndarray, radii: np.ndarray, index: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """As ``assign_all`` for points that lie in the balls ``index`` of the given radii."""
    own = ((points - entries[index]) ** 2).sum(axis=1)
    apart = _squares(entries, entries)
    order = np.argsort(index, kind="stable")
    bounds = np.searchsorted(index[order], np.arange(len(entries) + 1))
    index, least = index.copy(), own.copy()
    for ball in range(len(entries)):
        members = order[bounds[ball] : bounds[ball + 1]]
        near = np.flatnonzero(apart[ball] <= 4 * radii[ball])
        near = near[near != ball]
        if not len(members) or not len(near):
            continue
        near = near[np.lexsort((near, apart[ball, near]))]
        # A part meets the first neighbours up to twice its own distance: none in the stable core.
        ring = np.searchsorted(apart[ball, near], 4 * own[members], side="right")
        # Rings are widened to a few sizes, so that a task makes few small searches.
        ring = np.minimum(-(-ring // RING) * RING, len(near))
        for width in np.unique(ring[ring > 0]).tolist():
            inside = members[ring == width]
            # Ascending entries, its own among them, so that ties go to the lower index.
            few = np.sort(np.append(near[:width], ball))
            found, least[inside] = assign_all(points[inside], entries[few])
            index[inside] = few[found]
    return index, least


def assign(ints: np.ndarray, books: Codebooks, codes: np.ndarray | None = None) -> np.ndarray:
    """Codes (row, part); with earlier codes, from the balls that these form."""
    out = np.empty(ints.shape[:2], np.int64)
    for part in range(ints.shape[1]):
        points, entries = np.ascontiguousarray(ints[:, part]), books.entries[part]
        if codes is None:
            out[:, part], _ = assign_all(points, entries)
        else:
            out[:, part], _ = assign_balls(points, entries, books.radii[part], codes[:, part])
    return out


def distances(ints: np.ndarray, books: Codebooks, codes: np.ndarray) -> np.ndarray:
    """Squared distance of every part (row, part) to its entry."""
    own = books.entries[np.arange(ints.shape[1])[None, :], codes]
    return ((ints - own) ** 2).sum(axis=2)


def _sums(ints: np.ndarray, codes: np.ndarray, least: np.ndarray, entries: int) -> tuple[np.ndarray, ...]:
    """Counts, sums and largest squared distances by (part, entry)."""
    rows, parts, width = ints.shape
    slot = (codes + np.arange(parts) * entries).ravel()
    counts = np.bincount(slot, minlength=parts * entries)
    sums = np.zeros((parts * entries, width), dtype=np.int64)
    np.add.at(sums, slot, ints.reshape(-1, width))
    radii = np.zeros(parts * entries, dtype=np.int64)
    np.maximum.at(radii, slot, least.ravel())
    return counts, sums, radii


_BALLS = "slot int, n long, sums array<long>, radius long"


def _current(batch: pa.RecordBatch, ints: np.ndarray, rounds: list[Codebooks]) -> np.ndarray:
    """Codes of the last round: those of the first one stand in the row, later ones follow by the balls."""
    packed = b"".join(batch["_codes"].to_pylist())
    codes = np.frombuffer(packed, np.uint8).reshape(-1, PARTS).astype(np.int64)
    for books in rounds[1:]:
        codes = assign(ints, books, codes)
    return codes


def _balls(coded: DataFrame, rounds: list[Codebooks], dim: int) -> DataFrame:
    """Partial sums of the balls of the last round, one row per task and used entry."""
    shared = coded.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, total = shared.value, None
        books = rounds[-1]
        for batch in batches:
            ints = integers(batch["_vector"], dim)
            codes = _current(batch, ints, rounds)
            part = _sums(ints, codes, distances(ints, books, codes), books.entries.shape[1])
            total = part if total is None else (
                total[0] + part[0], total[1] + part[1], np.maximum(total[2], part[2])
            )
        if total is not None:
            used = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()), pa.array(total[0][used], pa.int64()),
                    pa.array(total[1][used].tolist(), pa.list_(pa.int64())), pa.array(total[2][used]),
                ],
                names=["slot", "n", "sums", "radius"],
            )

    return coded.select("_vector", "_codes").mapInArrow(run, _BALLS)


def _replaced(balls: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after a round: floored means, and radii that hold around the moved entries."""
    width = books.entries.shape[2]
    rows = balls.groupBy("slot").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"),
        F.max("radius").alias("radius"),
    )
    entries = books.entries.reshape(-1, width).copy()
    radii = np.zeros(len(entries), dtype=np.int64)
    for row in rows.collect():  # at most one row per entry
        slot, old = row["slot"], entries[row["slot"]].copy()
        entries[slot] = [s // row["n"] for s in row["sums"]]
        moved = int(((entries[slot] - old) ** 2).sum())
        radii[slot] = (math.isqrt(row["radius"]) + 1 + math.isqrt(moved) + 1) ** 2
    return Codebooks(entries.reshape(books.entries.shape), radii.reshape(books.entries.shape[:2]))


def _coded(rows: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """The rows with the codes of a full assignment."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*rows.schema.fields, T.StructField("_codes", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = assign(integers(batch["_vector"], dim), shared.value)
            packed = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], schema=arrow)

    return rows.mapInArrow(run, schema)


def kept_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor holds null, NaN or infinite components, as ``_vector``."""
    numbers = F.col(vector).cast("array<double>")
    odd = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col(vector).isNotNull()).filter(~odd).withColumn("_vector", F.col(vector))


def compress(rows: DataFrame) -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, label, code, error`` of every kept row of ``vec_id, embedding, label``, and the codebooks.

    Rows without a vector or with a null, NaN or infinite component are dropped. Codebooks start
    with the kept vectors of the 64 smallest ids (equal ids by vector; null ids come last), fewer
    where there are fewer rows; equal entries are allowed and the first of them is used. The
    first such vector sets the number of components, a multiple of 16; rows of another length are
    dropped. Repeated rows are coded like all others. Components of 2**19 or more raise an error,
    as 64-bit distances could not hold them. An empty table gives no rows. Columns of other names
    are ignored.
    """
    rows = kept_vectors(
        rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    ).drop("embedding")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "_vector").limit(ENTRIES).collect()
    if not first:
        none = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.limit(0), None
    dim = len(first[0]["_vector"])
    if not dim or dim % PARTS:
        raise ValueError(f"vectors of {dim} components can't be cut into {PARTS} equal parts")
    rows = rows.filter(F.size("_vector") == dim)
    start = np.array([r["_vector"] for r in first if len(r["_vector"]) == dim], dtype=np.float64)
    start = np.floor(start * SCALE).astype(np.int64).reshape(len(start), PARTS, dim // PARTS)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))

    # Saved once; writing the rows again after each round would cost more than the balls do.
    coded = saved(_coded(rows, books, dim))
    rounds = [books]
    for _ in range(ROUNDS):
        rounds.append(_replaced(_balls(coded, rounds, dim), rounds[-1]))
    return _finished(coded, rounds, dim), rounds[-1]


_CODED = "vec_id long, label long, code string, error long"


def _finished(coded: DataFrame, rounds: list[Codebooks], dim: int) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = integers(batch["_vector"], dim)
            codes = _current(batch, ints, shared.value)
            error = distances(ints, shared.value[-1], codes).sum(axis=1)
            code = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], code, pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return coded.mapInArrow(run, _CODED)


def codes_with_label_errors(rows: DataFrame) -> DataFrame:
    """Codes and errors, the error of all rows of the same label (nulls together), the codebooks' hash."""
    coded, books = compress(rows)
    coded = saved(coded)
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    return (
        coded.alias("c").join(errors.alias("e"), F.expr("c.label <=> e.label"))
        .select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    )
