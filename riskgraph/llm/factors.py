"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector of three groups, each of length one: hashed lower-case words weighted by
``log(1 + count)``, structure statistics (shares of symbols, capitals, digits, repeated words and
lines and so on) cut into bins, and the stated number of characters as metadata. The machine
adds a linear weight per feature and, for every pair of features, the product of their factor
vectors. The pairs are never visited: for each factor their sum is half the square of the sum
less the sum of the squares, so a score costs one pass over a document's features.

Spark fits the machine on a bounded hash sample of labelled rows outside the held-out fold.
Labels are read for fitting only; language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import Words, chunks, saved, with_ids

FOLDS, HELD_OUT = 5, 0
# The machine is fitted on a hash sample of about so many labelled rows.
TRAIN_ROWS = 20_000
WORD_SLOTS = 1 << 11
FACTORS = 4
# Each step looks at this share of the sample.
STEPS, STEP_SIZE, STEP_SHARE, RIDGE, SEED = 80, 0.1, 0.25, 1e-5, 7
# From this score on a document counts as good.
GOOD = 0.3
BINS = 24

_CLASSES = {
    "symbols": b"#*$%&|<>", "marks": b"!?", "stops": b".,;:", "digits": b"0123456789",
    "capitals": bytes(range(65, 91)), "letters": bytes([*range(65, 91), *range(97, 123)]),
    "wide": bytes(range(128, 256)),
}
STATISTICS = (
    *_CLASSES, "word bytes", "words", "words per line", "short words", "stuttered words",
    "distinct words", "repeated triples", "repeated lines",
)
_META = len(STATISTICS) * BINS
DIMENSION = WORD_SLOTS + _META + BINS


@dataclass
class Features:
    """Sparse rows of one chunk: bounds per row, feature numbers and values."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each row."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=n)


def _repeated(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Number of entries of each row whose key the row holds at least twice."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    same = (r[1:] == r[:-1]) & (k[1:] == k[:-1])
    inside = np.zeros(len(r), dtype=bool)
    inside[1:] |= same
    inside[:-1] |= same
    return np.bincount(r[inside], minlength=n)


def statistics(words: Words) -> np.ndarray:
    """Structure statistics (row, statistic) of a chunk, each between 0 and 1; 0 without words."""
    n = len(words.first) - 1
    counts = np.diff(words.first)
    rows = words.rows()
    some = np.maximum(counts, 1)
    out = np.zeros((n, len(STATISTICS)))
    sizes = words.ends - words.starts
    held = np.bincount(rows, weights=sizes, minlength=n)
    filled = np.flatnonzero(counts)
    low, high = words.starts[words.first[filled]], words.ends[words.first[filled + 1] - 1]

    def within(mark: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mark)])
        found = np.zeros(n)
        found[filled] = run[high] - run[low]
        return found

    for j, members in enumerate(_CLASSES.values()):
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        out[:, j] = within(table[words.data]) / np.maximum(held, 1)
    j = len(_CLASSES)
    breaks = words.data == 10
    lines = within(breaks) + (counts > 0)
    out[:, j] = np.minimum(held / some / 32, 1)
    out[:, j + 1] = np.minimum(np.log2(1 + counts) / 20, 1)
    out[:, j + 2] = np.minimum(np.log2(1 + counts / np.maximum(lines, 1)) / 12, 1)
    out[:, j + 3] = np.bincount(rows[sizes <= 2], minlength=n) / some
    h = words.hashes
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    out[:, j + 4] = np.bincount(rows[again], minlength=n) / some
    out[:, j + 5] = _distinct(rows, h, n) / some
    if len(h) > 2:
        triple = h[:-2] + h[1:-1] * np.uint64(3) + h[2:] * np.uint64(9)
        inside = rows[:-2] == rows[2:]
        out[:, j + 6] = _repeated(rows[:-2][inside], triple[inside], n) / some
    if len(h):
        # A line is the sum of its words' hashes, each shifted by its place in the line.
        line = np.concatenate([[0], np.cumsum(breaks)])[words.starts]
        begins = np.ones(len(h), dtype=bool)
        begins[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(begins)
        place = (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(np.uint64)
        sums = np.add.reduceat(h * (place * np.uint64(2) + np.uint64(1)), first)
        owners = rows[first]
        full = np.bincount(owners, minlength=n)
        out[:, j + 7] = (full - _distinct(owners, sums, n)) / np.maximum(full, 1)
    return out


def features(words: Words, n_chars: np.ndarray) -> Features:
    """Features of a chunk; ``n_chars`` is the stated number of characters, negative if missing."""
    n = len(words.first) - 1
    slot = words.rows() * WORD_SLOTS + (words.hashes % np.uint64(WORD_SLOTS)).astype(np.int64)
    slot, times = np.unique(slot, return_counts=True)
    owner, weight = slot // WORD_SLOTS, np.log1p(times)
    length = np.sqrt(np.bincount(owner, weights=weight**2, minlength=n))
    # Square roots widen the bins of small shares.
    bins = np.minimum((np.sqrt(np.clip(statistics(words), 0, 1)) * (BINS - 1)).round(), BINS - 1)
    bins = bins.astype(np.int64) + np.arange(len(STATISTICS)) * BINS + WORD_SLOTS
    stated = np.where(n_chars < 0, 0, 1 + np.minimum(np.log2(1 + np.maximum(n_chars, 0)), BINS - 2))
    meta = (WORD_SLOTS + _META + stated.astype(np.int64))[:, None]
    index = [slot % WORD_SLOTS, bins.ravel(), meta.ravel()]
    value = [
        weight / length[owner], np.full(bins.size, len(STATISTICS) ** -0.5), np.ones(n),
    ]
    row = [owner, np.repeat(np.arange(n), len(STATISTICS)), np.arange(n)]
    row, index, value = map(np.concatenate, (row, index, value))
    order = np.lexsort((index, row))
    return Features(np.searchsorted(row[order], np.arange(n + 1)), index[order], value[order])


@dataclass
class Machine:
    """Bias, linear weights and factors (feature, factor)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, x: Features) -> np.ndarray:
        """Probability of label 1 for every row, in time linear in its features."""
        n = len(x.bounds) - 1
        rows = np.repeat(np.arange(n), np.diff(x.bounds))
        z = self.bias + np.bincount(rows, weights=self.linear[x.index] * x.value, minlength=n)
        for column in self.factors.T:
            part = column[x.index] * x.value
            total = np.bincount(rows, weights=part, minlength=n)
            z += (total**2 - np.bincount(rows, weights=part**2, minlength=n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(docs: DataFrame) -> DataFrame:
    """``text`` and ``n_chars`` as a number, -1 where it is missing, negative or no such column exists."""
    stated = F.lit(-1).cast("long")
    if "n_chars" in docs.columns:
        stated = F.coalesce(F.greatest(F.col("n_chars").cast("long"), stated), stated)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", stated.alias("_stated"))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Features]]:
    stated = batch["_stated"].to_numpy(zero_copy_only=False)
    # Case is one of the statistics, so words are lowered after those are taken.
    for plain, words in zip(chunks(batch["text"]), chunks(batch["text"], lower=True)):
        n = len(words.first) - 1
        plain_words = Words(plain.row, plain.data, plain.starts, plain.ends, plain.first, words.hashes)
        yield words.row, n, features(plain_words, stated[words.row : words.row + n])


def _fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """Features and ``label`` of labelled rows outside the held-out fold, thinned by a hash of the id.

    Of several labels of an id the larger one holds.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter("label in (0, 1) and doc_id is not null").filter(_fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    count = known.count()
    if count > limit:
        share = int(limit / count * 1_000_000)
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    known = saved(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, x in _parts(batch):
                bounds = pa.array(x.bounds, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(at, n),
                        pa.ListArray.from_arrays(bounds, pa.array(x.index, pa.int32())),
                        pa.ListArray.from_arrays(bounds, pa.array(x.value, pa.float64())),
                    ],
                    names=["doc_id", "i", "v"],
                )

    texts = with_ids(_rows(docs), known.select("doc_id"), known=min(count, limit))
    found = texts.mapInArrow(run, "doc_id long, i array<int>, v array<double>")
    return saved(found.join(known, "doc_id").select(F.col("label").cast("double"), "i", "v"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Machine:
    """Fit the machine on at most about ``limit`` labelled rows.

    Without labels of both kinds it gives every text the share of good labels, 0.5 without any.
    """
    rows = training_rows(docs, labels, limit)
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        share = next(iter(seen), 0.5)
        return Machine(60.0 * (share - 0.5), np.zeros(DIMENSION), np.zeros((DIMENSION, FACTORS)))
    sparse = F.udf(lambda i, v: Vectors.sparse(DIMENSION, i, v), VectorUDT())
    data = rows.select("label", sparse("i", "v").alias("x")).persist()
    machine = FMClassifier(
        featuresCol="x", labelCol="label", factorSize=FACTORS, maxIter=STEPS, stepSize=STEP_SIZE,
        regParam=RIDGE, seed=SEED, solver="adamW", tol=0.0,
        miniBatchFraction=STEP_SHARE,
    ).fit(data)
    data.unpersist()
    return Machine(machine.intercept, machine.linear.toArray(), machine.factors.toArray())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have no words and zero statistics. ``n_chars`` is used where there is
    such a column; a null or negative one counts as missing. Repeated rows get equal scores;
    the fold of a null id is that of the empty string. Texts may be of any length; an empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, x in _parts(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, n), pa.array(shared.value.score(x))],
                    names=["doc_id", "score"],
                )

    scored = _rows(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (_fold() == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
