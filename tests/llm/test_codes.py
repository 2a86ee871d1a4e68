"""Ball k-means codes against a full search in plain Python, and on awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.errors import PythonException
from pyspark.sql import types as T

from riskgraph.llm import catalog, codes

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        # Clashing names.
        T.StructField("_vector", T.LongType()), T.StructField("_codes", T.StringType()),
    ]
)


def expected(rows, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    kept = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    size = len(kept[0][1]) // 16
    cut = [(i, [v[p * size : (p + 1) * size] for p in range(16)], label) for i, v, label in kept]
    books = [[parts[p] for _, parts, _ in cut[:entries]] for p in range(16)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            members = [[] for _ in books[p]]
            for _, parts, _ in cut:
                members[nearest(parts[p], books[p])[1]].append(parts[p])
            books[p] = [
                [sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(members, books[p])
            ]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, totals = [], {}
    for i, parts, label in cut:
        best = [nearest(parts[p], books[p]) for p in range(16)]
        error = sum(d for d, _ in best)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in best), error, label))
    return sorted([(i, c, e, totals[label], digest) for i, c, e, label in out], key=str)


def found(df):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


def random_rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(k, rng.normal(size=dim).astype(np.float32).tolist(), int(rng.integers(3))) for k in range(n)]


@pytest.mark.parametrize("seed", range(10))
def test_balls_equal_a_full_search(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-30, 30, size=(16, 3))
    entries[5] = entries[2]  # equal entries: the first one is used
    points = rng.integers(-40, 40, size=(3000, 3))
    points[:200] = entries[7]
    before, least = codes.assign_all(points, entries)
    moved = entries + rng.integers(-4, 5, size=entries.shape)
    radii = np.zeros(len(entries), dtype=np.int64)
    for e in range(len(entries)):
        if (before == e).any():
            shift = int(((moved[e] - entries[e]) ** 2).sum())
            radii[e] = (math.isqrt(int(least[before == e].max())) + 1 + math.isqrt(shift) + 1) ** 2
    index, distance = codes.assign_balls(points, moved, radii, before)
    whole = codes.assign_all(points, moved)
    assert (index == whole[0]).all() and (distance == whole[1]).all()


@pytest.mark.parametrize("n,dim", [(300, 32), (40, 16), (1, 64)])
def test_codes_equal_plain_python(spark, n, dim):
    rows = random_rows(n, dim, n)
    frame = spark.createDataFrame([(*r, None, "c") for r in rows], VECTORS).repartition(5)
    assert found(codes.codes_with_label_errors(frame)) == expected(rows)


def test_awkward_rows(spark):
    base = random_rows(150, 32, 9)
    same = base[3][1]
    rows = [
        *base, (200, None, 1), (201, [None] + same[1:], 1), (202, [math.nan] + same[1:], 1),
        (203, same[:-1] + [-math.inf], 1), (None, same, None), (None, base[4][1], 2), (7, base[7][1], None),
        *[(300 + k, same, None) for k in range(40)],
    ]
    frame = spark.createDataFrame([(*r, 1, None) for r in rows], VECTORS)
    # A row of another length is dropped.
    more = spark.createDataFrame([(400, [1.0, 2.0], 1, 1, None)], VECTORS)
    assert found(codes.codes_with_label_errors(frame.unionByName(more))) == expected(rows)
    assert codes.codes_with_label_errors(frame.limit(0)).count() == 0
    assert codes.codes_with_label_errors(frame.filter("vec_id between 200 and 203")).count() == 0


def test_odd_lengths_and_huge_components_are_refused(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, None)], VECTORS))
    huge = spark.createDataFrame([(1, [1e9] + [0.0] * 15, 1, 1, None)], VECTORS)
    with pytest.raises(PythonException, match="not supported"):
        codes.compress(huge)


def test_query_equals_plain_python_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(catalog.QUERIES["op12_vector_codes"](spark, SF)) == expected(rows)
