"""Quality classifier: the machine against its definition, statistics by plain Python, held-out rows."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from llm.conftest import corpus
from riskgraph.llm import catalog, factors
from riskgraph.llm.common import chunks

SPACES = " \t\n\x0b\x0c\r"
LARGER = "/root/testdata/sf0.1"


def table(spark, name, folder=SF):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def machine(seed=1):
    rng = np.random.default_rng(seed)
    d = factors.DIMENSION
    return factors.Machine(0.3, rng.normal(size=d) / 5, rng.normal(size=(d, factors.FACTORS)) / 3)


def rows_of(text, stated=-1):
    words = next(chunks(pa.array([text])))
    return factors.features(words, np.array([stated]))


@pytest.mark.parametrize("text", ["", "a", "The cat | sat ### on\nthe mat the mat\nthe cat", "x " * 300])
def test_score_is_the_sum_over_all_pairs(text):
    m, x = machine(), rows_of(text, 12)
    entries = list(zip(x.index.tolist(), x.value.tolist()))
    z = m.bias + sum(m.linear[i] * v for i, v in entries)
    z += sum(m.factors[i] @ m.factors[j] * v * w for (i, v), (j, w) in itertools.combinations(entries, 2))
    assert m.score(x)[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9)
    assert len(set(x.index.tolist())) == len(x.index) and x.index.max() < factors.DIMENSION


def plain_statistics(text):
    words = [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]
    n, held = len(words), "".join(words).encode()
    if not n:
        return [0.0] * len(factors.STATISTICS)
    shares = [sum(b in members for b in held) / len(held) for members in factors._CLASSES.values()]
    lines = [tuple(x for x in "".join(" " if c in SPACES else c for c in line).split(" ") if x) for line in text.split("\n")]
    lines = [line for line in lines if line]
    inner = text.strip(SPACES).count("\n") + 1
    triples = list(zip(words, words[1:], words[2:]))
    return [
        *shares, min(len(held) / n / 32, 1), math.log2(1 + n) / 20, math.log2(1 + n / inner) / 12,
        sum(len(w.encode()) <= 2 for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(words)) / n, sum(triples.count(t) > 1 for t in triples) / n,
        (len(lines) - len(set(lines))) / len(lines),
    ]


def test_statistics_equal_plain_python():
    texts = ["", " \n ", "one", "a b a b a b\nc", "é! É? $5,00\n\n x x x\n x x x\n", "A|B | c\tc\n", "w " * 50]
    words = next(chunks(pa.array(texts)))
    assert np.allclose(factors.statistics(words), [plain_statistics(t) for t in texts])


def test_a_chunk_scores_like_its_rows():
    texts = [t for _, t, *_ in corpus()]
    m = machine(2)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([7] * len(texts))], names=["text", "_stated"])
    together = np.concatenate([m.score(x) for _, _, x in factors._parts(batch)])
    single = [
        m.score(x)[0]
        for t in texts
        for _, _, x in factors._parts(pa.RecordBatch.from_arrays([pa.array([t], pa.string()), pa.array([7])], names=["text", "_stated"]))
    ]
    assert np.allclose(together, single) and len(together) == len(texts)


def test_awkward_rows_and_labels(spark, docs, empty):
    labels = table(spark, "labels")
    model = factors.fit(table(spark, "documents"), labels)
    rows = factors.score(docs, model).collect()
    assert len(rows) == len(corpus()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 12}) == 1  # repeated rows
    assert factors.score(empty, model).count() == 0
    assert factors.score(docs.drop("n_chars"), model).count() == len(corpus())
    # Labels, language, source and id play no part.
    other = docs.selectExpr("doc_id + 1 as doc_id", "text", "'zz' as lang", "'zz' as source", "n_chars")
    assert sorted(r["score"] for r in rows) == sorted(r["score"] for r in factors.score(other, model).collect())
    none = factors.fit(empty, labels.limit(0))
    assert {r["score"] for r in factors.score(docs, none).collect()} == {0.5}
    one = factors.fit(table(spark, "documents"), labels.filter("quality = 1"))
    assert all(r["predicted"] == 1 for r in factors.score(docs, one).collect())


def test_held_out_rows(spark):
    scored = catalog.QUERIES["op13_quality_classifier"](spark, LARGER).join(table(spark, "labels", LARGER), "doc_id")
    rows = scored.filter("held_out and quality in (0, 1)").select("quality", "predicted").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert len(good) > 500 and len(bad) > 80
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
