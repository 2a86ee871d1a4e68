import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Clashing names: operators must not trip over columns called like their own.
        T.StructField("n", T.LongType()), T.StructField("k", T.StringType()),
    ]
)


def words(start, count, step=7):
    return " ".join(f"w{(start + i * step) % 997}x{start}" for i in range(count))


def corpus():
    """Copies, near copies, shared passages, nulls, empty, repeated, long and odd texts."""
    passage = words(5, 60)
    base = words(1, 120).split()
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, words(1, 120)), (2, " ".join(near)), (3, words(1, 120)), (4, None), (5, ""),
        (6, " \n\t "), (7, f"{words(11, 30)} {passage} {words(12, 30)}"),
        (8, f"{words(13, 20)}\n{passage}\t{words(14, 9)}"), (8, f"{words(15, 4)} {passage}"),
        (None, words(1, 120)), (9, words(9, 20_000, 1)), (10, "a b c"), (11, "A b C"),
        (12, "a b"), (12, "a b"), (13, "x " * 200), (14, "x " * 180), (15, passage),
        (16, "übrigens #1: *neu* <b>| $5 & 3%\n" * 3), (17, "A" * 50_000), (18, "1" * 20_000),
    ]
    return [
        (i, t, None if i == 7 else "en", None, None if t is None else len(t), 1, None)
        for i, t in rows
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
