"""Stages of the pipeline on awkward rows and the whole run against the operators."""

import re

import corpus_pipeline
import pytest
from conftest import SF

from llm.conftest import corpus, words
from riskgraph.llm import catalog, pii, quality


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_awkward_rows(spark, docs, empty, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, SF)
    assert 0 < out.count() <= len(corpus())
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert function(spark, empty, SF).count() == 0


def test_one_document_of_each_group_stays(spark, docs):
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert 1 in ids and None in ids and 2 not in ids and 3 not in ids and ids.count(12) == 1


def test_run_keeps_clean_documents(spark):
    got = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in got.select("doc_id").collect()}
    judged = catalog.QUERIES["op9_quality_rules"](spark, SF).filter("kept")
    assert kept <= {r["doc_id"] for r in judged.select("doc_id").collect()} and len(kept) > 50


CLASHING = ["_spans", "_redacted", "row", "_identity", "_stratum", "_stats", "_quality", "_cuts", "tag", "n", "k"]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", 3, *["x"] * len(CLASHING)) for i, t in rows], schema)


def kept_rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_rows_not_ids_are_copies(spark):
    a, b, c = words(1, 120), words(2, 90), words(3, 80)
    near = a.replace(a.split()[60], "changed")
    rows = [(1, a), (5, a), (5, b), (7, c), (1, a), (None, a), (9, near), (9, near), (None, None), (3, ""), (3, "")]
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF)
    assert kept_rows(out) == sorted([(1, a), (5, b), (7, c), (None, a), (None, None), (3, ""), (3, "")], key=str)
    assert out.columns == frame(spark, rows).columns
    # Two linked texts of the smallest id: one of them stays.
    out = corpus_pipeline.near_duplicates(spark, frame(spark, [(1, a), (1, near), (2, a)]), SF)
    assert [i for i, _ in kept_rows(out)] == [1]


def test_rows_not_ids_are_contaminated(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()[0]
    dirty = f"{words(4, 30)} {item} {words(5, 30)}"
    clean, other = words(6, 100), words(7, 100)
    rows = [(None, dirty), (3, dirty), (3, clean), (4, other), (None, other), (3, clean)]
    out = corpus_pipeline.decontamination(spark, frame(spark, rows), SF)
    assert kept_rows(out) == sorted([(3, clean), (3, clean), (4, other), (None, other)], key=str)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns(spark, stage):
    rows = [(1, "My card +49 30 1234567 and a@b.example.org. " + words(1, 100)), (2, None), (None, words(2, 60)), (3, "")]
    docs = frame(spark, rows)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    for row in out.collect():
        assert all(row[c] == "x" for c in docs.columns[4:])
    without = docs.select("text", "doc_id")
    assert corpus_pipeline.STAGES[stage][1](spark, without, SF).columns == ["text", "doc_id"]


def test_operators_take_clashing_columns(spark):
    docs = frame(spark, [(1, words(1, 100)), (2, None)])
    judged = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert judged.count() == 2 and judged.columns[-1] == "_quality" and judged.columns.count("_quality") == 1
    found = pii.find(docs)
    assert found.count() == 2 and found.columns.count("_spans") == 1
    assert {r["_stratum"] for r in judged.collect()} == {"x"}


def brute_copies(rows):
    """Rows that stay when one of each group of linked rows does."""
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w and i is not None else set())
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                group = [group[y] if g == group[x] else g for g in group]
    out = []
    for g in set(group):
        members = [rows[k] for k in range(len(rows)) if group[k] == g]
        least = min((i for i, _ in members if i is not None), default=None)
        out.append((least, len(members), g))
    return sorted((i, ) for i, _, _ in out if i is not None)


def test_copies_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((i, ) for i, _ in kept_rows(out) if i is not None) == brute_copies(rows)
