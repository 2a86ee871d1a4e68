"""Very long runs and random texts: cuts never move a match, and no text fails."""

import functools
import random

import numpy as np
import public_tokenizers
import pytest
import regex

from riskgraph.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@functools.cache
def codec():
    return bpe._codec(bpe._rank_bytes(RANKS), PATTERN)


@pytest.mark.parametrize("seed", range(300))
def test_parts_keep_every_match(seed):
    rng = random.Random(seed)
    pieces = [
        " ", "  ", "\n", "\t\n ", "a", "don't", "'s", "'", "''ll", "中文", "です。", "привет", "é", "12", "٣",
        "!?", "$", "😀", "　", "\xa0", "\x1c", "\x85", "x1y2", "é", "​", "_", "-'re ",
    ]
    text = "".join(rng.choice(pieces) * rng.choice([1, 1, 1, 3]) for _ in range(rng.randrange(0, 60)))
    cut = list(bpe.parts(text, size=rng.choice([1, 3, 10]), run=rng.choice([2, 3, 5])))
    assert "".join(p for p, _ in cut) == text
    ids = [i for p, whole in cut for i in (codec()._encode_single_piece(p) if whole else codec().encode_ordinary(p))]
    assert ids == codec().encode_ordinary(text)


def matches_merged_one_by_one(text):
    """Ids of runs of one kind: the pattern's matches are known, each is merged by itself."""
    return [i for m in regex.findall(PATTERN, text) for i in codec()._encode_single_piece(m)]


@pytest.mark.parametrize("piece", [" ", "\n", " \n", "a", "中", "!", "中文。", "привет "])
@pytest.mark.parametrize("tail", ["", "x", " end"])
def test_two_million_characters(piece, tail):
    text = piece * (2_000_000 // len(piece)) + tail
    assert np.array_equal(bpe.encode_text(codec(), text), matches_merged_one_by_one(text))
    if len(set(piece)) > 2:
        assert max(len(p) for p, _ in bpe.parts(text)) <= 3 * bpe.BLOCK_CHARS


def test_long_runs_in_a_table(spark):
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", None, "", " \n" * 700_000 + "."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.decode(bpe.encode(frame, RANKS, PATTERN), RANKS, PATTERN).select("doc_id", "decoded").collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows} == dict(enumerate(t or "" for t in texts))


def test_one_pass_equals_two(spark, docs):
    two = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    one = bpe.round_trip(docs, RANKS, PATTERN)
    assert one.columns == two.columns and sorted(one.collect(), key=str) == sorted(two.collect(), key=str)
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0
