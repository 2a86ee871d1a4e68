"""Recall of the sampled walks at the largest allowed distance."""

import numpy as np
import pytest

from riskgraph.llm.decontaminate import allowed_edits, embed_keys


def recall(size: int, pairs: int) -> float:
    random = np.random.default_rng(size)
    items = random.integers(1, 1 << 63, (pairs, size), dtype=np.uint64)
    texts = items.copy()
    for row in texts:
        places = random.choice(size, allowed_edits(size), replace=False)
        row[places] = random.integers(1, 1 << 63, len(places), dtype=np.uint64)
    starts = np.arange(pairs, dtype=np.int64) * size
    same = embed_keys(items.ravel(), starts, size) == embed_keys(texts.ravel(), starts, size)
    return float(same.any(axis=0).mean())


@pytest.mark.parametrize("size", [50, 100, 200])
def test_pairs_at_the_largest_distance_share_a_key(size):
    assert recall(size, 400) >= 0.985
