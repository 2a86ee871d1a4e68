"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Item-sized windows of the documents are embedded by random walks over their words, which turn
edit distance into Hamming distance. Each repetition samples a few steps of a walk; windows and
items with equal samples are aligned exactly, and a pair counts when at most a fifth of the
item's words are edited.

A window is only looked at where it holds a short run of words of an item: with so few edits one
run of three words (two for five-word items) always stays whole, so nothing is lost by that.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import Words, chunks, gram_hashes, mix

# Items with fewer words cannot be told from ordinary text and match nothing.
MIN_ITEM_WORDS = 5
# Benchmark items are sent to the executors in blocks of about so many bytes.
ITEM_BLOCK_BYTES = 8 << 20
# Steps sampled by a repetition, and the fewest repetitions. Walks shift after an edit, so longer
# items agree in fewer steps and take more repetitions. Of 400 random pairs with a fifth of the
# words replaced, 0.9975 share a key at 10 words and 1.0 at 25, 50, 100 and 200.
SAMPLED, REPEATS = 3, 24
SEED = 20240229


def allowed_edits(words: int) -> int:
    return words // 5


def seed_words(words: int) -> int:
    """Words in a row that the allowed edits always leave whole."""
    edits = allowed_edits(words)
    return min(3, -(-(words - edits) // (edits + 1)))


def repeats(size: int) -> int:
    """Repetitions for items of ``size`` words."""
    return max(REPEATS, 3 * size // 2)


@lru_cache(maxsize=256)
def _plan(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Random salts of every step and repetition, and which steps each repetition samples."""
    random = np.random.default_rng([SEED, size])
    # Later steps of the walk mostly read padding, so samples come from the first half.
    steps = 3 * size // 2
    salts = random.integers(0, 1 << 63, (steps, repeats(size), 1), dtype=np.uint64)
    wanted = np.zeros((steps, repeats(size)), dtype=bool)
    for repeat in range(repeats(size)):
        wanted[random.choice(steps, SAMPLED, replace=False), repeat] = True
    return salts, wanted


def embed_keys(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """LSH keys (one row per repetition) of the windows of ``size`` words at ``starts``.

    A walk reads the word under its pointer and moves on by a random bit that depends on that
    word, the step and the repetition; all walks go in step.
    """
    salts, wanted = _plan(size)
    count = repeats(size)
    padded = np.append(hashes, np.uint64(0))
    at = np.repeat(starts[None, :], count, axis=0)
    ends = np.minimum(starts + size, len(hashes))[None, :]
    keys = np.repeat(np.arange(1, count + 1, dtype=np.uint64)[:, None], len(starts), axis=1)
    for step in range(len(salts)):
        value = padded[np.where(at < ends, at, len(hashes))]
        rows = np.flatnonzero(wanted[step])
        if len(rows):
            keys[rows] = mix(keys[rows] * np.uint64(0x9E3779B97F4A7C15) + value[rows])
        at += (mix(value ^ salts[step]) >> np.uint64(63)).astype(np.int64)
    return keys


def edit_distance(item: list, text: list) -> tuple[int, int]:
    """Fewest word edits from the item to any stretch of ``text``, and that stretch's end."""
    text = np.asarray(text, dtype=np.uint64)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    ramp = np.arange(len(text) + 1)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


class _Items:
    """Lookup tables of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for (item, _), words in zip(items, self._hashes([t for _, t in items])):
            if len(words) >= MIN_ITEM_WORDS:
                self.ids.append(item)
                self.words.append(words)
        self.seeds: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        self.keys: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i, words in enumerate(self.words):
            size = len(words)
            width = seed_words(size)
            for at, gram in enumerate(gram_hashes(words, width).tolist()):
                if (size, at) not in self.seeds[width][gram]:
                    self.seeds[width][gram].append((size, at))
        for size in {len(words) for words in self.words}:
            same = [i for i, words in enumerate(self.words) if len(words) == size]
            joined = np.concatenate([self.words[i] for i in same])
            keys = embed_keys(joined, np.arange(len(same), dtype=np.int64) * size, size)
            for column, i in enumerate(same):
                for key in keys[:, column].tolist():
                    self.keys[size][key].append(i)
        self.sorted = {w: np.sort(np.fromiter(s, dtype=np.uint64)) for w, s in self.seeds.items()}
        self.filter = {}
        for width, grams in self.sorted.items():
            bits = np.zeros(1 << 22, dtype=bool)
            bits[(grams % np.uint64(1 << 22)).astype(np.int64)] = True
            self.filter[width] = bits

    @staticmethod
    def _hashes(texts: list[str]) -> Iterator[np.ndarray]:
        for words in chunks(pa.array(texts, pa.string()), lower=True):
            for a, b in zip(words.first[:-1], words.first[1:]):
                yield words.hashes[a:b]

    def windows(self, hashes: np.ndarray) -> dict[int, set]:
        """Window starts by size where a seed is found; windows may reach beyond their row."""
        found: dict[int, set] = defaultdict(set)
        for width, grams in self.sorted.items():
            here = gram_hashes(hashes, width)
            maybe = np.flatnonzero(self.filter[width][(here % np.uint64(1 << 22)).astype(np.int64)])
            values = here[maybe]
            slot = np.minimum(np.searchsorted(grams, values), len(grams) - 1)
            for p, gram in zip(maybe[grams[slot] == values].tolist(), values[grams[slot] == values].tolist()):
                for size, at in self.seeds[width][gram]:
                    found[size].add(p - at)
        return found

    def collect(self, words: Words, waiting: dict[int, list]) -> None:
        """Add the candidate windows of a chunk: row, start, offset in the stretch, stretch.

        The stretch holds the window and, within its row, the words that edits could add.
        """
        hashes, first = words.hashes, words.first
        for size, places in self.windows(hashes).items():
            starts = np.maximum(np.array(sorted(s for s in places if -size < s), np.int64), 0)
            # The middle of the window tells its row; its ends may stick out by a few words.
            middle = np.minimum(starts + size // 2, len(hashes) - 1)
            rows = np.searchsorted(first, middle, "right") - 1
            starts = np.maximum(starts, first[rows])
            edits = allowed_edits(size)
            for row, start in sorted(set(zip(rows.tolist(), starts.tolist()))):
                low = max(int(first[row]), start - edits)
                high = min(int(first[row + 1]), start + size + edits)
                at = start - int(first[row])
                waiting[size].append((words.row + row, at, start - low, hashes[low:high].copy()))

    def search(self, waiting: dict[int, list]) -> Iterator[tuple[int, int, int, int]]:
        """``row, item, distance, start word`` of the best match of each row and item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for size, found in waiting.items():
            table = np.zeros((len(found), size), dtype=np.uint64)
            for j, (_, _, offset, stretch) in enumerate(found):
                window = stretch[offset : offset + size]
                table[j, : len(window)] = window
            keys = embed_keys(table.ravel(), np.arange(len(found), dtype=np.int64) * size, size)
            edits, items = allowed_edits(size), self.keys[size]
            for j, column in enumerate(keys.T.tolist()):
                for item in {i for key in column for i in items.get(key, ())}:
                    row, at, offset, stretch = found[j]
                    distance, end = edit_distance(self.words[item].tolist(), stretch)
                    if distance <= edits:
                        place = (distance, max(at - offset + end - size, 0))
                        best[row, item] = min(best.get((row, item), place), place)
        for (row, item), (distance, at) in sorted(best.items()):
            yield row, item, distance, at


FOUND = "doc_id long, item_id long, distance int, item_words int, start_word long, similarity double"


def _search_block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Items(shared.value)
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            out: list[list] = [[] for _ in range(6)]
            waiting: dict[int, list] = defaultdict(list)
            for words in chunks(batch["text"], lower=True):
                block.collect(words, waiting)
            for row, item, distance, at in block.search(waiting):
                size = len(block.words[item])
                values = ids[row], block.ids[item], distance, size, at, 1 - distance / size
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
            names = [part.split()[0] for part in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds)], names=names
            )

    return docs.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` and each item that it repeats with few edits.

    Words are compared with A-Z lower-cased; at most a fifth of the item's words may be inserted,
    deleted or replaced. ``start_word`` is about where the best match begins. Null and empty
    texts match nothing, nor do items of fewer than five words. Repeated rows give repeated
    results; a null id is kept. Items are compared with all documents block by block, however
    many there are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.filter("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    ).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // ITEM_BLOCK_BYTES))
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = []
    for block in range(blocks):
        rows = items.filter(slot == block).collect()  # one block, of bounded size
        parts.append(_search_block(docs, [(r["item_id"], r["text"]) for r in rows]))
    return reduce(DataFrame.unionByName, parts)
