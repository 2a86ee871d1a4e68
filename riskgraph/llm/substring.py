"""Substring dedup: repeated 50-word passages are found with suffix automata of reference shards.

A window's anchor is the smallest of its 16-word hashes, so equal windows have equal anchors at
equal places. The windows of a document that share an anchor form a run. Runs, not windows, are
dealt out by anchor:

* an anchor that only one document holds repeats nothing;
* documents whose run equals one of a smaller document lose all its windows;
* where an anchor has runs of different content, each distinct run is matched against a suffix
  automaton of the runs that smaller documents hold. Matching statistics of 50 words or more mark
  the windows that occur there.

The runs of an anchor are its reference shard. The total of all shards has no bound, so a shard
is not broadcast: it meets its runs in the task its anchor is dealt to. An anchor with more than
``SHARD_RUNS`` distinct runs is cut into single windows, each dealt out by its own content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import chunks, gram_hashes, saved, stretch_hashes, with_ids

WINDOW, GRAM = 50, 16
SHARD_RUNS = 500
SPAN = WINDOW - GRAM + 1  # grams of a window, and windows of a run at most


def _window_minima(grams: np.ndarray) -> np.ndarray:
    """Smallest gram hash of every window, by doubling."""
    low, width = grams, 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(grams) - SPAN + 1], low[SPAN - width :][: len(grams) - SPAN + 1])


def runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, first window and number of windows of every run of a document."""
    if len(hashes) < WINDOW:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty, empty
    low = _window_minima(gram_hashes(hashes, GRAM))
    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate([[0], cuts])
    # A long repetition of one text keeps its anchor; such runs are cut to the usual length.
    lengths = np.diff(np.append(first, len(low)))
    if lengths.max() > SPAN:
        first = np.concatenate([np.arange(f, f + n, SPAN) for f, n in zip(first, lengths)])
        lengths = np.diff(np.append(first, len(low)))
    content = stretch_hashes(hashes, first, lengths + WINDOW - 1)
    return low[first].view(np.int64), content.view(np.int64), first, lengths


def _runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple, object, int, int]]:
    """Row of the batch, its runs, and where its words lie."""
    for words in chunks(batch["text"]):
        for j, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            yield words.row + j, runs(words.hashes[a:b]), words, a, b


def _occurrences(docs: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            rows, anchors, contents = [], [], []
            for row, (anchor, content, *_), *_ in _runs_of(batch):
                if len(anchor):
                    pairs = np.unique(np.stack([anchor, content]), axis=1)
                    rows.append(np.full(pairs.shape[1], ids[row], dtype=np.int64))
                    anchors.append(pairs[0])
                    contents.append(pairs[1])
            join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(x)) for x in (anchors, contents, rows)],
                names=["anchor", "content", "doc_id"],
            )

    return docs.filter("doc_id is not null").mapInArrow(
        find, "anchor long, content long, doc_id long"
    )


class SuffixAutomaton:
    """Substrings of the added word sequences, with the first document that held each state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [-1]

    def _state(self, edges: dict, length: int, link: int, owner: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q], self.owner[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, owner: int) -> None:
        """Sequences must be added by rising owner; states keep their first one."""
        last = 0
        for word in words:
            p = last
            if word in self.next[p]:
                q = self.next[p][word]
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
                continue
            last = self._state({}, self.length[p] + 1, 0, owner)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                exact = self.length[q] == self.length[p] + 1
                self.link[last] = q if exact else self._split(p, q, word)

    def statistics(self, words: list, least: int) -> Iterator[tuple[int, int]]:
        """For every word the longest match that ends there, and the first owner of its last
        ``least`` words where it is that long (else -1)."""
        state, size = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            held = state
            if size >= least:
                while self.length[self.link[held]] >= least:
                    held = self.link[held]
            yield size, self.owner[held] if size >= least else -1


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit mask of the windows of each run that occur in a run of a smaller document."""
    anchor, automaton, last = None, None, []
    for batch in batches:
        masks = []
        columns = (batch[c].to_pylist() for c in ("anchor", "doc_id", "words"))
        for key, owner, text in zip(*columns):
            words = text.split(b" ")
            if key != anchor:
                anchor, automaton = key, SuffixAutomaton()
            mask = 0
            known = True
            for j, (size, first) in enumerate(automaton.statistics(words, WINDOW)):
                if j >= WINDOW - 1:
                    if size >= WINDOW and first < owner:
                        mask |= 1 << (j - WINDOW + 1)
                    known = known and size >= WINDOW
            if not known:
                automaton.add(words, owner)
            masks.append(mask)
        yield pa.RecordBatch.from_arrays(
            [batch["anchor"], batch["content"], pa.array(masks, pa.int64())],
            names=["anchor", "content", "mask"],
        )


def _spans(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words of the wanted runs (``anchor, content, doc_id``), taken from their documents."""
    lists = saved(
        wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "content")).alias("runs"))
    )
    texts = with_ids(docs, lists.select("doc_id")).join(lists, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch["runs"].to_pylist()
            ids = batch["doc_id"].to_pylist()
            out: list[list] = [[], [], [], []]
            for row, (anchor, content, first, size), words, a, _ in _runs_of(batch):
                left = {(r["anchor"], r["content"]) for r in asked[row]}
                for key, c, f, n in zip(*(x.tolist() for x in (anchor, content, first, size))):
                    if (key, c) in left:
                        left.discard((key, c))
                        at = range(a + f, a + f + n + WINDOW - 1)
                        parts = [words.data[words.starts[i] : words.ends[i]].tobytes() for i in at]
                        for column, value in zip(out, (key, c, ids[row], b" ".join(parts))):
                            column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds)],
                names=["anchor", "content", "doc_id", "words"],
            )

    return texts.mapInArrow(cut, "anchor long, content long, doc_id long, words binary")


def _single_windows(spans: DataFrame) -> DataFrame:
    """Masks of runs of crowded anchors: every window is dealt out by its own content."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row in batch.to_pylist():
                words = row["words"].split(b" ")
                for j in range(len(words) - WINDOW + 1):
                    window = hashlib.md5(b" ".join(words[j : j + WINDOW])).digest()
                    values = (row["anchor"], row["content"], row["doc_id"], j, window)
                    for column, value in zip(out, values):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds)],
                names=["anchor", "content", "doc_id", "j", "window"],
            )

    windows = spans.mapInArrow(
        cut, "anchor long, content long, doc_id long, j int, window binary"
    )
    first = windows.groupBy("window").agg(F.min("doc_id").alias("first"))
    later = windows.join(first, "window").filter("first < doc_id")
    return later.groupBy("anchor", "content").agg(
        F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask")
    )


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, anchor, content, mask``: runs with windows that start in a smaller document.

    Bit i of the mask stands for window i of the run; a mask of -1 stands for all of them.
    """
    found = saved(_occurrences(docs))
    anchors = found.groupBy("anchor").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        (F.min("content") != F.max("content")).alias("varied"),
    ).filter("low < high")
    anchors = saved(anchors.select("anchor", "varied"))
    shared = saved(with_ids(found, anchors.select("anchor"), "anchor"))
    owners = saved(
        shared.groupBy("anchor", "content").agg(
            F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")
        )
    )
    varied = owners.join(anchors.filter("varied").select("anchor"), "anchor", "left_semi")
    crowded = varied.groupBy("anchor").count().filter(F.col("count") > SHARD_RUNS).select("anchor")
    crowded = saved(crowded)
    spans = saved(_spans(docs, varied.select("anchor", "content", "doc_id")))
    spans = spans.dropDuplicates(["anchor", "content"])
    few = spans.join(crowded, "anchor", "left_anti")
    matched = (
        few.repartition("anchor")
        .sortWithinPartitions("anchor", "doc_id", "content")
        .mapInArrow(_match, "anchor long, content long, mask long")
        .filter("mask <> 0")
    )
    if crowded.head(1):
        matched = matched.unionByName(_single_windows(spans.join(crowded, "anchor", "left_semi")))
    matched = saved(matched)
    # Whole runs of later documents, then partly known runs of the first one.
    copies = shared.alias("s").join(
        owners.filter("doc_id < last").select("anchor", "content", F.col("doc_id").alias("first")),
        ["anchor", "content"],
    ).filter("doc_id > first")
    partly = owners.join(matched, ["anchor", "content"])
    return copies.select("doc_id", "anchor", "content", F.lit(-1).cast("long").alias("mask")).unionByName(
        partly.select("doc_id", "anchor", "content", "mask")
    )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marked = batch["runs"].to_pylist()
        counts, removed, kept = [], [], []
        for row, (anchor, content, first, size), words, a, b in _runs_of(batch):
            masks = {(r["anchor"], r["content"]): r["mask"] for r in marked[row] or ()}
            counts.append(b - a)
            whole = words.data[words.starts[a] : words.ends[b - 1]].tobytes().split() if b > a else []
            if masks:
                gone = np.zeros(b - a + 1, dtype=np.int64)
                for key, c, f, n in zip(*(x.tolist() for x in (anchor, content, first, size))):
                    mask = masks.get((key, c), 0)
                    for j in range(n) if mask else ():
                        if mask >> j & 1:
                            gone[f + j] += 1
                            gone[f + j + WINDOW] -= 1
                stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                whole = [whole[i] for i in stay.tolist()]
            removed.append(b - a - len(whole))
            kept.append(b" ".join(whole).decode())
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(kept, pa.string()),
            ],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs``.

    ``kept`` is the text without every word that a 50-word window covers whose words also start in
    a document with a smaller id; words are joined by one space. Null and empty texts have no
    words. Rows without an id keep all words and are no reference. Rows that repeat an id are one
    document: none is smaller than the other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = repeated_runs(docs)
    lists = saved(
        marked.groupBy("doc_id", "anchor", "content").agg(F.bit_or("mask").alias("mask"))
        .groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "content", "mask")).alias("runs"))
    )
    ids = lists.select("doc_id")
    count = ids.count()
    touched = with_ids(docs, ids, known=count).join(lists, "doc_id")
    small = F.broadcast(ids) if count <= 1_000_000 else ids
    clean = docs.join(small, "doc_id", "left_anti").withColumn("runs", F.lit(None).cast(lists.schema["runs"].dataType))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return touched.mapInArrow(_strip, schema).unionByName(clean.mapInArrow(_strip, schema))
