"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are the distinct shingle sets, columns are shingles. Two sets with a
similarity of at least 4/5 must share one of the ``n - ceil(4n / 5) + 1`` first shingles of each
in any fixed global order; shingles are ordered by an estimate of how many documents hold them,
rare ones first, then by hash. Only these entries are dealt out, in blocks of columns. The
product of a block finds pairs of rows with a common column, and a pair is discarded where even
all shingles from that column on could not make up the overlap its sizes ask for: the first
common column of a true pair never discards it. Surviving pairs are counted exactly.

Columns with many rows are not multiplied out: their rows are compared with a few pivots, then
with new ones as long as that unites them quickly. Only rows that then still lie in different
components meet each other, and of those pairs only the ones are counted whose signatures allow it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.bpe import slices
from riskgraph.llm.common import Words, chunks, gram_hashes, mix, released, saved, with_ids
from riskgraph.operators.components import connected_components

SHINGLE = 5
# Counters of the estimate of document counts: a fixed 4 MB on the driver and in every task. The
# estimate only orders shingles, so results do not depend on its size; common shingles sink the
# better the more counters there are.
SKETCH, SKETCH_BLOCKS = 1 << 22, 64
# Entries of a column block, and rows of a column that are multiplied out directly.
BLOCK_ENTRIES, PAIR_ROWS = 250_000, 2
FLUSH_ENTRIES = 500_000
# Bits of a set's signature.
SIGNATURE = 1024
# Pivots of a long column in each later round.
PIVOTS = 2

_ENTRY = np.dtype([("h", "<u8"), ("k", "<i8"), ("n", "<i4"), ("i", "<i4")])


def shingle_sets(words: Words, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a chunk.

    A row with fewer words than a shingle has its whole sequence as one; without words it has none.
    """
    grams = gram_hashes(words.hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield gram_hashes(words.hashes[a:b], b - a)
        else:
            yield np.empty(0, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """Signed 64-bit identity of a shingle set."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def needed(n, m):
    """Smallest overlap of sets of n and m elements with a similarity of at least 4/5."""
    return (4 * (n + m) + 8) // 9


def linked(common, n, m):
    return 100 * common >= 80 * (n + m - common)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of ``SIGNATURE`` bits, as 64-bit integers.

    Two signatures differ in no more bits than the sets differ in shingles.
    """
    odd = np.bincount((shingles % np.uint64(SIGNATURE)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


_SETS = "doc_id long, tag long, n int, k long, bits array<bigint>, block int, counts binary"


def _sets(docs: DataFrame) -> DataFrame:
    """Size, identity and signature of every set; rows with a block hold the counters of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SKETCH, dtype=np.uint8)  # saturating

        def rows(ids, tags, sizes, keys, bits, blocks, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(sizes, pa.int32()),
                    pa.array(keys, pa.int64()), pa.array(bits, pa.list_(pa.int64())),
                    pa.array(blocks, pa.int32()), pa.array(counts, pa.binary()),
                ],
                names=["doc_id", "tag", "n", "k", "bits", "block", "counts"],
            )

        for batch in batches:
            sizes, keys, bits = [], [], []
            for words in chunks(batch["text"], lower=True):
                sets = list(shingle_sets(words))
                sizes += map(len, sets)
                keys += map(set_key, sets)
                bits += map(signature, sets)
                if sets:
                    slots, more = np.unique(np.concatenate(sets) % SKETCH, return_counts=True)
                    counters[slots] = np.minimum(counters[slots] + more, 255)
            none = [None] * len(sizes)
            yield rows(batch["doc_id"], batch["tag"], sizes, keys, bits, none, none)
        pack = zstd.ZstdCompressor(level=1).compress
        split = np.split(counters, SKETCH_BLOCKS)
        used = [i for i, c in enumerate(split) if c.any()]
        parts = [pack(split[i].tobytes()) for i in used]
        none = [None] * len(used)
        yield rows(none, none, none, none, none, used, parts)
        released()

    tag = F.col("tag") if "tag" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long"), "text", tag.cast("long").alias("tag"))
    return rows.mapInArrow(run, _SETS)


def _estimates(sets: DataFrame) -> np.ndarray:
    """Sums of all tasks' counters on a logarithmic scale: a fixed number of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstd.ZstdDecompressor().decompress
        for batch in batches:
            for block, packed in zip(batch["block"].to_pylist(), batch["counts"].to_pylist()):
                counts = np.frombuffer(unpack(packed), dtype=np.uint8)
                sums[block] = sums.get(block, 0) + counts.astype(np.int64)
        packed = [(4 * np.log2(1 + c)).astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())],
            names=["block", "counts"],
        )

    parts = sets.filter("block is not null").select("block", "counts")
    summed = parts.repartition(SKETCH_BLOCKS, "block").mapInArrow(run, "block int, counts binary")
    out = np.zeros((SKETCH_BLOCKS, SKETCH // SKETCH_BLOCKS), dtype=np.uint8)
    for row in summed.collect():
        out[row["block"]] = np.frombuffer(row["counts"], dtype=np.uint8)
    return out.reshape(-1)


def _entries(docs: DataFrame, estimates: np.ndarray, blocks: int) -> DataFrame:
    """Packed prefix entries by column block."""
    shared = docs.sparkSession.sparkContext.broadcast(estimates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, seen, total = shared.value, [], set(), 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(waiting) if waiting else np.empty(0, _ENTRY)
            block = ((entries["h"] >> np.uint64(20)) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            entries, block = entries[order], block[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            first = [0, *cuts.tolist()] if len(entries) else []
            parts = np.split(entries, cuts) if len(entries) else []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(block[first].tolist(), pa.int32()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                names=["block", "entries"],
            )

        for batch in batches:
            for words in chunks(batch["text"], lower=True):
                for s in shingle_sets(words):
                    n = len(s)
                    key = set_key(s)
                    if n == 0 or key in seen:  # equal sets have equal entries
                        continue
                    seen.add(key)
                    order = np.argsort(counts[s % np.uint64(SKETCH)], kind="stable")
                    prefix = s[order[: n - (4 * n + 4) // 5 + 1]]
                    part = np.empty(len(prefix), dtype=_ENTRY)
                    part["h"], part["k"], part["n"] = prefix, key, n
                    part["i"] = np.arange(len(prefix))
                    waiting.append(part)
                    total += len(prefix)
                if total >= FLUSH_ENTRIES:
                    yield flush()
                    waiting, seen, total = [], set(), 0
        yield flush()
        released()

    # Rows without an id are never linked.
    return docs.filter("doc_id is not null").select("text").mapInArrow(
        run, "block int, entries binary"
    )


def _pairs_of(n: np.ndarray, i: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which index pairs can still reach the overlap that their sizes ask for."""
    rest = np.minimum(n[a] - i[a], n[b] - i[b])
    return rest >= needed(n[a].astype(np.int64), n[b])


_FOUND = "a long, b long, h long, k long, n int, i int, own boolean"


def size_class(n: np.ndarray) -> np.ndarray:
    """Logarithmic class of a set's size: linked sets lie in the same class or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(1.25) + 1e-9).astype(np.int64)


def cells(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of columns dealt by (column, size class), and whether a row belongs to its cell's class.

    A cell holds the rows of its own class and of the class below, so rows that can be linked meet
    in one where at least one of them is its own. ``h`` becomes the cell. Cells without two rows,
    or without a row of their own, are left out.
    """
    if not len(e):
        return e, np.zeros(0, dtype=bool)
    e = np.concatenate([e, e])
    own = np.arange(len(e)) < len(e) // 2
    kind = size_class(e["n"]) + ~own
    e["h"] = mix(e["h"] + mix(kind.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(e["h"], kind="stable")
    e, own = e[order], own[order]
    new = np.concatenate([[True], e["h"][1:] != e["h"][:-1]])
    cell = np.cumsum(new) - 1
    good = (np.bincount(cell)[cell] > 1) & (np.bincount(cell, weights=own)[cell] > 0)
    return e[good], own[good]


def _multiply(entries: DataFrame) -> DataFrame:
    """Candidate pairs (``a, b``) of every column block, and the entries of long columns by cell."""

    def out(a, b, large: np.ndarray, own: np.ndarray) -> pa.Table:
        none = lambda kind: pa.nulls(len(large), kind)
        gone = lambda kind: pa.nulls(len(a), kind)
        pairs = [pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        pairs += [gone(pa.int64()), gone(pa.int64()), gone(pa.int32()), gone(pa.int32()), gone(pa.bool_())]
        rows = [none(pa.int64()), none(pa.int64()), pa.array(large["h"].view("<i8") if len(large) else [], pa.int64())]
        rows += [pa.array(large["k"].copy()), pa.array(large["n"].copy()), pa.array(large["i"].copy()), pa.array(own)]
        names = [part.split()[0] for part in _FOUND.split(", ")]
        return pa.concat_tables([pa.table(pairs, names=names), pa.table(rows, names=names)])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            np.frombuffer(x, dtype=_ENTRY) for batch in batches for x in batch["entries"].to_pylist()
        ]
        e = np.concatenate(parts)
        e = e[np.lexsort((e["k"], e["h"]))]
        e = e[np.concatenate([[True], (e["h"][1:] != e["h"][:-1]) | (e["k"][1:] != e["k"][:-1])])]
        h = np.ascontiguousarray(e["h"])
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        k, n, i = (np.ascontiguousarray(e[c]) for c in ("k", "n", "i"))
        found_a, found_b = [], []

        def keep(a: np.ndarray, b: np.ndarray) -> None:
            ok = _pairs_of(n, i, a, b)
            found_a.append(k[a[ok]])
            found_b.append(k[b[ok]])

        for size in range(2, PAIR_ROWS + 1):  # all columns with so many rows at once
            at = starts[sizes == size]
            if len(at):
                x, y = np.triu_indices(size, 1)
                for some in np.array_split(at, max(1, len(at) * len(x) // 2_000_000)):
                    keep((some[:, None] + x).ravel(), (some[:, None] + y).ravel())
        long = np.flatnonzero(sizes > PAIR_ROWS)
        for start, size in zip(starts[long].tolist(), sizes[long].tolist()):
            # The pivot is the smallest identity, so the columns of a group agree on a few.
            inside = np.arange(start, start + size)
            while len(inside) > 1:  # a pivot, and the rows whose size allows a link to it
                pivot, rest = inside[0], inside[1:]
                fits = (5 * n[rest] >= 4 * n[pivot]) & (5 * n[pivot] >= 4 * n[rest])
                keep(np.full(int(fits.sum()), pivot), rest[fits])
                inside = rest[~fits]
        large = (
            np.concatenate([e[s : s + z] for s, z in zip(starts[long], sizes[long])])
            if len(long)
            else np.empty(0, _ENTRY)
        )
        a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) if len(a) else []
        new = np.asarray(new, dtype=bool)
        yield from out(low[new], high[new], *cells(large)).combine_chunks().to_batches()

    return entries.groupBy("block").applyInArrow(run, _FOUND)


def _differ(left: str, right: str) -> Column:
    """Number of bits in which two signature columns differ."""
    words = range(SIGNATURE // 64)
    return reduce(add, [F.bit_count(F.col(left)[j].bitwiseXOR(F.col(right)[j])) for j in words])


def _signatures(sets: DataFrame, ends: DataFrame) -> DataFrame:
    """``k, n, bits`` of the sets in the one-column frame ``ends``."""
    return saved(sets.join(ends, "k", "left_semi").select("k", "n", "bits").dropDuplicates(["k"]))


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose signatures allow a link: linked sets differ in at most a ninth of ``n + m``."""
    known = _signatures(sets, pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    left, right = (
        known.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
        for c in "ab"
    )
    sides = pairs.join(left, "a").join(right, "b")
    fits = _differ("bits_a", "bits_b") * 9 <= F.col("n_a") + F.col("n_b")
    return saved(sides.filter(fits).select("a", "b"))


def _texts(docs: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """One text (``k, text``) of each end of the pairs; ``keys`` names one document of each set (``k, rep``)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    wanted = saved(keys.join(ends, "k", "left_semi").select(F.col("rep").alias("doc_id")).distinct())

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [set_key(s) for words in chunks(batch["text"], lower=True) for s in shingle_sets(words)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), batch["text"]], names=["k", "text"])

    texts = (
        with_ids(docs.select(F.col("doc_id").cast("long"), "text"), wanted)
        .mapInArrow(name, "k long, text string")
        .dropDuplicates(["k"])
    )
    return saved(texts)


def _links(docs: DataFrame, keys: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of set identities whose exact similarity is at least 4/5.

    Only pairs that pass the signatures are counted on their texts.
    """
    pairs = _likely(pairs, sets)
    texts = _texts(docs, keys, pairs)
    sides = pairs.join(texts.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text_b")):
            left = batch["a"].to_pylist()
            new = [j for j, key in enumerate(left) if j == 0 or key != left[j - 1]]
            firsts = batch["text_a"].take(pa.array(new, pa.int64()))
            pivots = (s for words in chunks(firsts, lower=True) for s in shingle_sets(words))
            others = (s for words in chunks(batch["text_b"], lower=True) for s in shingle_sets(words))
            good, starts, pivot = [], set(new), None
            for j, s in enumerate(others):
                if j in starts:
                    pivot = next(pivots)
                common = len(np.intersect1d(pivot, s, assume_unique=True))
                if linked(common, len(pivot), len(s)):
                    good.append(j)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))
        released()

    return saved(sides.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"))


def _open_rows(large: DataFrame, roots: DataFrame) -> tuple[DataFrame, float]:
    """Rows of long columns that are not in one component yet, with their roots.

    The second value is the number of pairs in different components that those columns hold.
    """
    labelled = saved(large.join(roots.withColumnRenamed("node", "k"), "k"))
    n = F.col("n").cast("double")
    apart = saved(
        labelled.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.sum(n).alias("n"), F.sum(n * n).alias("same"))
        .filter("roots > 1").select("h", ((n * n - F.col("same")) / 2).alias("pairs"))
    )
    total = apart.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
    return with_ids(labelled, apart.select("h"), "h"), total


def _apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a cell's rows in different components, as ``a < b``.

    A pair is left out where its sizes and places, or the signatures if the rows have them, show
    that it falls short of the overlap. If both frames are one, each pair is met once.
    """
    fits = F.least(F.col("n_a").cast("long") - F.col("i_a"), F.col("n").cast("long") - F.col("i")) * 9
    total = F.col("n_a").cast("long") + F.col("n")
    allowed = F.expr("root_a <> root and (own_a or own)") & (fits >= 4 * total)
    if "bits" in left.columns and "bits" in right.columns:
        allowed &= _differ("bits_a", "bits") * 9 <= total
    if left is right:
        allowed &= F.expr("k_a < k")
    left = left.select("h", *[F.col(c).alias(f"{c}_a") for c in left.columns if c != "h"])
    pairs = left.join(right, "h").filter(allowed)
    return pairs.select(F.least("k_a", "k").alias("a"), F.greatest("k_a", "k").alias("b")).distinct()


def _pivots(still: DataFrame, number: int) -> DataFrame:
    """A few rows of every cell: the least ones by a hash that differs from round to round."""
    least = [
        F.min(F.struct(F.xxhash64("k", F.lit(number * PIVOTS + j)).alias("order"), "k", "n", "i", "root", "own"))
        for j in range(PIVOTS)
    ]
    rows = still.groupBy("h").agg(F.array_distinct(F.array(*least)).alias("p"))
    return rows.select("h", F.inline("p")).drop("order")


def _unite(
    docs: DataFrame, keys: DataFrame, sets: DataFrame, large: DataFrame, roots: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Links between rows of long columns that the first pivots left in different components.

    Rows meet new pivots as long as a round at least halves the pairs in different components;
    what is left then meets in full, so no link between components is missed. ``pairs`` have been
    compared before.
    """
    still, apart = _open_rows(large, roots)
    parts, number = [pairs.limit(0)], 0
    while apart:
        more = saved(_apart(_pivots(still, number), still).join(pairs, ["a", "b"], "left_anti"))
        links = _links(docs, keys, sets, more)
        parts.append(links)
        pairs = pairs.unionByName(more)
        known = still.select(F.col("k").alias("a"), F.col("root").alias("b"))
        nodes = still.select("k").distinct().withColumnRenamed("k", "node")
        roots = connected_components(nodes, known.unionByName(links))
        before = apart
        still, apart = _open_rows(still.drop("root"), roots)
        number += 1
        if 2 * apart > before:
            break
    if apart:
        known = _signatures(sets, still.select("k").distinct()).select("k", "bits")
        still = still.join(known, "k")
        rest = saved(_apart(still, still).join(pairs, ["a", "b"], "left_anti"))
        parts.append(_links(docs, keys, sets, rest))
    return reduce(DataFrame.unionByName, parts)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, its own where there are none. Null
    and empty texts have no shingles and no links. Rows without an id get a null component and
    link nothing. Repeated rows share a component; an id with several texts is judged text by
    text. Texts may be of any length. Ties in the order of shingles and pivots are broken by hash;
    the result does not depend on them. Sets are told apart by 64-bit hashes. Columns other than
    ``doc_id`` and ``text`` are ignored.
    """
    return tagged_duplicates(docs.select("doc_id", "text")).drop("tag", "root")


def tagged_duplicates(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the number ``tag`` of each row, which tells the texts of an id apart.

    ``root`` names the component: texts of one id may lie in different ones with the same smallest id.
    """
    sets = saved(_sets(docs))
    rows = sets.filter("block is null").select("doc_id", "tag", "n", "k")
    named = rows.filter("doc_id is not null and n > 0")
    keys = named.groupBy("k").agg(F.min("doc_id").alias("rep"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (5 * BLOCK_ENTRIES)))
    found = saved(_multiply(_entries(docs, _estimates(sets), blocks)))
    pairs = saved(found.filter("a is not null").select("a", "b").distinct())
    named = sets.filter("block is null and n > 0")
    links = _links(docs, keys, named, pairs)
    nodes = keys.select(F.col("k").alias("node"))
    roots = connected_components(nodes, links)
    large = found.filter("h is not null").select("h", "k", "n", "i", "own")
    more = _unite(docs, keys, named, large, roots, pairs)
    if more.head(1):
        roots = connected_components(nodes, links.unionByName(more))

    members = keys.join(roots.withColumnRenamed("node", "k"), "k")
    least = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    component = members.join(least, "root").select("k", "component_id", "root")
    return rows.join(component, "k", "left").select(
        "doc_id",
        "tag",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("_c"),
        "root",
    ).select(
        "doc_id", "tag", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("_c")).alias("component_id"), "root"
    )
