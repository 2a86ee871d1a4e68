"""Balanced label propagation: equal texts gather in one shard, shard sizes stay even.

Documents with equal texts are linked. Every round joins each group's share in a shard with its
shares elsewhere and asks to move the smaller one to the largest. Between shards, requests offset
each other: what leaves a shard makes room for what enters it, along any cycle of shards, beside
the free room. The volumes come from one total per pair of shards; requests are granted in a fixed
order up to them. Among equal shares a new hash picks the one that moves in every round, and after
a round without progress it picks among all, so groups that were refused meet other partners;
rounds end when the number of shares, which no move can raise, stops falling.
Members of a group are interchangeable, so the rounds run on one row per group and shard, however
large the group, and single documents are only used to fill the quotas at the end. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.common import saved
from riskgraph.operators.keys import global_row_number
from riskgraph.operators.quantiles import cumulative

SHARDS = 8
# Rounds in a row without fewer shares after which nothing more is asked.
PATIENCE = 8
ROWS_PER_BUCKET = 200_000


def _bucket(rows: int) -> Column:
    """Range bucket of ``_h``; there are more of them the more rows there are."""
    buckets = 64
    while buckets * ROWS_PER_BUCKET < rows and buckets < 1 << 20:
        buckets *= 2
    return F.shiftright(F.col("_h"), 64 - buckets.bit_length() + 1).cast("int")


def _requests(shares: DataFrame, open_shards: list[bool], by_size: bool, salt: int) -> DataFrame:
    """For every group and shard the wish to join a weightier share in an open shard.

    The larger share is the weightier one, a hash decides between equals; without ``by_size``
    the hash alone decides, so that shares which only flow one way may meet halfway.
    """
    may = F.element_at(F.array(*[F.lit(o) for o in open_shards]), F.col("to") + 1)
    tie = F.xxhash64("g", "shard", F.lit(salt)).alias("tie")
    weight = F.struct(F.col("n") if by_size else F.lit(0).alias("n"), tie)
    mine = shares.select("g", F.col("shard").alias("from"), "n", weight.alias("w"))
    theirs = shares.select("g", F.col("shard").alias("to"), weight.alias("v"))
    best = Window.partitionBy("g", "from").orderBy(F.col("v").desc())
    return (
        mine.join(theirs, "g")
        .filter((F.col("v") > F.col("w")) & may)
        .withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .select("g", "from", "to", "n", F.xxhash64("g").alias("_h"))
    )


def _way(asked: dict[tuple[int, int], int], start: int, goal: int) -> list[tuple[int, int]] | None:
    """Shortest chain of pairs with something left to move, breadth first."""
    came, queue = {start: None}, [start]
    for at in queue:
        if at == goal:
            way = []
            while came[at] is not None:
                way.append((came[at], at))
                at = came[at]
            return way
        for a, b in sorted(asked):
            if a == at and b not in came and asked[a, b] > 0:
                came[b] = at
                queue.append(b)
    return None


def flows(asked: dict[tuple[int, int], int], spare: list[int]) -> dict[tuple[int, int], int]:
    """Rows granted per pair of shards: no shard takes in more than it gives away and has room for.

    Cycles of requests are used up, shortest first; free room is one more node, which gives to every
    shard. There are at most shards * (shards + 1) pairs, and each cycle uses up one of them.
    """
    outside, total = len(spare), sum(asked.values())
    left = {pair: n for pair, n in asked.items() if n > 0}
    left |= {(s, outside): n for s, n in enumerate(spare) if n > 0}
    left |= {(outside, s): total for s in range(outside)}
    granted = dict.fromkeys(asked, 0)
    while True:
        cycles = []
        for a, b in sorted(asked):
            back = _way(left, b, a) if left.get((a, b), 0) > 0 else None
            if back is not None:
                cycles.append([(a, b), *back])
        if not cycles:
            return granted
        cycle = min(cycles, key=len)
        volume = min(left[pair] for pair in cycle)
        for pair in cycle:
            left[pair] -= volume
            if pair in granted:
                granted[pair] += volume


def propagate(shares: DataFrame, quotas: list[int], patience: int = PATIENCE) -> DataFrame:
    """Move group shares (``g, shard, n``) until their number stops falling."""
    shards = len(quotas)
    open_shards, fewest, idle, salt = [True] * shards, None, 0, 0
    while True:
        figures = shares.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        found = {r["shard"]: r for r in figures.collect()}
        count = sum(r["rows"] for r in found.values())
        idle = 0 if fewest is None or count < fewest else idle + 1
        fewest = count if fewest is None else min(fewest, count)
        if idle >= patience:
            return shares
        spare = [q - (found[s]["n"] if s in found else 0) for s, q in enumerate(quotas)]
        requests = saved(_requests(shares, open_shards, idle == 0, salt))
        per_pair = requests.groupBy("from", "to").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        pairs = per_pair.collect()
        asked = {(r["from"], r["to"]): r["n"] for r in pairs}
        if not asked:
            return shares
        volumes = flows(asked, spare)
        # A shard without room that gives nothing away can take nothing in.
        open_shards = [spare[s] > 0 or any(a == s for a, _ in asked) for s in range(shards)]
        salt += 1
        if not any(volumes.values()):
            continue
        ranked = cumulative(
            requests, [F.col("_h"), F.col("g")], _bucket(sum(r["rows"] for r in pairs)), {"upto": "n"},
            ["from", "to"],
        )
        volume = F.element_at(
            F.array(*[F.lit(volumes.get((a, b), 0)) for a in range(shards) for b in range(shards)]),
            F.col("from") * shards + F.col("to") + 1,
        )
        granted = F.greatest(F.lit(0), F.least(F.col("n"), volume - F.col("upto") + F.col("n")))
        moves = ranked.withColumn("m", granted.cast("long")).filter("m > 0")
        legs = F.explode(
            F.array(
                F.struct(F.col("from").alias("shard"), (-F.col("m")).alias("n")),
                F.struct(F.col("to").alias("shard"), F.col("m").alias("n")),
            )
        )
        changes = moves.select("g", legs.alias("leg")).select("g", "leg.shard", "leg.n")
        shares = saved(
            shares.unionByName(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
        )


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    Row counts of the shards differ by at most one and slots count up from 0 in each. A null text
    is handled as an empty one, and empty texts are equal to each other. Repeated rows, also with
    a null id, each take a slot. An empty table gives an empty result; other columns are not read.
    A group larger than a shard's quota is split; a few more stay cut where sizes do not add up to
    the quotas or no cycle of requests is left.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = saved(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("g"),
        ).withColumn("rid", F.monotonically_increasing_id())
    )
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("copies"))
    rows = saved(
        base.join(groups.filter("copies > 1"), "g", "left")
        .withColumn("linked", F.col("copies").isNotNull())
        .withColumn("_h", F.xxhash64("doc_id", "rid"))
        .drop("copies")
    )
    found = {r["linked"]: r["n"] for r in rows.groupBy("linked").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(found.values())
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    order = [F.col("_h"), F.col("rid")]
    bucket = _bucket(total)
    numbered = saved(global_row_number(rows, order, bucket, "rn", ["linked"]))

    linked = numbered.filter("linked")
    start = linked.groupBy("g", (F.col("rn") % shards).cast("int").alias("shard")).agg(
        F.count(F.lit(1)).alias("n")
    )
    shares = propagate(saved(start), quotas)
    upto = Window.partitionBy("g").orderBy("shard")
    bounds = (
        shares.withColumn("end", F.sum("n").over(upto))
        .groupBy("g")
        .agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("bounds"))
    )
    within = global_row_number(linked, order, bucket, "place", ["g"])
    placed = within.join(bounds, "g").withColumn(
        "shard", F.get(F.filter("bounds", lambda b: b["end"] > F.col("place")), F.lit(0))["shard"]
    )
    loads = {r["shard"]: r["n"] for r in shares.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    free, end = F.lit(shards - 1), total - sum(loads.values())
    for s in reversed(range(shards - 1)):
        end -= quotas[s + 1] - loads.get(s + 1, 0)
        free = F.when(F.col("rn") < end, F.lit(s)).otherwise(free)
    singles = numbered.filter("not linked").withColumn("shard", free)
    columns = ["doc_id", "size", "text_crc32", "shard", "_h", "rid"]
    both = saved(placed.select(*columns).unionByName(singles.select(*columns)))
    return global_row_number(both, order, bucket, "slot", ["shard"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
    )
