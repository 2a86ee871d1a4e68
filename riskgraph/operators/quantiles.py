"""Exact quantiles and cumulative counts without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.operators.small import broadcast_when_small
from riskgraph.session import checkpointed

ACCURACY = 10_000
BRACKET_LIMIT = 200_000
# Distinct values ordered in one task; cut points of the first level, and of each cell below it.
BUCKET_ROWS = 100_000
TOP_BUCKETS, SUB_BUCKETS = 64, 4_096
_STRIDE = 64


@dataclass
class _Bracket:
    """Value range known to hold the order statistics of one quantile."""

    column: str
    q: float
    rank: int = 0
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0

    def holds(self) -> Column:
        value = F.col(self.column)
        return value.isNotNull() if self.low is None else value.between(self.low, self.high)


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], limit: int = BRACKET_LIMIT
) -> dict[str, dict[float, float]]:
    """Linearly interpolated quantiles, equal to sorting every column in full.

    Mergeable sketches bracket each quantile, one counting scan places the bracket, and
    only values inside it are ordered. Rounds repeat while a bracket of more than ``limit``
    rows still shrinks; one that does not is ordered in buckets, so neither a task nor the
    driver meets the whole column. Null and NaN are left out.
    """
    return quantiles_and(df, wanted, {}, limit)[0]


def quantiles_and(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    figures: Mapping[str, Column],
    limit: int = BRACKET_LIMIT,
) -> tuple[dict[str, dict[float, float]], dict[str, object]]:
    """``exact_quantiles`` and other aggregates, which ride on the pass that counts and sketches."""
    columns = list(wanted)
    df = nan_as_null(df, columns)
    brackets = [_Bracket(c, q) for c in columns for q in wanted[c]]
    # The ranks are not known yet, so the first marks leave room for rounding them down.
    step = 3.0 / ACCURACY
    sketches = [
        F.percentile_approx(
            c, [m for q in wanted[c] for m in (max(0.0, q - step), min(1.0, q + step))], ACCURACY
        ).alias(f"_s{i}")
        for i, c in enumerate(columns)
        if len(wanted[c])
    ]
    first = df.agg(
        *[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)],
        *sketches,
        *[expr.alias(name) for name, expr in figures.items()],
    ).first()
    counts = {c: first[f"_n{i}"] for i, c in enumerate(columns)}
    guess = {}
    for b in brackets:
        b.inside = counts[b.column]
        b.rank = math.floor(max(b.inside - 1, 0) * b.q)
        if b.inside:
            at = list(wanted[b.column]).index(b.q)
            guess[id(b)] = first[f"_s{columns.index(b.column)}"][2 * at : 2 * at + 2]
    live = [b for b in brackets if b.inside > 0]
    _place(df, [b for b in live if b.inside > limit], guess)
    while _narrow(df, [b for b in live if b.inside > limit and (b.low is None or b.low < b.high)]):
        pass
    found = _order_statistics(df, live, limit)
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for i, b in enumerate(brackets):
        value = None
        if b in live:
            lower, upper = found[live.index(b)]
            share = (counts[b.column] - 1) * b.q - b.rank
            value = lower + (upper - lower) * share
        out[b.column][b.q] = value
    return out, {name: first[name] for name in figures}


def nan_as_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN of floating-point columns counts as missing."""
    types = dict(df.dtypes)
    floats = [c for c in columns if types[c] in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def _narrow(df: DataFrame, wide: list[_Bracket]) -> bool:
    """One round over all wide brackets; False when nothing changed."""
    if not wide:
        return False
    # Quantiles still looking at the same value range share one sketch.
    ranges: dict[tuple, list[_Bracket]] = {}
    for b in wide:
        ranges.setdefault((b.column, b.low, b.high), []).append(b)
    step = 2.0 / ACCURACY
    sketches = []
    for group in ranges.values():
        marks = []
        for b in group:
            share = (b.rank - b.below) / b.inside
            marks += [max(0.0, share - step), min(1.0, share + 1.0 / b.inside + step)]
        values = F.when(group[0].holds(), F.col(group[0].column))
        sketches.append(F.percentile_approx(values, marks, ACCURACY).alias(f"s{len(sketches)}"))
    marked = df.agg(*sketches).first()
    guess = {
        id(b): marked[g][2 * i : 2 * i + 2]
        for g, group in enumerate(ranges.values())
        for i, b in enumerate(group)
    }
    return _place(df, wide, guess)


def _place(df: DataFrame, wide: list[_Bracket], guess: Mapping[int, Sequence[float]]) -> bool:
    """Count below and inside the guessed ranges and take those that hold their rank."""
    if not wide:
        return False
    placed = df.agg(
        *[
            expr
            for i, b in enumerate(wide)
            for expr in (
                F.count_if(F.col(b.column) < F.lit(guess[id(b)][0])).alias(f"b{i}"),
                F.count_if(F.col(b.column).between(*guess[id(b)])).alias(f"n{i}"),
            )
        ]
    ).first()
    changed = False
    for i, b in enumerate(wide):
        below, inside = placed[f"b{i}"], placed[f"n{i}"]
        reaches = below <= b.rank and below + inside >= min(b.rank + 2, b.below + b.inside)
        if reaches and inside < b.inside:
            b.low, b.high = guess[id(b)]
            b.below, b.inside = below, inside
            changed = True
    return changed


def _order_statistics(
    df: DataFrame, live: list[_Bracket], limit: int = BRACKET_LIMIT
) -> dict[int, tuple[float, float]]:
    """Values at rank and rank + 1 of every bracket."""
    if not live:
        return {}
    entries = [
        F.when(
            b.holds(),
            F.struct(F.lit(i).alias("target"), F.col(b.column).cast("double").alias("value")),
        )
        for i, b in enumerate(live)
    ]
    values = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.target", "e.value")
        .count()
    )
    offset = F.element_at(
        F.array(*[F.lit(b.rank - b.below) for b in live]), F.col("target") + 1
    )
    if all(b.inside <= limit or (b.low is not None and b.low == b.high) for b in live):
        order = Window.partitionBy("target").orderBy("value")
        running = values.withColumn("upto", F.sum("count").over(order))
    else:
        # A bracket that sketches cannot narrow further.
        _, values = with_ordered_bucket(checkpointed(values), "value", limit)
        totals = {"upto": "count"}
        running = cumulative(values, [F.col("value")], F.col("_ordered"), totals, ["target"])
    hits = (
        running
        .withColumn("offset", offset)
        .filter(
            (F.col("upto") > F.col("offset"))
            & (F.col("upto") - F.col("count") <= F.col("offset") + 1)
        )
        .groupBy("target")
        .agg(F.sort_array(F.collect_list(F.struct("upto", "value"))).alias("hits"))
        .collect()
    )
    out = {}
    for row in hits:
        b = live[row["target"]]
        want = b.rank - b.below
        lower = next(h["value"] for h in row["hits"] if h["upto"] > want)
        upper = next((h["value"] for h in row["hits"] if h["upto"] > want + 1), lower)
        out[row["target"]] = (lower, upper)
    return out


def range_bounds(df: DataFrame, column: str, buckets: int) -> tuple[int, list[float]]:
    """Row count and approximate equal-count cut points of a column."""
    marks = [i / buckets for i in range(1, buckets)]
    count, cuts = df.agg(
        F.count(column), F.percentile_approx(column, marks, ACCURACY)
    ).first()
    return count, sorted(set(cuts or []))


def with_ordered_bucket(
    df: DataFrame, column: str, bucket_rows: int = BUCKET_ROWS, name: str = "_ordered"
) -> tuple[int, DataFrame]:
    """Row count, and an order-preserving bucket of about ``bucket_rows`` rows if values rarely repeat.

    The first level has at most 64 cut points, sketched over the table; cells of the second
    level are cut by a sketch per first-level cell, into as many parts as the row count asks
    for. The second level's frame has 65 rows of at most 4,096 numbers, so it is broadcast.
    """
    count, cuts = range_bounds(df, column, TOP_BUCKETS)
    if count <= bucket_rows:
        return count, df.withColumn(name, F.lit(0).cast("long"))
    parts = min(SUB_BUCKETS, math.ceil(count / TOP_BUCKETS / bucket_rows))
    value = F.col(column)
    staged = df.withColumn("_top", bucket_of(value, cuts).cast("long"))
    if parts <= 1:
        return count, staged.withColumnRenamed("_top", name)
    marks = [i / parts for i in range(1, parts)]
    subs = staged.groupBy("_top").agg(F.percentile_approx(column, marks, ACCURACY).alias("_cuts"))
    # Every 64th cut first, then the 64 cuts that follow the last of those met.
    strides = F.filter("_cuts", lambda _, i: i % _STRIDE == _STRIDE - 1)
    met = F.size(F.filter("_strides", lambda p: p <= value)) * _STRIDE
    rest = F.slice("_cuts", F.col("_met") + 1, F.lit(_STRIDE))
    sub = F.col("_met") + F.size(F.filter(rest, lambda p: p <= value))
    return count, (
        staged.join(F.broadcast(subs.withColumn("_strides", strides)), "_top")
        .withColumn("_met", F.when(F.col("_cuts").isNull(), 0).otherwise(met))
        .withColumn(name, F.col("_top") * SUB_BUCKETS + F.when(F.col("_cuts").isNull(), 0).otherwise(sub))
        .drop("_top", "_cuts", "_strides", "_met")
    )


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points at or below the value: an order-preserving bucket."""
    if not cuts:
        return F.lit(0)
    points = F.array(*[F.lit(c) for c in cuts])
    return F.size(F.filter(points, lambda p: p <= value))


def cumulative(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    totals: Mapping[str, str],
    within: Sequence[str] = (),
) -> DataFrame:
    """Running totals in a global order, computed bucket by bucket.

    ``bucket`` must not decrease along ``order``. Bucket totals form a frame with one row
    per bucket; only that frame is summed in one task. ``within`` restarts the totals for
    each value of those columns.
    """
    staged = df.withColumn("_bucket", bucket)
    cell = [*within, "_bucket"]
    per_bucket = staged.groupBy(*cell).agg(
        *[F.sum(source).alias(f"_t_{name}") for name, source in totals.items()]
    )
    before = (
        Window.partitionBy(*within)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bucket.select(
        *cell,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
    )
    inner = (
        Window.partitionBy(*cell)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        staged.join(broadcast_when_small(offsets), cell)
        .withColumns(
            {name: F.sum(src).over(inner) + F.col(f"_o_{name}") for name, src in totals.items()}
        )
        .drop("_bucket", *[f"_o_{n}" for n in totals])
    )
