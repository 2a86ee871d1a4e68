"""Conversation structure repair by depth-first branch and bound.

A conversation is brought to the role pattern ``(s?(ua)+)?`` (system, user, assistant) by keeping,
re-roling, deleting and inserting turns at least cost; among equally cheap repairs the one whose
audit string (initials of the edits in order) is ASCII-least is taken.

A search node is (turns decided, place in the pattern). The search holds an explicit stack,
prunes by a suffix lower bound (least cost of the remaining turns from that place, whatever the audit)
against the incumbent ``(cost, audit)``, and keeps for every node the best ``(cost, audit)`` that
reached it: a later prefix that is not better is dropped. Equal audits give equal repairs, and an
audit of the same turns is never a proper prefix of another one of equal cost, so a better prefix
stays better whatever follows. For the same reason long conversations can be searched in blocks:
a block is solved from every place in which it can begin to every place in which it can end, and
the blocks' repairs are joined. A task holds one block and, for each place, its audit so far.
"""

from __future__ import annotations

import hashlib
import math
import os.path
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.bpe import slices

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Turns that are searched at once; longer conversations are joined from blocks.
BLOCK_TURNS = 256

# Places in the pattern: nothing yet, after the system turn, after a user, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = range(4)
ENDS = (START, ASSISTANT)
# Place after a turn with the initial; missing entries leave the pattern.
STEP = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
# Role that a new or re-roled turn must have at each place.
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}


class Turn(NamedTuple):
    initial: str
    removed: bool  # blank or duplicate: must be deleted
    truncated: bool


Repair = tuple[int, str]


def edits(turn: Turn, place: int) -> list[tuple[str, int, int]]:
    """Edits of a turn at a place as (initial, cost, next place)."""
    out = [("D", DELETE, place)]
    if not turn.removed:
        after = STEP.get((place, turn.initial))
        if after is not None:
            out.append(("K", TRUNCATED * turn.truncated, after))
        wanted = STEP[place, WANTED[place][0]]
        out.append(("R", REROLE + TRUNCATED * turn.truncated, wanted))
    return out


def _with_inserts(costs: list[float]) -> list[float]:
    """Costs by place when turns may be inserted first; three lead to every place within reach."""
    for _ in range(3):
        costs = [min(costs[p], INSERT + costs[STEP[p, WANTED[p][0]]]) for p in PLACES]
    return costs


def suffix_bounds(turns: Sequence[Turn], ends: Sequence[int]) -> list[list[float]]:
    """Lower bound of the cost of the turns from each one on, by place, when it must stop at ``ends``.

    Audits play no part in it, so ties are left to the search. Infinite where no end can be reached.
    """
    bounds = [_with_inserts([0 if p in ends else math.inf for p in PLACES])]
    for turn in reversed(turns):
        after = bounds[-1]
        bounds.append(
            _with_inserts([min(cost + after[to] for _, cost, to in edits(turn, p)) for p in PLACES])
        )
    return bounds[::-1]


def search(
    turns: Sequence[Turn], start: int, ends: Sequence[int], bounds: list[list[float]] | None = None
) -> Repair | None:
    """Cheapest ``(cost, audit)`` from a place to one of ``ends``, ASCII-least among equals.

    None where no edits lead there.
    """
    bounds = bounds or suffix_bounds(turns, ends)
    n = len(turns)
    if bounds[0][start] == math.inf:
        return None
    incumbent: Repair | None = None
    # Best prefix that reached each node.
    table: dict[tuple[int, int], Repair] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, place, cost, audit = stack.pop()
        known = table.get((at, place))
        if known is not None and known <= (cost, audit):
            continue
        least = cost + bounds[at][place]
        if incumbent is not None and (
            least > incumbent[0] or least == incumbent[0] and audit > incumbent[1][: len(audit)]
        ):
            continue
        table[at, place] = (cost, audit)
        if at == n and place in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        children = [(cost + INSERT, audit + "I", at, STEP[place, WANTED[place][0]])]
        if at < n:
            children += [(cost + c, audit + e, at + 1, to) for e, c, to in edits(turns[at], place)]
        # The child with the least bound, then the least audit, is looked at first.
        children.sort(key=lambda c: (c[0] + bounds[c[2]][c[3]], c[1]), reverse=True)
        stack += [(i, to, c, a) for c, a, i, to in children]
    return incumbent


def apply(audit: str, place: int, rows: Sequence[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Repaired ``(role, text)`` turns of an audit that begins at a place."""
    at = 0
    for edit in audit:
        if edit == "I":
            role, text = WANTED[place], ""
        else:
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = WANTED[place]
        place = STEP[place, role[:1]]
        yield role, text


class _Path(NamedTuple):
    """A repair of the turns so far: cost, audit, whether it has turns, and the hash over them."""

    cost: int
    audit: str
    begun: bool
    hash: object

    def extended(self, audit: str, repair: Repair, place: int, rows: Sequence[tuple[str, str]]) -> _Path:
        digest, begun = self.hash.copy(), self.begun
        for role, text in apply(repair[1], place, rows):
            digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
            begun = True
        return _Path(self.cost + repair[0], audit, begun, digest)


class Repairer:
    """Repairs one conversation whose turns arrive in order."""

    def __init__(self) -> None:
        self.paths: dict[int, _Path] = {START: _Path(0, "", False, hashlib.sha256())}
        # Parts of the audit that all paths share; the paths hold what follows.
        self.settled: list[str] = []
        self.turns: list[Turn] = []
        self.rows: list[tuple[str, str]] = []

    def add(self, role: str, text: str, removed: bool, truncated: bool) -> None:
        if len(self.turns) == BLOCK_TURNS:
            self._close([(place,) for place in PLACES])
        self.turns.append(Turn(role[:1], removed, truncated))
        # Removed turns never show up again; their texts need not be held.
        self.rows.append((role, "" if removed else text))

    def _close(self, goals: Sequence[tuple[int, ...]]) -> None:
        """Join the block's repairs to the paths, one path for each goal that can be reached."""
        bounds = {goal: suffix_bounds(self.turns, goal) for goal in goals}
        best: dict[int, tuple[int, str, int, Repair]] = {}
        for place, path in self.paths.items():
            for goal in goals:
                repair = search(self.turns, place, goal, bounds[goal])
                if repair is None:
                    continue
                found = (path.cost + repair[0], path.audit + repair[1], place, repair)
                if goal[0] not in best or found[:2] < best[goal[0]][:2]:
                    best[goal[0]] = found
        shared = os.path.commonprefix([audit for _, audit, _, _ in best.values()])
        self.settled.append(shared)
        self.paths = {
            end: self.paths[place].extended(audit[len(shared) :], repair, place, self.rows)
            for end, (_, audit, place, repair) in best.items()
        }
        self.turns, self.rows = [], []

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the repaired turns."""
        self._close([ENDS])
        path = self.paths[ENDS[0]]
        return path.cost, "".join(self.settled) + path.audit, path.hash.hexdigest()


# Fixed by the contract: white space, and what ends a sentence.
_BLANK = r"\A[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults dealt by ``crc32(conv_id:turn) % 20``.

    0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes it
    a user turn. Nulls count as one space. Rows with the same conversation and turn share a fault.
    """
    space = F.lit(" ")
    key = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    )
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    dealt = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("_fault"))
    return dealt.filter("_fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "")
        .when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def faults(turns: DataFrame) -> DataFrame:
    """Rows with their first fault: ``blank``, ``duplicate`` (an earlier row says the same) or ``truncated``."""
    said = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    blank = F.col("text").rlike(_BLANK)
    again = ~blank & (F.row_number().over(said) > 1)
    return turns.withColumns({"blank": blank, "duplicate": again}).withColumn(
        "truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.col("text").rlike(_ENDED)
    )


_REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired_sha256 string"
)


class _Conversation:
    """Counts and repair of one conversation whose rows arrive by turn."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.repair = conv_id, Repairer()
        self.least = self.most = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = None

    def add(self, turn, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.distinct = turn, self.distinct + 1
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        self.repair.add(role, text, blank or duplicate, truncated)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv_id, *counts, *self.repair.result())


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: counts of its faults, cheapest edits and the repaired turns' hash.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored, whatever their names.
    Null roles and texts count as one space, a null turn comes first, rows without a conversation
    form one of their own. Rows of one turn are ordered by role and text; equal rows are copies,
    of which all but the first are duplicates. Counts: ``gaps`` in the turn numbers; ``blank``,
    ``duplicate`` and ``truncated`` rows by their first fault; ``illegal`` neighbouring roles.
    Texts may be of any length; an empty table gives no rows. A conversation's rows meet in one
    task, sorted by Spark, as its hash runs over them in order; the task holds one block of them.
    """
    text = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text)
    # One shuffle: the window and the order by turn find the conversations together.
    ordered = faults(rows.repartition("conv_id")).sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "duplicate"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def packed() -> pa.RecordBatch:
            columns = zip(*done) if done else [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            names = [part.split()[0] for part in _REPAIRED.split(",")]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in (part for whole in batches for part in slices(whole, "text")):
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(*row)
            if done:
                yield packed()
                done = []
        if now is not None:
            done.append(now.row())
        yield packed()

    columns = ["conv_id", "turn", "role", "text", "blank", "duplicate", "truncated"]
    return ordered.select(*columns).mapInArrow(run, _REPAIRED)


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Damage and repair every conversation; one without rows after damage has zeros and no turns."""
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    repaired = repair(damage(turns))
    ids = turns.select("conv_id").distinct()
    joined = ids.alias("i").join(repaired.alias("r"), F.expr("i.conv_id <=> r.conv_id"), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "i.conv_id",
        *[F.coalesce(f"r.{c}", F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("r.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
