"""Conversation repair against brute force, in blocks, and on awkward rows."""

import hashlib
import random
import re
import zlib

import pytest
from conftest import SF
from pyspark.sql import types as T

from riskgraph.llm import catalog, turns

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        # Clashing names.
        T.StructField("blank", T.StringType()), T.StructField("_fault", T.LongType()),
    ]
)
GOOD = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    """Cheapest (cost, audit) over all edits of rows (initial, removed, truncated), and its roles."""
    best = [(3 * len(rows), "D" * len(rows), ())]

    def go(at, cost, audit, roles):
        if cost > best[0][0] or roles.endswith(("aa", "uu", "ss", "sa", "us", "as")):
            return
        if at == len(rows):
            if GOOD.fullmatch(roles) and (cost, audit) < best[0][:2]:
                best[0] = (cost, audit, roles)
        for role in "ua":
            if len(audit) < 2 * len(rows) + 3:
                go(at, cost + 2, audit + "I", roles + role)
        if at == len(rows):
            return
        initial, removed, truncated = rows[at]
        go(at + 1, cost + 3, audit + "D", roles)
        if not removed:
            if initial in ("s", "u", "a"):
                go(at + 1, cost + truncated, audit + "K", roles + initial)
            for role in "ua":
                go(at + 1, cost + 2 + truncated, audit + "R", roles + role)

    go(0, 0, "", "")
    return best[0][:2]


def random_turns(rng, n):
    return [
        turns.Turn(rng.choice(["s", "u", "a", "a", "u", "x", ""]), rng.random() < 0.2, rng.random() < 0.3)
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed", range(150))
def test_search_equals_brute_force(seed):
    rng = random.Random(seed)
    rows = random_turns(rng, rng.randrange(0, 6))
    assert turns.search(rows, turns.START, turns.ENDS) == brute(rows)


def solve(rows, block, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK_TURNS", block)
    repairer = turns.Repairer()
    for k, row in enumerate(rows):
        role = {"s": "system", "u": "user", "a": "assistant"}.get(row.initial, row.initial)
        repairer.add(role, f"text {k}", row.removed, row.truncated)
    return repairer.result()


@pytest.mark.parametrize("seed", range(20))
def test_blocks_give_the_whole_repair(seed, monkeypatch):
    rng = random.Random(seed)
    rows = random_turns(rng, rng.randrange(1, 60))
    whole = solve(rows, 1000, monkeypatch)
    assert all(solve(rows, block, monkeypatch) == whole for block in (1, 2, 7, 30))


@pytest.mark.parametrize("pattern", ["u", "a", "s", "x", "ua", "uua", "sua", "aas", "ux"])
def test_search_stays_small(pattern, monkeypatch):
    """Patterns with many equally cheap repairs; the dominance tables keep the search near linear."""
    rows = [turns.Turn(pattern[k % len(pattern)], k % 5 == 0, k % 3 == 0) for k in range(256)]
    looked = []
    monkeypatch.setattr(turns, "edits", lambda t, p, f=turns.edits: looked.append(1) or f(t, p))
    found = turns.search(rows, turns.START, turns.ENDS)
    assert found is not None and len(looked) < 40 * len(rows)


def expected(rows):
    """The query's rows for (conv_id, turn, role, text), by plain Python."""
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        conversations[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, said in conversations.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, marked = set(), [0, 0, 0], []
        for _, role, text in said:
            bare = text.strip(SPACES)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                kinds[fault] += 1
            marked.append(turns.Turn(role[:1], fault in (0, 1), fault == 2))
        known = [t for t, _, _ in said if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:])]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        cost, audit = brute(marked)
        lines, place, at = [], "a", 0
        for edit in audit:
            wanted = "user" if place != "u" else "assistant"
            role, text = ("", "") if edit == "I" else said[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            role = role if edit == "K" else wanted
            lines.append(f"{role}:{text}")
            place = role[0]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *kinds, illegal, cost, audit, digest)
    return out


def awkward():
    rng = random.Random(3)
    texts = ["Yes.", "no", "", " \n", None, "Why?\t", "ends ", "\u0085", "é!", "x" * 50_000, "Yes."]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", "system", None, "", "tool"])
            rows.append((conv, rng.choice([turn, None, turn, 7]), role, rng.choice(texts)))
    return rows + rows[:3]


def got(df):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_awkward_rows_equal_plain_python(spark):
    rows = awkward()
    frame = spark.createDataFrame([(*r, "b", 1) for r in rows], TURNS)
    found = turns.repair_damaged(frame)
    assert found.count() == len({r[0] for r in rows}) and got(found) == expected(rows)
    assert turns.repair_damaged(frame.limit(0)).count() == 0


def test_a_conversation_without_rows_after_damage(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turns.repair_damaged(spark.createDataFrame([(conv, 0, "user", "Hi.", None, None)], TURNS)).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_equals_plain_python_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(catalog.QUERIES["op11_conversation_repair"](spark, SF)) == expected(rows)
