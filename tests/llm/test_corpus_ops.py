"""Corpus operators against brute force on a small table of awkward rows, and on empty tables."""

from collections import Counter
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from conftest import SF

from llm.conftest import corpus, words  # noqa: F401
from riskgraph.llm import (
    bpe, chat, decontaminate, jaccard, pii, quality, sharding, substring, toxicity, warc,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- byte-level BPE -------------------------------------------------------------------------


def test_bpe_equals_the_library(docs):
    codec = bpe._codec(bpe._rank_bytes(RANKS), public_tokenizers.PATTERN)
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert len(back) == len(corpus())
    for row in back:
        text = row["text"] or ""
        assert row["ids"] == codec.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


@pytest.mark.parametrize("piece", ["a ", "don't 12,3\n", "  \n x", "é!? ", "中文 字", "'s'll "])
def test_bpe_cuts_long_texts_safely(piece):
    codec = bpe._codec(bpe._rank_bytes(RANKS), public_tokenizers.PATTERN)
    text = piece * 500
    parts = list(bpe.blocks(text, 100))
    assert "".join(parts) == text
    assert [i for p in parts for i in codec.encode_ordinary(p)] == codec.encode_ordinary(text)


# --- substring dedup ------------------------------------------------------------------------


def brute_dedup(rows, window):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in texts:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_runs", [500, 1])
def test_dedup_equals_brute_force(docs, monkeypatch, shard_runs):
    monkeypatch.setattr(substring, "SHARD_RUNS", shard_runs)
    want = brute_dedup([r[:2] for r in corpus()], substring.WINDOW)
    assert rows_of(substring.dedup(docs)) == want
    assert any(r[2] for r in want)


def test_dedup_of_random_cuts(spark):
    import random

    random.seed(3)
    pool = [random.choices("abcdefgh", k=200) for _ in range(3)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(random.randrange(1, 4)):
            source, at = random.choice(pool), random.randrange(150)
            text += source[at : at + random.randrange(20, 120)]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring.dedup(df)) == brute_dedup(rows, substring.WINDOW)


# --- chat -----------------------------------------------------------------------------------

TEXTS = ["", "hi", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\INST]", "a\n<s>", "[", "<", "\\"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("role", ["user", "assistant", "", "[INST]", "<s>\\"])
def test_turns_read_back(text, role):
    piece, low, high = chat.format_turn(role, text)
    parser = chat.Parser()
    got = [t for c in piece for t in parser.feed(c)] if len(piece) < 3 else list(parser.feed(piece))
    parser.finish()
    assert got == [(role, text)]
    assert chat.unescape(piece[low:high]) == text


def test_conversations(spark):
    turns = [(1, 0, "user", a) for a in TEXTS] + [(1, 1, "assistant", b) for b in TEXTS]
    turns += [(None, 1, None, None), (2, None, "assistant", "x"), (2, None, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    said = sorted(t for t in TEXTS)
    whole = "".join(f"user\n{t}\n" for t in said) + "".join(f"assistant\n{t}\n" for t in said)
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest()
    assert (got[None]["n_turns"], got[None]["loss_chars"], got[2]["loss_chars"]) == (1, 0, 2)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# --- personal data --------------------------------------------------------------------------


def brute_base(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(found)]


def test_base_spans_equal_the_patterns():
    import random

    random.seed(5)
    samples = [
        "a@b.c d@e @f.g x@@y.z a@b.c@d.e é@b.c", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3.",
        "4111 1111 1111 1111, 4111-1111-1111-1111-2 40418949746087950", "+1 (988) 555-2485 +12",
        "+1 2 3 4 5 6 7 8 9 0 +49.30.123456-78", "",
    ]
    samples += ["".join(random.choices("ab1234.@-+ ()é%", k=60)) for _ in range(400)]
    for text in samples:
        assert pii.base_spans(text) == brute_base(text), text


def test_pii_spans(spark, docs, empty):
    texts = [
        (i, f"{words(i, 8)} password=b7db7aa4a5fcc78{i % 10}05e x, token = \"1beb58b8af68854f0e01\"")
        for i in range(40)
    ] + [(90, "mail a@b.example now"), (91, None), (92, "version 2024.11 of 12345678")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert [s["kind"] for s in got[3]["_spans"]] == ["secret", "secret"]
    assert "b7db" not in got[3]["_redacted"]
    assert got[90]["_redacted"] == "mail [EMAIL] now" and got[91]["_redacted"] is None
    assert got[92]["_spans"] == []
    assert pii.find(docs).count() == len(corpus()) and pii.find(empty).count() == 0


# --- WARC -----------------------------------------------------------------------------------


def test_archives_read_back(spark):
    long = "<p>" + "text é " * 60
    pages = [(i, f"http://x/{i}\r\n", f"{long}{i % 5}") for i in range(50)]
    pages += [(60, None, None), (61, "u", "short"), (62, "u", "short"), (None, "u", long + "0")]
    pages += [(3, "again", f"{long}3")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    first = {}
    for page, _, html in pages:
        if html and len(html.encode()) >= 100 and page is not None:
            first[html] = min(page, first.get(html, page))
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        keep = first.get(html)
        again = keep is not None and page != keep
        want.append((page, len(data), hashlib.sha256(data).hexdigest(),
                     "revisit" if again else "response", keep if again else None))
    got = warc.round_trip(df).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    assert rows_of(got) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


# --- n-gram Jaccard -------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        n = min(5, len(w))
        sets.append((i, {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for b, (j, t) in enumerate(sets[:a]):
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), None if i is None else least[find(a)]) for a, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("pair_rows", [12, 2])
def test_components_equal_brute_force(spark, docs, monkeypatch, pair_rows):
    monkeypatch.setattr(jaccard, "PAIR_ROWS", pair_rows)
    assert rows_of(jaccard.near_duplicates(docs)) == brute_components([r[:2] for r in corpus()])


def test_components_of_chains(spark):
    """Long columns whose rows need more than their pivot to be linked."""
    import random

    random.seed(9)
    text = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(70):
        own = list(text)
        for _ in range(random.randrange(5)):
            own[random.randrange(80)] = f"e{random.randrange(30)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.near_duplicates(df)) == brute_components(rows)


def test_signatures_never_overstate_a_difference():
    random = np.random.default_rng(3)
    for _ in range(200):
        pool = random.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(random.choice(pool, random.integers(1, 300), replace=False)) for _ in "ab")
        bits = jaccard.signature(a) ^ jaccard.signature(b)
        differ = int(np.unpackbits(bits.view(np.uint8)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_rows_that_pivots_leave_apart_still_meet(spark, monkeypatch):
    """A chain of near copies: each links only with its neighbours, whatever pivot is chosen."""
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    words = [f"w{i}" for i in range(60)]
    rows = [(j, " ".join(words[:50] + [f"x{j}"] * (j % 7) + words[50 + j % 9 :])) for j in range(40)]
    rows += [(100 + j, " ".join([f"y{j + i}" for i in range(60)])) for j in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.near_duplicates(df)) == brute_components(rows)


# --- decontamination ------------------------------------------------------------------------


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    import random

    random.seed(11)
    items = [(i, words(i + 20, 5 + 3 * i)) for i in range(15)] + [(99, None), (98, "too short")]
    rows = [(0, None), (1, ""), (None, items[9][1].upper())]
    for i in range(2, 120):
        w = items[i % 15][1].split()
        for _ in range(random.randrange(0, 2 + len(w) // 4)):
            at = random.randrange(len(w))
            w[at : at + random.randrange(2)] = [f"new{i}"] * random.randrange(2)
        rows.append((i, f"{words(i, 9)} {' '.join(w)}\n{words(i + 1, 9)}"))
    want = set()
    for d, t in rows:
        for i, item in items:
            a, b = WORD.findall((item or "").lower()), WORD.findall((t or "").lower())
            if len(a) >= 5 and brute_distance(a, b) <= len(a) // 5:
                want.add((d, i, brute_distance(a, b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and (None, 9, 0) in got
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


# --- toxicity -------------------------------------------------------------------------------


def test_grammar_tells_context():
    grammar = toxicity.Grammar(toxicity.Lexicon({"idiot": 3.0}, {"zorb": 2.0}))
    kind = lambda t: [toxicity.MATCHES[k] for c in grammar.clauses(t) for k, _ in grammar.matches(c)]
    assert kind("You idiot. Fine day.") == ["aimed insult"]
    assert kind("not an idiot") == ["negated insult"]
    assert kind("She said: idiot") == ["insult"]
    assert kind("somebody said idiot") == ["reported insult"]
    assert kind("zorbling went") == ["insult"]
    assert kind("I will kill you") == ["threat"] and kind("kill time") == []
    assert kind("") == []


def test_toxicity_held_out(spark, docs, empty):
    table = lambda n: spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{n}.parquet")
    model = toxicity.fit(table("documents"), table("labels"))
    scored = toxicity.score(table("documents"), model).join(table("labels"), "doc_id")
    count = Counter((r["toxic"], r["predicted"]) for r in scored.filter("held_out").collect())
    assert count[0, 0] >= 0.99 * (count[0, 0] + count[0, 1])
    assert count[1, 1] >= 0.85 * (count[1, 0] + count[1, 1])
    assert toxicity.score(docs, model).count() == len(corpus())
    assert toxicity.score(docs, toxicity.fit(empty, table("labels").limit(0))).count() == len(corpus())


# --- quality --------------------------------------------------------------------------------


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs, labels)
    got = judged.select("doc_id", "text", "_quality.*").collect()
    assert len(got) == len(corpus())
    for r in got:
        have = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert have == brute_stats(r["text"]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"])  # three labels certify nothing
    assert quality.judge(empty, labels).count() == 0


@pytest.mark.parametrize("k,n,p", [(0, 100, 0.01), (3, 900, 0.01), (40, 9000, 0.01), (5, 20, 0.5)])
def test_binomial_tail(spark, k, n, p):
    from math import comb

    from pyspark.sql import functions as F

    want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), F.lit(p))).first()[0]
    assert got == pytest.approx(want, rel=1e-6)


def test_certified_rules_reject_junk_only(spark):
    rows, labels = [], []
    for i in range(6000):
        good = i % 4 != 0
        body = [f"w{(i * 31 + j * 17) % 5003}" for j in range(60)]
        rows.append((i, " ".join(body if good else [f"{x} |" for x in body]), "en"))
        labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = quality.judge(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r["doc_id"] for r in judged.filter("_quality.kept").select("doc_id").collect()}
    assert kept == {i for i, good in labels if good}


# --- sharding -------------------------------------------------------------------------------


@pytest.mark.parametrize("copies", [0, 40, 700])
def test_shards_are_even_and_keep_groups(spark, copies):
    rows = [(i, f"text {i % 300 if i < 400 else i}") for i in range(1000)]
    rows += [(2000 + i, "hot") for i in range(copies)] + [(None, None), (5, "text 5"), (5, "text 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    by = {}
    for r in got:
        by.setdefault(r["text_crc32"], Counter())[r["shard"]] += 1
    cut = sum(len(c) > 1 for c in by.values())
    assert cut <= 3 + 8 * (copies > 100)


def test_sharding_of_nothing(empty):
    assert sharding.assign(empty).count() == 0
