"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into symbols: insult, threat, target, negation, report. Insults
are learned: words and word stems that labelled toxic documents hold far more often than others,
each with a log-odds weight; the other classes are closed lists. A clause transducer reads the
symbols and emits weighted matches: an insult or threat alone, aimed at a target, negated, or
reported speech. A logistic model turns a document's matches into a score.

Labels are only read for fitting, from at most about ``TRAIN_ROWS`` labelled documents outside
the held-out fold. A score depends on the text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.common import saved, with_ids

FOLDS, HELD_OUT = 5, 0
# The model is fitted on a hash sample of about so many labelled rows.
TRAIN_ROWS = 20_000
MAX_LEXICON = 5_000
# Stem lengths that are tried besides whole words.
STEMS = (4, 5, 6)
# An insult is at least this many times as frequent, per document, among toxic documents.
MIN_LIFT, MIN_TOXIC = 8.0, 5
MEMO_WORDS = 500_000

# Fixed word lists of the closed classes, in the languages of the corpus.
THREATS = frozenset(
    """kill killing hurt destroy murder stab shoot strangle attack beat burn töten umbringen
    schlagen vernichten tuer tuerai frapper détruire matar golpear destruir mataré""".split()
)
TARGETS = frozenset(
    """you your yours yourself he him his she her they them their these those people du dich dein
    euch ihr ihm sie tu te toi vous ton tes votre ellos ellas ustedes tú usted""".split()
)
NEGATIONS = frozenset(
    """not no never nobody none without isn aren wasn weren don doesn didn nicht kein keine nie
    niemals pas jamais aucun sans nunca jamás ningún sin""".split()
)
REPORTS = frozenset(
    """said says say told called calls wrote quoted quote claimed according sagte nannte schrieb
    dit écrit appelé selon dijo llamó escribió según""".split()
)

INSULT, THREAT, TARGET, NEGATION, REPORT = range(5)
_PIECE = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")

# How far, in words, a negation or a target reaches.
NEGATION_REACH, TARGET_REACH = 3, 6
MATCHES = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "negated threat",
           "reported threat")
FEATURES = 2 * len(MATCHES) + 3


@dataclass
class Lexicon:
    """Weights of insult words and stems."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for size in STEMS:
            if len(word) > size:
                found = max(found, self.stems.get(word[:size], 0.0))
        return found


class Grammar:
    """The lexical transducer composed with the clause transducer."""

    def __init__(self, lexicon: Lexicon):
        self._lexicon = lexicon
        self._memo: dict[str, tuple[int, float] | None] = {}

    def _symbol(self, word: str) -> tuple[int, float] | None:
        if word in THREATS:
            return THREAT, 1.0
        if word in TARGETS:
            return TARGET, 0.0
        if word in NEGATIONS:
            return NEGATION, 0.0
        if word in REPORTS:
            return REPORT, 0.0
        weight = self._lexicon.weight(word)
        return (INSULT, weight) if weight > 0 else None

    def clauses(self, text: str) -> Iterator[list[tuple[int, int, float]]]:
        """Symbols (position, class, weight) of every clause that has an insult or threat."""
        memo, clause, hot = self._memo, [], False
        for at, piece in enumerate(_PIECE.findall(text.lower())):
            if piece in memo:
                symbol = memo[piece]
            elif piece in _ENDS:
                if hot:
                    yield clause
                if clause:
                    clause, hot = [], False
                continue
            else:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                symbol = memo[piece] = self._symbol(piece)
            if symbol is not None:
                clause.append((at, *symbol))
                hot = hot or symbol[0] <= THREAT
        if hot:
            yield clause

    @staticmethod
    def matches(clause: list[tuple[int, int, float]]) -> Iterator[tuple[int, float]]:
        """Match kind (index in ``MATCHES``) and weight of each insult and threat of a clause.

        States are the last negation, the last report and the last target read so far; a target
        that follows soon enough counts as well.
        """
        negated = -NEGATION_REACH - 1
        reported, target = False, -TARGET_REACH - 1
        for i, (at, kind, weight) in enumerate(clause):
            if kind == NEGATION:
                negated = at
            elif kind == REPORT:
                reported = True
            elif kind == TARGET:
                target = at
            else:
                after = next((p for p, k, _ in clause[i + 1 :] if k == TARGET), None)
                aimed = at - target <= TARGET_REACH or (after is not None and after - at <= TARGET_REACH)
                not_meant = at - negated <= NEGATION_REACH
                if kind == INSULT:
                    yield (2 if not_meant else 3 if reported else 1 if aimed else 0), weight
                elif aimed:  # a threat needs somebody it is aimed at
                    yield (5 if not_meant else 6 if reported else 4), weight

    def features(self, text: str | None) -> list[float]:
        """Damped counts and summed weights by kind, the largest weight, and two flags."""
        counts, sums, top = [0] * len(MATCHES), [0.0] * len(MATCHES), 0.0
        for clause in self.clauses(text or ""):
            for kind, weight in self.matches(clause):
                counts[kind] += 1
                sums[kind] += weight
                top = max(top, weight)
        return [
            *(math.log1p(c) for c in counts), *(math.log1p(s) for s in sums), top,
            float(counts[0] + counts[1] > 0), float(sum(counts) > 1),
        ]


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of labelled rows outside the held-out fold, thinned by a hash of the id."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(_fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = known.count()
    if count > limit:
        share = int(limit / count * 1_000_000)
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    known = saved(known)
    texts = with_ids(docs.select("doc_id", "text"), known.select("doc_id"))
    return saved(texts.join(known, "doc_id").select("text", "toxic"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems far more frequent in toxic documents, with their log-odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                words = {w for w in _PIECE.findall((text or "").lower()) if w not in _ENDS}
                stems = {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}
                for entry in words | stems:
                    seen[entry][toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(seen), pa.string()),
                    pa.array([v[0] for v in seen.values()], pa.int64()),
                    pa.array([v[1] for v in seen.values()], pa.int64()),
                ],
                names=["entry", "clean", "toxic"],
            )

    totals = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return Lexicon({}, {})
    lift = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    found = (
        rows.mapInArrow(count, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter((F.col("toxic") >= MIN_TOXIC) & (lift >= MIN_LIFT))
        .orderBy(F.col("toxic").desc(), "clean", "entry")
        .limit(MAX_LEXICON)
        .collect()
    )
    weights = {r["entry"]: math.log((r["toxic"] / toxic) / ((r["clean"] + 0.5) / clean)) for r in found}
    support = {r["entry"]: r["toxic"] for r in found}
    words = {e: w for e, w in weights.items() if not e.endswith("*")}
    stems = {}
    for entry, weight in weights.items():
        if entry.endswith("*"):
            below = [support[w] for w in words if w.startswith(entry[:-1]) and len(w) >= len(entry)]
            # A stem must stand for more than its most frequent word.
            if support[entry] > 1.2 * max(below, default=0):
                stems[entry[:-1]] = weight
    return Lexicon(words, stems)


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    weights: np.ndarray  # last one: bias

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Lexicon and logistic weights from the training rows.

    Without labels of both kinds the model is empty and gives every text the share of toxic
    labels, 0 where there are none.
    """
    rows = training_rows(docs, labels, limit)
    lexicon = learn_lexicon(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                seen[(toxic, *(round(x, 2) for x in grammar.features(text)))] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()),
                pa.array([list(k[1:]) for k in keys], pa.list_(pa.float64())),
                pa.array([seen[k] for k in keys], pa.int64()),
            ],
            names=["toxic", "x", "n"],
        )

    found = (
        rows.mapInArrow(count, "toxic int, x array<double>, n long")
        .groupBy("toxic", "x").agg(F.sum("n").alias("n")).orderBy("toxic", "x").collect()
    )
    y = np.array([r["toxic"] for r in found], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        bias = 30.0 if len(y) and y[0] == 1 else -30.0
        return Model(lexicon, np.zeros(FEATURES), np.append(np.zeros(FEATURES), bias))
    x = np.array([r["x"] for r in found])
    n = np.array([r["n"] for r in found], dtype=np.float64)
    mean = (x * n[:, None]).sum(0) / n.sum()
    design = np.hstack([x - mean, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    ridge = np.append(np.full(FEATURES, 1.0), 1e-6)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (n * (y - p)) - ridge * w
        curve = (design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(ridge)
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, mean, w)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts get the score of a text without matches. The fold of a null id is that
    of the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch["text"].to_pylist()])
            scores = model.score(x.reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.mapInArrow(run, "doc_id long, score double")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return scored.select(
        "doc_id",
        (fold == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
