"""Personal data spans by weak supervision.

Four base patterns (email, ip, card, phone) always count. Further candidates are tokens with
digits or ``@`` beside them. Labelers (regular expressions, a gazetteer of key words, context)
vote on every candidate or abstain; expectation-maximisation over the counts of all vote patterns
estimates how reliable each labeler is, and its posteriors train a logistic span classifier whose
positive candidates become spans of kind ``secret``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
EXTRA_KIND = "secret"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind skips starts inside a digit run, which would fail like the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` so that long words cost no second look."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            low = found.end()
            at = text.find("@", low)
        else:
            low = at + 1
            at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans ``start, rank, kind, end`` of the four base kinds, by start and kind."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


# Gazetteer: words that stand before a secret, in the languages of the corpus.
KEYWORDS = frozenset(
    """password passwort kennwort contraseña clave motdepasse passe token secret key apikey api
    pin pwd pass credential auth bearer iban ssn account konto compte cuenta""".split()
)
_PUBLIC = frozenset("version license licence copyright page chapter section article isbn".split())
_TOKEN_EDGE = ".,;:!?()[]{}\"'"
_WORD = re.compile(r"[^\W\d_]+")


def candidates(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit, at least eight characters long, that no base span touches."""
    low, i = 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < low:
            continue
        start, end = m.span()
        while start > low and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        low = end
        token = text[start:end]
        if "=" in token:
            start += token.index("=") + 1
        while start < end and text[start] in _TOKEN_EDGE:
            start += 1
        while end > start and text[end - 1] in _TOKEN_EDGE:
            end -= 1
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        if end - start >= 8 and not (i < len(spans) and spans[i][0] < end):
            yield start, end


_SHAPES = re.compile(r"[A-Z]{4}[A-Z0-9]{12,}|[0-9a-f]{16,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_ORDINARY = re.compile(r"[0-9.,:/%-]+|[^\W\d_]+[0-9]{1,2}|v?[0-9]+(\.[0-9]+)+|https?:.*")


def votes(text: str, start: int, end: int) -> tuple[int, ...]:
    """1 (secret), 0 (not) or -1 (abstains) of each labeler."""
    token = text[start:end]
    before = text[max(0, start - 40) : start]
    words = _WORD.findall(before.lower())
    nearest = words[-1] if words else ""
    digits = sum(c.isdigit() for c in token)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    assigned = before.rstrip(" \"'")[-1:] in ("=", ":")
    return (
        1 if _SHAPES.fullmatch(token) else -1,
        0 if _ORDINARY.fullmatch(token) else -1,
        1 if nearest in KEYWORDS else 0 if nearest in _PUBLIC else -1,
        1 if assigned else -1,
        1 if changes >= 4 else 0 if changes <= 1 else -1,
        1 if 2 <= digits < len(token) else 0,
    )


LABELERS = 6
# Weight of the pull of classifier weights towards 0.
RIDGE = 0.01


def features(text: str, start: int, end: int) -> tuple[int, ...]:
    """Coarse properties of a span for the classifier, each 0 or 1."""
    token = text[start:end]
    before = text[max(0, start - 40) : start]
    words = _WORD.findall(before.lower())
    digits = sum(c.isdigit() for c in token)
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    return (
        1,
        int(len(token) >= 16),
        int(len(token) >= 32),
        int(digits == len(token)),
        int(2 <= digits < len(token)),
        int(changes >= 4),
        int(token.isupper()),
        int(bool(words) and words[-1] in KEYWORDS),
        int(before.rstrip(" \"'")[-1:] in ("=", ":")),
        int(token.isalnum()),
    )


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict, np.ndarray]:
    """Posterior of each vote pattern, and the labelers' accuracies (for yes and no votes)."""
    if not patterns:
        return {}, np.full((LABELERS, 2), 0.8)
    shown = np.array(list(patterns), dtype=np.int64)
    weight = np.array(list(patterns.values()), dtype=np.float64)
    cast = shown >= 0
    # Start from the share of yes votes among the votes cast.
    p = np.where(cast, shown, 0).sum(1) / np.maximum(cast.sum(1), 1)
    p = np.clip(p, 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99)
        log_odds = np.full(len(p), math.log(prior / (1 - prior)))
        right = np.empty((LABELERS, 2))
        for j in range(LABELERS):
            here = cast[:, j]
            yes = shown[here, j]
            w1, w0 = weight[here] * p[here], weight[here] * (1 - p[here])
            # Labelers are taken to be right more often than not, with a weak prior.
            a = np.clip(((w1 * yes).sum() + 4) / (w1.sum() + 5), 0.5, 0.99)
            b = np.clip(((w0 * (1 - yes)).sum() + 4) / (w0.sum() + 5), 0.5, 0.99)
            right[j] = a, b
            log_odds[here] += np.where(
                yes == 1, math.log(a / (1 - b)), math.log((1 - a) / b)
            )
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return {tuple(v): float(x) for v, x in zip(shown.tolist(), p)}, right


def fit_classifier(rows: list[tuple[tuple[int, ...], float, int]], steps: int = 100) -> np.ndarray:
    """Logistic weights from feature patterns with a posterior and a count each."""
    if not rows:
        return np.array([-1.0] + [0.0] * 9)
    x = np.array([r[0] for r in rows], dtype=np.float64)
    y = np.array([r[1] for r in rows])
    n = np.array([r[2] for r in rows], dtype=np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (n * (y - p)) - RIDGE * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame) -> np.ndarray:
    """Classifier weights from the votes on all candidates of all documents.

    Tasks return counts of vote and feature patterns; there are at most 3^6 * 2^9 of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                if text and _DIGITS.search(text):
                    for s, e in candidates(text, base_spans(text)):
                        seen[votes(text, s, e), features(text, s, e)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([list(k[0]) for k in keys], pa.list_(pa.int32())),
                pa.array([list(k[1]) for k in keys], pa.list_(pa.int32())),
                pa.array([seen[k] for k in keys], pa.int64()),
            ],
            names=["votes", "features", "n"],
        )

    rows = (
        docs.select("text")
        .mapInArrow(count, "votes array<int>, features array<int>, n long")
        .groupBy("votes", "features")
        .agg(F.sum("n").alias("n"))
        .orderBy("votes", "features")
        .collect()
    )
    patterns: Counter = Counter()
    for r in rows:
        patterns[tuple(r["votes"])] += r["n"]
    posterior, _ = estimate(dict(patterns))
    return fit_classifier(
        [(tuple(r["features"]), posterior[tuple(r["votes"])], r["n"]) for r in rows]
    )


def all_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, str]]:
    """Base spans and accepted candidates, by start and kind."""
    spans = base_spans(text)
    if not _DIGITS.search(text):
        return spans
    more = [
        (s, e, EXTRA_KIND)
        for s, e in candidates(text, spans)
        if float(np.dot(features(text, s, e), weights)) >= 0
    ]
    order = {kind: i for i, kind in enumerate((*KINDS, EXTRA_KIND))}
    return sorted(spans + more, key=lambda x: (x[0], order[x[2]])) if more else spans


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span (overlapping ones merged) replaced by its kind in brackets."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SPANS = "array<struct<start:long,end:long,kind:string>>"


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """All rows of ``docs`` with ``_spans`` (code points, end exclusive) and ``_redacted``.

    A null text has no spans and stays null. Repeated rows get equal results. ``weights`` are
    fitted on ``docs`` when not given. Existing columns named ``_spans`` or ``_redacted`` are
    replaced.
    """
    weights = train(docs) if weights is None else weights
    docs = docs.drop("_spans", "_redacted")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields])
    schema = schema.add("_spans", T._parse_datatype_string(SPANS)).add("_redacted", T.StringType())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, clean = [], []
            for text in batch["text"].to_pylist():
                found = all_spans(text, weights) if text else []
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
                clean.append(redact(text, found) if found else text)
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), pa.array(spans, kind), pa.array(clean, pa.string())],
                names=[*names, "_spans", "_redacted"],
            )

    return docs.mapInArrow(run, schema)
