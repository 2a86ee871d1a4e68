"""Quality rules whose cutoffs are certified on labelled holdouts, per language.

Each rule rejects a document when a share (symbols, repeated lines and so on) exceeds a cutoff.
One half of the labelled documents proposes a cutoff for every stratum and rule; the other half
tests it: the proposal stands only if an exact binomial test rejects "more than ``risk / rules``
of the good documents are rejected" at level ``delta`` divided by the number of tests (Bonferroni
over strata and rules). With probability 1 - ``delta`` no stratum then loses more than ``risk`` of
its good documents to the rules. Few labels certify nothing and reject nothing.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.common import SPACES, saved, unwrapped, with_ids, wrapped
from riskgraph.operators.small import broadcast_when_small

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS, MARKS = "#*$%&|<>", "!?"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rule name: count above the bar and what it is a share of.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "marks": ("n_marks", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
}
# Cutoffs that may be proposed, in ten-thousandths, lenient first.
CUTS = [5000, 3500, 2500, 1800, 1250, 900, 625, 450, 310, 220, 160, 110]
RISK, DELTA = 0.05, 0.05
# A proposal must reject more than this many bad documents for each good one.
EXCHANGE = 5
# Terms of the binomial tail that are summed; what lies below them is bounded from above.
TAIL_TERMS = 2000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur at least twice in the array."""

    def windows(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return F.sort_array(
            F.transform(
                heads,
                lambda a, i: F.struct(
                    F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")
                ),
            )
        )

    def repeated(s: Column) -> Column:
        same = F.lit(False)
        return F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], same)
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], same),
        )

    def covered(s: Column) -> Column:
        places = F.sort_array(F.transform(s, lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(
            places,
            start,
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")
            ),
            lambda a: a["n"],
        )

    return _let(words, lambda w: _let(windows(w), lambda s: covered(repeated(s))))


def with_stats(docs: DataFrame) -> DataFrame:
    """Add ``_stats`` (a struct of counts over the whole text); a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = F.lit(SPACES)
    trimmed = F.btrim(text, spaces)
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WORD_GAP)
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, spaces) != "")

    # One pass leaves only the characters that are counted; the counts then read short strings.
    few = F.regexp_replace(text, f"[^{CAPITALS}{MARKS}{SYMBOLS}]+", "")

    def counts(f: Column) -> Column:
        def number(chars: str) -> Column:
            return (F.length(f) - F.length(F.translate(f, chars, ""))).cast("long")

        return F.struct(
            number(SYMBOLS).alias("n_symbols"),
            number(MARKS).alias("n_marks"),
            number(CAPITALS).alias("n_capitals"),
        )

    stats = F.struct(
        _let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
            ),
        ).alias("w"),
        _let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("l"),
        _let(few, counts).alias("c"),
    )
    return docs.withColumn("_stats", stats)


# Part of ``_stats`` that holds each count.
_PART = {
    "n_words": "w", "word_chars": "w", "n_symbols": "c", "n_dup_lines": "l", "n_repeat_words": "w",
    "n_lines": "l", "n_marks": "c", "n_capitals": "c",
}


def _count(name: str) -> Column:
    return F.col(f"_stats.{_PART[name]}.{name}")


def _flat() -> list[Column]:
    return [_count(name).alias(name) for name in _PART]


def _stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def _log_factorial(x: Column) -> Column:
    """Exact sum of logarithms up to 255, the Stirling series beyond."""
    x = x.cast("double")
    exact = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(x, F.lit(255.0)).cast("int"), F.lit(1))),
        F.lit(0.0),
        lambda a, i: a + F.log(i.cast("double")),
    )
    series = (
        x * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586) * x)
        + 1 / (12 * x) - 1 / (360 * x * x * x)
    )
    return F.when(x < 256, exact).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) and k < n * p; 1 where k is not below n * p.

    Terms are added from k downwards; what lies below ``TAIL_TERMS`` terms is replaced by its
    geometric bound, so the result is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    top = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * F.log(p) + (n - k) * F.log(1 - p)
    )
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(TAIL_TERMS))).cast("int"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(a: Column, i: Column) -> Column:
        below = (k - i) * (1 - p) / ((n - k + i + 1) * p)
        return F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * below).alias("term"))

    first = k * (1 - p) / ((n - k + 1) * p)
    whole = F.aggregate(steps, start, add, lambda a: a["sum"] + a["term"] / (1 - first))
    return F.when(k < n * p, F.least(F.exp(top) * whole, F.lit(1.0))).otherwise(F.lit(1.0))


def _truth(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").alias("_id"), F.col("quality").alias("_good")
    )


def certified_cutoffs(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """``stratum`` and one certified cutoff (ten-thousandths, null: rule off) per rule.

    ``measured`` holds ``doc_id``, ``lang`` and ``_stats`` of the labelled documents at least.
    Every label row with a quality of 0 or 1 and a matching document counts once.
    """
    truth = _truth(labels)
    counted = measured.select("doc_id", _stratum().alias("stratum"), *_flat())

    def level(rule: str) -> Column:
        """Number of cutoffs that the document exceeds: it fails at that many strictest ones."""
        over, of = RULES[rule]
        hits = [(F.lit(10000) * F.col(over) > F.lit(c) * F.col(of)).cast("int") for c in CUTS]
        return sum(hits[1:], hits[0])

    proposing = F.crc32(F.col("_id").cast("string").cast("binary")) % 2 == 0
    entries = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), level(r).alias("level")) for r in RULES])
    )
    counts = (
        counted.join(truth, F.col("doc_id") == F.col("_id"))
        .select("stratum", "_good", proposing.alias("proposing"), entries.alias("e"))
        .groupBy("stratum", "e.rule", "e.level")
        .agg(
            F.count_if(F.col("proposing") & (F.col("_good") == 1)).alias("good_a"),
            F.count_if(F.col("proposing") & (F.col("_good") == 0)).alias("bad_a"),
            F.count_if(~F.col("proposing") & (F.col("_good") == 1)).alias("good_b"),
        )
    )
    # From here on a few rows per stratum: counts of documents beyond each cutoff.
    counts = saved(counts)
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(CUTS)))).alias("step")
    grid = counts.select("stratum", "rule", "level", "good_a", "bad_a", "good_b", steps)
    reached = F.col("level") >= F.lit(len(CUTS) + 1) - F.col("step")
    totals = grid.groupBy("stratum", "rule", "step").agg(
        F.sum("good_b").alias("n"),
        F.sum(F.when(reached, F.col("good_a")).otherwise(0)).alias("lost"),
        F.sum(F.when(reached, F.col("bad_a")).otherwise(0)).alias("caught"),
        F.sum(F.when(reached, F.col("good_b")).otherwise(0)).alias("k"),
    )
    gain = F.col("caught") - F.lit(EXCHANGE) * F.col("lost")
    best = Window.partitionBy("stratum", "rule").orderBy(F.col("gain").desc(), "step")
    strata = totals.agg(F.count_distinct("stratum").alias("strata"))
    share = F.lit(risk / len(RULES))
    allowed = F.lit(delta) / (F.col("strata") * F.lit(len(RULES)))
    proposed = (
        totals.withColumn("gain", gain)
        .withColumn("place", F.row_number().over(best))
        .filter("place = 1 and gain > 0")
        .join(F.broadcast(strata))  # one row
        .withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), share))
        .filter(F.col("p_value") <= allowed)
        .withColumn("cut", F.element_at(F.array(*map(F.lit, CUTS)), F.col("step")))
    )
    return proposed.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES]
    )


def judge(
    docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_quality``: counts, ``base_failed`` and ``kept``.

    Every row gets a verdict, repeated rows the same one. Null or empty texts have no words and
    fail the base. A null language is a stratum of its own, as is a table without ``lang``. Texts
    may be of any length; other columns may have any names, and one called ``_quality`` is
    replaced. Labelled texts are measured a second
    time; ``judge_measured`` on a saved table of counts measures each text once.
    """
    ids = _truth(labels).select(F.col("_id").alias("doc_id")).distinct()
    plain = wrapped(docs, "doc_id", "text", "lang")
    labelled = with_stats(with_ids(plain.select("doc_id", "text", "lang"), ids))
    cuts = certified_cutoffs(labelled, labels, risk, delta)
    judged = _with_verdicts(with_stats(plain), cuts, plain.columns)
    return unwrapped(judged, [c for c in docs.columns if c != "_quality"], "_quality")


def judge_measured(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """``judge`` for rows that ``with_stats`` has measured (``doc_id``, ``lang``, ``_stats``)."""
    cuts = certified_cutoffs(measured, labels, risk, delta)
    return _with_verdicts(measured, cuts, [c for c in measured.columns if c != "_stats"])


def _with_verdicts(measured: DataFrame, cuts: DataFrame, columns: list[str]) -> DataFrame:
    cuts = cuts.select(
        F.col("stratum").alias("_stratum"), F.struct(*cuts.columns[1:]).alias("_cuts")
    )
    judged = measured.join(
        broadcast_when_small(cuts), _stratum() == F.col("_stratum"), "left"
    )
    words = _count("n_words")
    failed = (words < 50) | (100 * _count("n_repeat_words") > 50 * words)
    over = F.lit(False)
    for rule, (count, of) in RULES.items():
        cut = F.col(f"_cuts.cut_{rule}")
        over = over | F.coalesce(10000 * _count(count) > cut * _count(of), F.lit(False))
    return judged.select(
        *columns,
        F.struct(*_flat(), failed.alias("base_failed"), (~failed & ~over).alias("kept")).alias(
            "_quality"
        ),
    )
