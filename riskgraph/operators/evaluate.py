"""Classification measures, fold summaries and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import ratio_or_zero
from riskgraph.operators.quantiles import BUCKET_ROWS, cumulative, with_ordered_bucket

# Cut-offs of the top-k precision.
TOP_K = (100, 500, 1000)
MEASURES = ["f1", "recall", "precision", "auc"]


def confusion_counts(label: str, prediction: str) -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    return [
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_counts(label, prediction))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from confusion counts, 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": ratio_or_zero(tp, tp + fp),
            "recall": ratio_or_zero(tp, tp + fn),
            "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
            "accuracy": ratio_or_zero(tp + tn, tp + tn + fp + fn),
        }
    )


def score_table(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Positives and negatives per distinct score, with the counts up to that score."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    _, placed = with_ordered_bucket(counts, "score", bucket_rows)
    totals = {"pos_upto": "pos", "neg_upto": "neg"}
    summed = cumulative(placed, [F.col("score")], F.col("_ordered"), totals, by)
    return summed.drop("_ordered")


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "probability", by: Sequence[str] = ()
) -> DataFrame:
    """Exact area under the ROC curve, tied scores averaged, 0.5 for a single class."""
    pos, neg = F.sum("pos"), F.sum("neg")
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    # The product of the class sizes can leave the range of a long.
    area = F.try_divide(won / pos, neg.cast("double"))
    table = score_table(df, label, score, by)
    auc = F.when((pos > 0) & (neg > 0), area).otherwise(0.5).alias("auc")
    return table.groupBy(*by).agg(auc)


def f1_threshold(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """Score threshold with the highest F1, the highest threshold among equals."""
    table = score_table(df, label, score)
    pos, neg = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    tp = F.lit(pos) - F.col("pos_upto") + F.col("pos")
    fp = F.lit(neg) - F.col("neg_upto") + F.col("neg")
    f1 = ratio_or_zero(2 * tp, tp + fp + F.lit(pos))
    best = table.withColumn("f1", f1).agg(F.max(F.struct("f1", "score")).alias("b"))
    return best.select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def top_k_precision(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "label",
    score: str = "probability",
    ks: Sequence[int] = TOP_K,
) -> DataFrame:
    """Label share among the k highest scores, for every k the table can fill."""
    head = df.select(score, label, *keys).orderBy(F.desc(score), *keys).limit(max(ks))
    ranked = head.withColumn(
        "rn", F.row_number().over(Window.orderBy(F.desc(score), *map(F.col, keys)))
    )
    parts = F.array(*[F.when(F.col("rn") <= k, F.lit(k)) for k in ks])
    return (
        ranked.select(label, F.explode(F.array_compact(parts)).alias("k"))
        .groupBy("k")
        .agg(F.avg(label).alias("precision"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == F.col("k"))
        .drop("_n")
    )


def evaluate(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "label",
    prediction: str = "prediction",
    score: str = "probability",
) -> DataFrame:
    """One row with all measures; ``top_k`` maps k to its precision."""
    auc = roc_auc(df, label, score).first()["auc"]
    top = {r["k"]: r["precision"] for r in top_k_precision(df, keys, label, score).collect()}
    pairs = [F.lit(v) for k in sorted(top) for v in (k, float(top[k]))]
    top_k = F.create_map(*pairs).cast("map<int,double>")
    counts = rates(confusion_matrix(df, label, prediction))
    return counts.withColumns({"auc": F.lit(auc), "top_k": top_k})


def evaluate_by(
    df: DataFrame,
    by: Sequence[str],
    keys: Sequence[str],
    label: str = "label",
    prediction: str = "prediction",
    score: str = "probability",
    ks: Sequence[int] = TOP_K,
) -> DataFrame:
    """``evaluate`` for every group at once, in one pass per measure instead of one per group.

    Groups are identified by ``by``, whose values are not null. Only the highest ``max(ks)``
    rows of a group and partition are shuffled for the top-k precision.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(score), *map(F.col, keys))
    head = (
        df.select(*by, *keys, label, score)
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= max(ks))
    )
    share = {k: F.avg(F.when(F.col("_rn") <= k, F.col(label))) for k in ks}
    entries = [
        F.when(F.max("_rn") >= k, F.struct(F.lit(k).alias("k"), share[k].alias("v"))) for k in ks
    ]
    top = head.groupBy(*by).agg(
        F.map_from_entries(F.array_compact(F.array(*entries))).alias("top_k")
    )
    counts = rates(confusion_matrix(df, label, prediction, by))
    return counts.join(roc_auc(df, label, score, by), list(by)).join(top, list(by))


def fold_summary(folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation of every measure, and the first best fold."""
    figures = [
        agg(m).alias(f"{name}_{m}")
        for m in MEASURES
        for name, agg in (("mean", F.avg), ("std", F.stddev_pop))
    ]
    return folds.groupBy(*by).agg(
        *figures,
        F.max_by("fold", F.struct("f1", -F.col("fold"))).alias("best_fold"),
        F.max("f1").alias("best_fold_f1"),
    )


def comparison_table(summary: DataFrame, model: str = "model", labeling: str = "labeling") -> DataFrame:
    """One row per model and labelling with display names."""
    title = F.initcap(F.replace(F.col(labeling), F.lit("_"), F.lit(" ")))
    others = [c for c in summary.columns if c not in (model, labeling, "best_fold")]
    return summary.select(
        F.upper(F.col(model)).alias("model"), title.alias("labeling"), *others
    )


def pivot_f1(table: DataFrame, labelings: Sequence[str]) -> DataFrame:
    return table.groupBy("model").pivot("labeling", list(labelings)).agg(F.first("mean_f1"))


def top_combinations(table: DataFrame, n: int = 5) -> DataFrame:
    return table.orderBy(F.desc("mean_f1"), "model", "labeling").limit(n)


def best_per_metric(table: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
    """Name of the best row of every metric, the first name among equals."""
    picks = [
        F.struct(
            F.lit(m).alias("metric"),
            F.min_by(F.col(name), F.struct(-F.col(m), F.col(name))).alias("best"),
            F.max(m).alias("value"),
        )
        for m in metrics
    ]
    return table.agg(F.array(*picks).alias("p")).select(F.inline("p"))
