"""Measures, fold summaries and scoring rules on SQL-made scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.operators import evaluate as ev
from riskgraph.operators import labels as lab
from riskgraph.operators import score as sc
from riskgraph.plans.catalog.base import (
    KEY_SQL,
    LINE_KEY,
    lines,
    query,
    rounded,
    sql_round,
    with_lines,
)

# A score with many ties, from 0 to 1, related to the label but not equal to it.
SCORE_SQL = "(amount*17+product_code%23*31)%1001/1000.0e0"
SCORED_CTE = (
    "scored as (select *, (p>=0.5)::int as pred from (select *,"
    " (amount>40)::int as label, " + SCORE_SQL + "*0.5e0+amount/100.0e0 as p from lines))"
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.expr("(amount*17+product_code%23*31)%1001/1000.0e0")
    return (
        lines(spark, sf_dir)
        .withColumn("label", (F.col("amount") > 40).cast("int"))
        .withColumn("probability", base * 0.5 + F.col("amount") / 100.0)
        .withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    )


MATRIX_SQL = (
    "count(*) filter (label=0 and pred=0) as tn, count(*) filter (label=0 and pred=1) as fp,"
    " count(*) filter (label=1 and pred=0) as fn, count(*) filter (label=1 and pred=1) as tp"
)
PRECISION = "coalesce(tp/nullif(tp+fp,0),0)"
RECALL = "coalesce(tp/nullif(tp+fn,0),0)"
F1 = "coalesce(2*tp/nullif(2*tp+fp+fn,0),0)"
ACCURACY = "(tp+tn)/(tp+tn+fp+fn)"
AUC_SQL = (
    "(select sum(pos*(below+neg/2))/(sum(pos)*sum(neg)) from (select *,"
    " sum(neg) over (order by p)-neg as below from (select p, count(*) filter (label=1) as pos,"
    " count(*) filter (label=0) as neg from scored group by p)))"
)
MATRIX_CTE = f"m as (select {MATRIX_SQL} from scored)"


@query("e1_confusion_matrix", with_lines(f"select {MATRIX_SQL} from scored", SCORED_CTE))
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_matrix(scored(spark, sf_dir))


def _rate_query(name: str, columns: dict[str, str]) -> None:
    body = ", ".join(f"{sql_round(t)} as {c}" for c, t in columns.items())

    @query(name, with_lines(f"select {body} from m", SCORED_CTE, MATRIX_CTE))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ev.rates(ev.confusion_matrix(scored(spark, sf_dir)))
        return rounded(out.select(*columns), list(columns))


_rate_query("e2_precision_recall", {"precision": PRECISION, "recall": RECALL})
_rate_query("e3_f1", {"f1": F1})
_rate_query("o6_accuracy", {"accuracy": ACCURACY})


@query("e4_roc_auc", with_lines(f"select {sql_round(AUC_SQL)} as auc", SCORED_CTE))
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.roc_auc(scored(spark, sf_dir)), ["auc"])


@query(
    "e4_single_class",
    with_lines("select 0.5e0 as auc from lines limit 1"),
)
def e4_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.roc_auc(scored(spark, sf_dir).withColumn("label", F.lit(0)))


TOP_SQL = " union all ".join(
    f"select {k} as k, {sql_round('avg(label)')} as precision from (select label from scored"
    f" order by p desc, {KEY_SQL} limit {k}) having count(*)={k}"
    for k in ev.TOP_K
)


@query("e5_top_k_precision", with_lines(TOP_SQL, SCORED_CTE))
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.top_k_precision(scored(spark, sf_dir), LINE_KEY), ["precision"])


TOP_VALUE = {
    k: f"(select avg(label) from (select label from scored order by p desc, {KEY_SQL} limit {k}))"
    for k in ev.TOP_K
}


@query(
    "e6_evaluation_record",
    with_lines(
        f"select tn, fp, fn, tp, {sql_round(PRECISION)} as precision, {sql_round(RECALL)} as"
        f" recall, {sql_round(F1)} as f1, {sql_round(AUC_SQL)} as auc, "
        + ", ".join(f"{sql_round(t)} as top_{k}" for k, t in TOP_VALUE.items())
        + " from m",
        SCORED_CTE,
        MATRIX_CTE,
    ),
)
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = ev.evaluate(scored(spark, sf_dir), LINE_KEY)
    tops = [F.col("top_k")[k].alias(f"top_{k}") for k in ev.TOP_K]
    reals = ["precision", "recall", "f1", "auc"]
    out = record.select("tn", "fp", "fn", "tp", *reals, *tops)
    return rounded(out, [*reals, *[f"top_{k}" for k in ev.TOP_K]])


# One evaluation per model, labelling and fold, from disjoint groups of lines.
MODEL_SQL = "case store_code%3 when 0 then 'sage' when 1 then 'gat' else 'gcn' end"
LABELING_SQL = (
    "case product_code%4 when 0 then 'quantile_99' when 1 then 'quantile_95'"
    " when 2 then 'quantile_90' else 'z_score' end"
)
FOLDS_CTE = (
    f"folds as (select model, labeling, fold, {PRECISION} as precision, {RECALL} as recall,"
    f" {F1} as f1, auc from (select {MODEL_SQL} as model, {LABELING_SQL} as labeling,"
    f" (trans_id%5)::int as fold, avg(p) as auc, {MATRIX_SQL} from scored group by 1, 2, 3))"
)
SUMMARY_CTE = (
    "summary as (select model, labeling, "
    + ", ".join(
        f"avg({m}) as mean_{m}, stddev_pop({m}) as std_{m}"
        for m in ("f1", "recall", "precision", "auc")
    )
    + ", max(f1) as best_fold_f1 from folds group by model, labeling)"
)
FIGURES = [f"{a}_{m}" for m in ev.MEASURES for a in ("mean", "std")]
FOLD_CTES = (SCORED_CTE, FOLDS_CTE, SUMMARY_CTE)


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).withColumns(
        {
            "model": F.expr(MODEL_SQL),
            "labeling": F.expr(LABELING_SQL),
            "fold": (F.col("trans_id") % 5).cast("int"),
        }
    )
    by = ["model", "labeling", "fold"]
    counts = df.groupBy(*by).agg(
        F.avg("probability").alias("auc"), *ev.confusion_counts("label", "prediction")
    )
    return ev.rates(counts).select(*by, *ev.MEASURES)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fold_summary(fold_metrics(spark, sf_dir), ["model", "labeling"])


@query(
    "e7_fold_summary",
    with_lines(
        "select model, labeling, "
        + ", ".join(f"{sql_round(c)} as {c}" for c in FIGURES)
        + " from summary",
        *FOLD_CTES,
    ),
)
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(spark, sf_dir).select("model", "labeling", *FIGURES), FIGURES)


@query(
    "e8_best_fold",
    with_lines(
        f"select model, labeling, fold as best_fold, {sql_round('f1')} as best_fold_f1 from"
        " (select *, row_number() over (partition by model, labeling order by f1 desc, fold) as rn"
        " from folds) where rn=1",
        *FOLD_CTES,
    ),
)
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary(spark, sf_dir).select("model", "labeling", "best_fold", "best_fold_f1")
    return rounded(out, ["best_fold_f1"])


TITLE_SQL = (
    "case labeling when 'quantile_99' then 'Quantile 99' when 'quantile_95' then 'Quantile 95'"
    " when 'quantile_90' then 'Quantile 90' else 'Z Score' end"
)


@query(
    "e9_comparison_table",
    with_lines(
        f"select upper(model) as model, {TITLE_SQL} as labeling, "
        + ", ".join(f"{sql_round(c)} as {c}" for c in [*FIGURES, "best_fold_f1"])
        + " from summary",
        *FOLD_CTES,
    ),
)
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.comparison_table(summary(spark, sf_dir)), [*FIGURES, "best_fold_f1"])


@query(
    "e10_pivot_f1",
    with_lines(
        "select model, "
        + ", ".join(
            sql_round(f"max(mean_f1) filter (labeling='{name}')") + f" as {name}"
            for name in lab.LABEL_NAMES
        )
        + " from summary group by model",
        *FOLD_CTES,
    ),
)
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.pivot_f1(summary(spark, sf_dir), lab.LABEL_NAMES), lab.LABEL_NAMES)


@query(
    "e11_top_combinations",
    with_lines(
        f"select model, labeling, {sql_round('mean_f1')} as mean_f1 from summary s"
        " order by s.mean_f1 desc, model, labeling limit 5",
        *FOLD_CTES,
    ),
)
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ev.top_combinations(summary(spark, sf_dir)).select("model", "labeling", "mean_f1")
    return rounded(top, ["mean_f1"])


@query(
    "e12_best_per_metric",
    with_lines(
        " union all ".join(
            f"(select '{m}' as metric, model||' '||labeling as best, {sql_round('mean_' + m)}"
            f" as value from summary order by summary.mean_{m} desc, 2 limit 1)"
            for m in ev.MEASURES
        ),
        *FOLD_CTES,
    ),
)
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = summary(spark, sf_dir).select(
        F.concat_ws(" ", "model", "labeling").alias("name"),
        *[F.col(f"mean_{m}").alias(m) for m in ev.MEASURES],
    )
    return rounded(ev.best_per_metric(named, "name", ev.MEASURES), ["value"])


@query(
    "p10_weighted_log_loss",
    with_lines(
        "select "
        + sql_round(
            "sum(case when label=1 then -r*ln(p) else -ln(1-p) end)"
            "/sum(case when label=1 then r else 1 end)"
        )
        + " as log_loss from (select label, least(greatest(p,0.01e0),0.99e0) as p,"
        " 4.0e0 as r from scored)",
        SCORED_CTE,
    ),
)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded = F.least(F.greatest("probability", F.lit(0.01)), F.lit(0.99))
    df = scored(spark, sf_dir).withColumn("probability", bounded)
    return rounded(lab.weighted_log_loss(df, "label", "probability", (1.0, 4.0)), ["log_loss"])


# --- scoring rules ----------------------------------------------------------------------

LEVEL_SQL = (
    "case when p<=0 or p>1 then null when p<=0.3 then 'Low' when p<=0.7 then 'Medium'"
    " else 'High' end"
)


def risk_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).withColumnRenamed("probability", "fraud_probability")
    return sc.risk_level(sc.predict_at(df))


@query(
    "x2_threshold_prediction",
    with_lines(f"select {KEY_SQL}, (p>=0.5)::int as fraud_prediction from scored", SCORED_CTE),
)
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_scored(spark, sf_dir).select(*LINE_KEY, "fraud_prediction")


@query(
    "x3_risk_level",
    with_lines(f"select {KEY_SQL}, {LEVEL_SQL} as fraud_risk_level from scored", SCORED_CTE),
)
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_scored(spark, sf_dir).select(*LINE_KEY, "fraud_risk_level")


@query(
    "x4_level_summary",
    with_lines(
        "select count(*) as total, sum(pred)::bigint as flagged,"
        f" {sql_round('avg(pred)')} as flagged_share, count(*) filter (l='Low') as low,"
        " count(*) filter (l='Medium') as medium, count(*) filter (l='High') as high"
        f" from (select *, {LEVEL_SQL} as l from scored)",
        SCORED_CTE,
    ),
)
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sc.level_summary(risk_scored(spark, sf_dir)), ["flagged_share"])


@query(
    "x5_top_risks",
    with_lines(
        f"select {KEY_SQL}, cust_id, p as fraud_probability from scored"
        f" order by p desc, {KEY_SQL} limit 10",
        SCORED_CTE,
    ),
)
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = sc.top_risks(risk_scored(spark, sf_dir), LINE_KEY)
    return top.select(*LINE_KEY, "cust_id", "fraud_probability")


@query(
    "o2_f1_threshold",
    with_lines(
        f"select p as threshold, {sql_round('2*tp/(tp+fp+pos)')} as f1 from (select p,"
        " sum(y) over (order by p desc) as tp, sum(n) over (order by p desc) as fp,"
        " sum(y) over () as pos from (select p, count(*) filter (label=1) as y,"
        " count(*) filter (label=0) as n from scored group by p))"
        " order by 2*tp/(tp+fp+pos) desc, p desc limit 1",
        SCORED_CTE,
    ),
)
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ev.f1_threshold(scored(spark, sf_dir)), ["f1"])


@query(
    "o7_alerts",
    with_lines(f"select {KEY_SQL}, p as fraud_probability from scored where p>=0.9", SCORED_CTE),
)
def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.alerts(risk_scored(spark, sf_dir)).select(*LINE_KEY, "fraud_probability")
