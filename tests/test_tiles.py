"""Cluster measures by tiles against full matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.operators import cluster_metrics as cm


def _frame(spark, n, clusters, seed):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, clusters, n)
    x = rng.normal(size=(n, 3)) + label[:, None] % 7
    data = [(i, int(label[i]) - 1, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(data, "k long, cluster int, x array<double>"), label - 1, x


def _silhouettes(label, x):
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(label):
        if (label == own).sum() == 1:
            out.append(0.0)
            continue
        inner = apart[i][label == own].sum() / ((label == own).sum() - 1)
        outer = min(apart[i][label == c].mean() for c in np.unique(label) if c != own)
        out.append((outer - inner) / max(inner, outer) if max(inner, outer) > 0 else 0.0)
    return np.array(out)


@pytest.mark.parametrize("n,clusters", [(1300, 4), (700, 600), (40, 2)])
def test_silhouette_rows_equal_the_full_matrix(spark, n, clusters):
    df, label, x = _frame(spark, n, clusters, 3)
    want = _silhouettes(label, x)
    rows = cm.silhouette_rows(df, ["k"], sample_size=10**6).collect()
    assert len(rows) == n
    assert np.allclose([r["silhouette"] for r in sorted(rows)], want, atol=1e-9)


def test_silhouette_awkward_rows(spark):
    same = spark.createDataFrame(
        [(i, i % 2, [1.0, 1.0]) for i in range(10)], "k long, cluster int, x array<double>"
    )
    assert {r["silhouette"] for r in cm.silhouette_rows(same, ["k"]).collect()} == {0.0}
    one = same.withColumn("cluster", F.lit(0))
    assert cm.silhouette_rows(one, ["k"]).count() == 0
    assert cm.silhouette_rows(same.limit(0), ["k"]).count() == 0


def test_many_clusters_compare_in_tiles(spark):
    df, label, x = _frame(spark, 4000, 1500, 8)
    names = np.unique(label)
    centres = np.array([x[label == c].mean(axis=0) for c in names])
    spread = np.array(
        [np.sqrt(((x[label == c] - m) ** 2).sum(axis=1)).mean() for c, m in zip(names, centres)]
    )
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    davies = ((spread[:, None] + spread[None]) / apart).max(axis=1).mean()
    size = np.array([(label == c).sum() for c in names])
    between = (size * ((centres - x.mean(axis=0)) ** 2).sum(axis=1)).sum()
    within = sum(((x[label == c] - m) ** 2).sum() for c, m in zip(names, centres))
    calinski = between * (len(x) - len(names)) / (within * (len(names) - 1))
    row = cm.centroid_metrics(df).first()
    assert row["davies_bouldin"] == pytest.approx(davies, rel=1e-9)
    assert row["calinski_harabasz"] == pytest.approx(calinski, rel=1e-9)
