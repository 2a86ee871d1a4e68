"""Feature propagation over typed edges, without learned weights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import hash_text
from riskgraph.operators.graph import (
    CUSTOMER_FEATURES,
    NODE_TYPES,
    PRODUCT_FEATURES,
    RELATIONS,
    STORE_FEATURES,
    RetailGraph,
)
from riskgraph.session import checkpointed

# Model family names, their neighbour aggregation and number of layers.
FAMILIES = {"sage": "mean", "gat": "attention", "gcn": "degree"}
FAMILY_LAYERS = {"sage": 3, "gat": 2, "gcn": 2}
NORM_EPSILON = 1e-5
FEATURES = {"customer": CUSTOMER_FEATURES, "product": PRODUCT_FEATURES, "store": STORE_FEATURES}
DIRECTED = [(a, r, b) for a, r, b, _ in RELATIONS] + [(b, r, a) for a, _, b, r in RELATIONS]


def aggregation_of(family: str) -> str:
    """Aggregation of a model family name, or the name itself."""
    how = FAMILIES.get(family.lower(), family)
    if how not in AGGREGATIONS:
        raise ValueError(f"Unknown model family {family!r}")
    return how


def _per_dim(x: str, dims: int, agg, weight: Column | None = None) -> Column:
    value = [F.col(x)[i] for i in range(dims)]
    return F.array(*[agg(v if weight is None else v * weight) for v in value])


def _gather(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    sources = nodes.select(F.col("idx").alias("src_idx"), "x")
    return edges.join(sources, "src_idx")


def mean_neighbors(edges: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    return _gather(edges, nodes).groupBy("dst_idx").agg(_per_dim("x", dims, F.avg).alias("x"))


def max_neighbors(edges: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    return _gather(edges, nodes).groupBy("dst_idx").agg(_per_dim("x", dims, F.max).alias("x"))


def sum_neighbors(edges: DataFrame, nodes: DataFrame, dims: int) -> DataFrame:
    return _gather(edges, nodes).groupBy("dst_idx").agg(_per_dim("x", dims, F.sum).alias("x"))


def degree_neighbors(
    edges: DataFrame, nodes: DataFrame, dims: int, self_nodes: DataFrame | None = None
) -> DataFrame:
    """Sum weighted by 1/sqrt(degree of source * degree of destination).

    With ``self_nodes`` every destination also counts itself as a neighbour.
    """
    extra = 0 if self_nodes is None else 1
    out_degree = edges.groupBy("src_idx").agg((F.count(F.lit(1)) + extra).alias("d_src"))
    # 1/sqrt(d_dst) is the same for all edges of a destination, so it is applied after the sum.
    gathered = _gather(edges, nodes).join(out_degree, "src_idx")
    scaled = gathered.groupBy("dst_idx").agg(
        (F.count(F.lit(1)) + extra).alias("d_dst"),
        _per_dim("x", dims, F.sum, 1 / F.sqrt("d_src")).alias("s"),
    )
    summed = scaled.select(
        "dst_idx", "d_dst", F.transform("s", lambda v: v / F.sqrt("d_dst")).alias("x")
    )
    if self_nodes is None:
        return summed.drop("d_dst")
    own = self_nodes.select(F.col("idx").alias("dst_idx"), F.col("x").alias("own"))
    return summed.join(own, "dst_idx").select(
        "dst_idx", F.zip_with("x", "own", lambda a, b: a + b / F.col("d_dst")).alias("x")
    )


def attention_neighbors(
    edges: DataFrame, nodes: DataFrame, dims: int, score: str = "n"
) -> DataFrame:
    """Mean weighted by the softmax of a given edge score over the in-edges of a node."""
    top = edges.groupBy("dst_idx").agg(F.max(score).alias("top"))
    weight = F.exp(F.col(score) - F.col("top"))
    weighted = _gather(edges.join(top, "dst_idx").withColumn("w", weight), nodes)
    return weighted.groupBy("dst_idx").agg(
        F.array(*[F.sum(F.col("x")[i] * F.col("w")) / F.sum("w") for i in range(dims)]).alias("x")
    )


AGGREGATIONS = {
    "mean": mean_neighbors,
    "max": max_neighbors,
    "sum": sum_neighbors,
    "degree": degree_neighbors,
    "attention": attention_neighbors,
}


def node_vectors(graph: RetailGraph, width: int | None = None) -> dict[str, DataFrame]:
    """``idx, x`` per node type, padded with zeros to a common width."""
    width = width or max(len(c) for c in FEATURES.values())
    out = {}
    for kind in NODE_TYPES:
        present = [c for c in FEATURES[kind] if c in graph.nodes[kind].columns]
        values = [F.col(c).cast("double") for c in present]
        padding = [F.lit(0.0)] * (width - len(values))
        out[kind] = graph.nodes[kind].select("idx", F.array(*values, *padding).alias("x"))
    return out


def edges_by_relation(edges: DataFrame, rel: str) -> DataFrame:
    return edges.filter(F.col("rel") == rel).select("src_idx", "dst_idx", "n")


def propagate_layer(
    edges: DataFrame, vectors: dict[str, DataFrame], dims: int, how: str = "mean"
) -> dict[str, DataFrame]:
    """One layer: every node gets the mean of what its relations deliver.

    A node without in-edges of a relation counts a zero vector for it.
    """
    combine = AGGREGATIONS[how]
    out = {}
    for kind in NODE_TYPES:
        incoming = [(src, rel) for src, rel, dst in DIRECTED if dst == kind]
        parts = [
            combine(edges_by_relation(edges, rel), vectors[src], dims) for src, rel in incoming
        ]
        stacked = reduce(DataFrame.unionByName, parts)
        total = stacked.groupBy(F.col("dst_idx").alias("idx")).agg(
            _per_dim("x", dims, F.sum).alias("x")
        )
        zero = F.array(*[F.lit(0.0)] * dims)
        out[kind] = (
            vectors[kind]
            .select("idx")
            .join(total, "idx", "left")
            .select("idx", F.coalesce("x", zero).alias("x"))
            .select("idx", F.transform("x", lambda v: v / len(incoming)).alias("x"))
        )
    return out


def normalize_relu(nodes: DataFrame) -> DataFrame:
    """Zero mean and unit deviation within each vector, negatives cut to 0."""
    size = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / size
    spread = (
        F.aggregate(
            "x", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))
        )
        / size
    )
    scaled = F.transform(
        "x",
        lambda v: F.greatest(
            (v - F.col("_m")) / F.sqrt(F.col("_v") + F.lit(NORM_EPSILON)), F.lit(0.0)
        ),
    )
    return (
        nodes.withColumn("_m", mean)
        .withColumn("_v", spread)
        .withColumn("x", scaled)
        .drop("_m", "_v")
    )


def propagate(
    graph: RetailGraph,
    layers: int = 1,
    family: str = "mean",
    width: int | None = None,
    activate: bool = False,
) -> dict[str, DataFrame]:
    """Node vectors after a number of layers.

    The node vectors of a layer feed several relations of the next one, so they are
    written between layers.
    """
    how = aggregation_of(family)
    dims = width or max(len(c) for c in FEATURES.values())
    vectors = node_vectors(graph, dims)
    for layer in range(layers):
        vectors = {kind: checkpointed(v) for kind, v in vectors.items()}
        vectors = propagate_layer(graph.edges, vectors, dims, how)
        if activate:
            vectors = {kind: normalize_relu(v) for kind, v in vectors.items()}
    return vectors


def transaction_vectors(
    mapping: DataFrame, vectors: dict[str, DataFrame], keep: Sequence[str]
) -> DataFrame:
    """Concatenated customer, product and store vector per line."""
    out = mapping
    for kind in NODE_TYPES:
        side = vectors[kind].select(F.col("idx").alias(f"{kind}_idx"), F.col("x").alias(f"_{kind}"))
        out = out.join(side, f"{kind}_idx")
    return out.select(*keep, F.concat(*[f"_{kind}" for kind in NODE_TYPES]).alias("x"))


def sample_in_edges(edges: DataFrame, fanout: int, seed: int = 42) -> DataFrame:
    """At most ``fanout`` in-edges per node and relation, the first in md5 order."""
    order = [hash_text(["src_idx", "dst_idx"], seed), "src_idx"]
    return _first_in_edges(edges, fanout, order)


def heaviest_in_edges(edges: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` in-edges with most lines per node and relation."""
    return _first_in_edges(edges, limit, [F.desc("n"), F.col("src_idx")])


def _first_in_edges(edges: DataFrame, limit: int, order: list) -> DataFrame:
    # A rank bounded from above is cut before the shuffle, so hubs send only ``limit`` edges.
    ranked = F.row_number().over(Window.partitionBy("rel", "dst_idx").orderBy(*order))
    return edges.withColumn("_rn", ranked).filter(F.col("_rn") <= limit).drop("_rn")
