"""Customer-product-store graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.operators.keys import Pairs, dense_ids, with_distinct_counts
from riskgraph.operators.scaling import standardize
from riskgraph.session import checkpointed

# Node types, relations and node features.
NODE_KEYS = {"customer": "cust_id", "product": "product_code", "store": "store_code"}
NODE_TYPES = list(NODE_KEYS)
RELATIONS = [
    ("customer", "buys", "product", "bought_by"),
    ("customer", "visits", "store", "visited_by"),
    ("product", "sold_at", "store", "sells"),
]
CUSTOMER_FEATURES = [
    "customer_total_spending", "customer_transaction_count", "avg_transaction_value",
    "customer_unique_products", "unique_stores", "return_rate", "transaction_velocity",
    "customer_discount_rate", "customer_campaign_rate",
]
PRODUCT_FEATURES = [
    "product_popularity", "product_avg_price", "product_unique_customers",
    "product_discount_frequency",
]
STORE_FEATURES = ["total_price_sum", "total_price_mean", "unique_customers", "unique_products"]
VALID = " and ".join(f"{c} > 0" for c in NODE_KEYS.values())
# Columns of a line that nodes, edges and mapping are built from; the label comes on top.
GRAPH_READS = [
    "txn_key", "trans_id", *NODE_KEYS.values(), "total_price", *CUSTOMER_FEATURES,
    *PRODUCT_FEATURES,
]
V1_CUSTOMER_FEATURES = [
    "transaction_count", "total_spent", "avg_transaction_value", "transaction_velocity",
    "unique_stores", "return_rate",
]
V1_PRODUCT_FEATURES = ["unit_price", "amount", "total_price", "product_popularity"]
V1_STORE_FEATURES = ["transaction_count", "total_revenue", "unique_customers"]


@dataclass(frozen=True)
class RetailGraph:
    """Node frames ``idx, key, features``, id maps, typed edges and the line mapping."""

    nodes: dict[str, DataFrame]
    id_maps: dict[str, DataFrame]
    edges: DataFrame
    mapping: DataFrame


def valid_lines(df: DataFrame) -> DataFrame:
    """Lines whose three ids are all positive."""
    return df.filter(VALID)


def line_pairs(df: DataFrame) -> Pairs:
    """Distinct pairs of two ids per relation; ``n`` counts the valid lines behind a pair.

    Distinct counts and edges read the same pairs, so they are written once.
    """
    lines = F.count_if(F.expr(VALID)).alias("n")
    keys = [(NODE_KEYS[src], NODE_KEYS[dst]) for src, _, dst, _ in RELATIONS]
    return {frozenset(pair): checkpointed(df.groupBy(*pair).agg(lines)) for pair in keys}


def valid_pairs(pairs: Pairs) -> Pairs:
    """Pairs with a valid line behind them."""
    return {key: frame.filter("n > 0") for key, frame in pairs.items()}


def node_id_maps(df: DataFrame) -> dict[str, DataFrame]:
    return {kind: dense_ids(df, key) for kind, key in NODE_KEYS.items()}


def _mean_features(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.groupBy(key).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in present])


def customer_nodes(df: DataFrame) -> DataFrame:
    """Means of the customer features that are present."""
    return _mean_features(df, "cust_id", CUSTOMER_FEATURES)


def product_nodes(df: DataFrame) -> DataFrame:
    return _mean_features(df, "product_code", PRODUCT_FEATURES)


def store_nodes(df: DataFrame, pairs: Pairs | None = None) -> DataFrame:
    """Revenue and reach per store; a single store gets scaled figures instead."""
    grouped = df.groupBy("store_code").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.coalesce(F.sum("total_price"), F.lit(0.0)).alias("total_price_sum"),
        F.coalesce(F.avg("total_price"), F.lit(0.0)).alias("total_price_mean"),
    )
    counted = {"unique_customers": "cust_id", "unique_products": "product_code"}
    grouped = with_distinct_counts(grouped, df, "store_code", counted, nulls=True, pairs=pairs)
    if df.select("store_code").distinct().limit(2).count() != 1:
        return grouped.drop("_lines").withColumns(
            {c: F.col(c).cast("double") for c in STORE_FEATURES}
        )
    return grouped.select(
        "store_code",
        (F.col("_lines") / 1000.0).alias("total_price_sum"),
        "total_price_mean",
        (F.col("unique_customers") / 100.0).alias("unique_customers"),
        (F.col("unique_products") / 100.0).alias("unique_products"),
    )


def v1_node_features(df: DataFrame) -> dict[str, DataFrame]:
    """Node features of the earlier graph, standardised per node type."""
    customers = df.groupBy("cust_id").agg(*[F.max(c).alias(c) for c in V1_CUSTOMER_FEATURES])
    products = df.groupBy("product_code").agg(
        *[F.avg(c).alias(c) for c in V1_PRODUCT_FEATURES[:3]],
        F.max("product_popularity").alias("product_popularity"),
    )
    stores = df.groupBy("store_code").agg(
        F.count("trans_id").alias("transaction_count"),
        F.sum("total_price").alias("total_revenue"),
        F.count_distinct("cust_id").alias("unique_customers"),
    )
    return {
        "customer": standardize(customers.fillna(0), V1_CUSTOMER_FEATURES),
        "product": standardize(products.fillna(0), V1_PRODUCT_FEATURES),
        "store": standardize(stores.fillna(0), V1_STORE_FEATURES),
    }


def with_idx(nodes: DataFrame, id_map: DataFrame, key: str) -> DataFrame:
    return id_map.join(nodes, key).select("idx", key, *[c for c in nodes.columns if c != key])


def _relation(kind: str, rel: str, other: str, src: Column, dst: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("src_type"),
        F.lit(rel).alias("rel"),
        F.lit(other).alias("dst_type"),
        src.alias("src_idx"),
        dst.alias("dst_idx"),
        F.col("n"),
    )


def edges_of(df: DataFrame, id_maps: dict[str, DataFrame], relation: tuple) -> DataFrame:
    """Distinct pairs of one relation and its reverse; ``n`` counts the lines behind a pair.

    Pairs are collapsed before ids are attached, and both directions come from one row.
    """
    a, b = NODE_KEYS[relation[0]], NODE_KEYS[relation[2]]
    return edges_of_pairs(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), id_maps, relation)


def edges_of_pairs(
    pairs: DataFrame, id_maps: dict[str, DataFrame], relation: tuple
) -> DataFrame:
    """Edges of one relation and its reverse from its distinct pairs."""
    src, rel, dst, reverse = relation
    numbered = pairs.join(id_maps[src].withColumnRenamed("idx", "_a"), NODE_KEYS[src]).join(
        id_maps[dst].withColumnRenamed("idx", "_b"), NODE_KEYS[dst]
    )
    both = F.array(
        _relation(src, rel, dst, F.col("_a"), F.col("_b")),
        _relation(dst, reverse, src, F.col("_b"), F.col("_a")),
    )
    return numbered.select(F.inline(both))


def build_edges(
    df: DataFrame, id_maps: dict[str, DataFrame], pairs: Pairs | None = None
) -> DataFrame:
    """Edges of all relations, from known pairs where they are given."""
    parts = [
        edges_of(df, id_maps, relation)
        if pairs is None
        else edges_of_pairs(
            pairs[frozenset((NODE_KEYS[relation[0]], NODE_KEYS[relation[2]]))], id_maps, relation
        )
        for relation in RELATIONS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def written_edges(edges: DataFrame) -> DataFrame:
    """Edges of a built graph written once, in one direction; the reverse reads the same rows."""
    forward = edges.filter(F.col("rel").isin([rel for _, rel, _, _ in RELATIONS]))
    rows = checkpointed(forward.select("rel", "src_idx", "dst_idx", "n"))
    src, dst = F.col("src_idx"), F.col("dst_idx")
    parts = []
    # One frame per relation and direction, so that a filter on the relation reads it alone.
    for kind, rel, other, reverse in RELATIONS:
        own = rows.filter(F.col("rel") == rel)
        parts.append(own.select(_relation(kind, rel, other, src, dst).alias("e")).select("e.*"))
        parts.append(own.select(_relation(other, reverse, kind, dst, src).alias("e")).select("e.*"))
    return reduce(DataFrame.unionByName, parts)


def transaction_mapping(
    df: DataFrame, id_maps: dict[str, DataFrame], keep: Sequence[str]
) -> DataFrame:
    """Line key columns, the three node ids and any further columns asked for."""
    out = df.select(*dict.fromkeys([*keep, *NODE_KEYS.values()]))
    for kind, key in NODE_KEYS.items():
        out = out.join(id_maps[kind].withColumnRenamed("idx", f"{kind}_idx"), key)
    return out.select(*keep, *[f"{kind}_idx" for kind in NODE_TYPES])


def customer_labels(df: DataFrame, label: str = "fraud_label") -> DataFrame:
    """1 for customers with at least one positive line."""
    return df.groupBy("cust_id").agg(F.max(label).alias("y"))


def build_graph(
    df: DataFrame,
    label: str = "fraud_label",
    keep: Sequence[str] = ("txn_key", "trans_id"),
    pairs: Pairs | None = None,
) -> RetailGraph:
    """Graph of the valid lines of a labelled feature table, which is read many times.

    ``pairs`` are the ``line_pairs`` of the table where they are written already.
    """
    rows = valid_lines(df)
    known = valid_pairs(line_pairs(df) if pairs is None else pairs)
    # Nodes, edges and mapping all read the id maps, so these are written once.
    id_maps = {kind: checkpointed(ids) for kind, ids in node_id_maps(rows).items()}
    customers = customer_nodes(rows).join(customer_labels(rows, label), "cust_id")
    frames = {"customer": customers, "product": product_nodes(rows)}
    frames["store"] = store_nodes(rows, known)
    kept = [c for c in keep if c in df.columns]
    return RetailGraph(
        nodes={k: with_idx(frames[k], id_maps[k], NODE_KEYS[k]) for k in NODE_TYPES},
        id_maps=id_maps,
        edges=build_edges(rows, id_maps, known),
        mapping=transaction_mapping(rows, id_maps, [*kept, label]),
    )


def materialize(graph: RetailGraph, mapping: bool = True) -> RetailGraph:
    """Write nodes, edges and mapping once before repeated use.

    Without ``mapping`` the line mapping stays to be computed by whoever reads it; it joins
    every line with three id maps, which node vectors alone do not need.
    """
    return replace(
        graph,
        nodes={kind: checkpointed(df) for kind, df in graph.nodes.items()},
        edges=written_edges(graph.edges),
        mapping=checkpointed(graph.mapping) if mapping else graph.mapping,
    )


def relabel(graph: RetailGraph, labels: DataFrame, label: str, key: str = "txn_key") -> RetailGraph:
    """Same topology under another labelling ``key, label``."""
    return relabel_all(graph, labels, [label], key)[label]


def relabel_all(
    graph: RetailGraph, labels: DataFrame, names: Sequence[str], key: str = "txn_key"
) -> dict[str, RetailGraph]:
    """Same topology under several labellings ``key, *names``.

    Lines meet their labels once for the customer labels of all labellings, which are written.
    """
    unlabelled = graph.mapping.drop("fraud_label", *names)
    met = unlabelled.join(labels.select(key, *names), key)
    tops = checkpointed(
        met.groupBy(F.col("customer_idx").alias("idx")).agg(*[F.max(n).alias(n) for n in names])
    )
    customers = graph.nodes["customer"].drop("y")
    out = {}
    for name in names:
        named = labels.select(key, F.col(name).alias("fraud_label"))
        y = tops.select("idx", F.col(name).alias("y"))
        nodes = {**graph.nodes, "customer": customers.join(y, "idx")}
        out[name] = replace(graph, mapping=unlabelled.join(named, key), nodes=nodes)
    return out


def graph_summary(graph: RetailGraph) -> DataFrame:
    """Counts of nodes per type, edges per relation and lines, and the label rate."""

    def counted(df: DataFrame, kind: str, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"),
            F.lit(name).alias("name"),
            "n",
            F.lit(None).cast("double").alias("rate"),
        )

    rows = graph.mapping.agg(F.count(F.lit(1)).alias("n"), F.avg("fraud_label").alias("rate"))
    out = rows.select(F.lit("mapping").alias("kind"), F.lit("lines").alias("name"), "n", "rate")
    for kind in NODE_TYPES:
        out = out.unionByName(counted(graph.id_maps[kind], "nodes", kind))
    per_relation = graph.edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(
        per_relation.select(
            F.lit("edges").alias("kind"),
            F.col("rel").alias("name"),
            "n",
            F.lit(None).cast("double").alias("rate"),
        )
    )
