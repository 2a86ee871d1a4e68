"""CSV, JSON and graph sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskgraph.operators.graph import NODE_TYPES, RetailGraph


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """Nested results stay nested: struct, array and map columns become JSON objects."""
    df.write.mode(mode).json(path)


def write_sample(df: DataFrame, path: str, n: int, mode: str = "error") -> None:
    write_csv(df.limit(n), path, mode)


def save_graph(graph: RetailGraph, path: str, mode: str = "error") -> None:
    """Node, id-map and mapping tables as parquet, edges partitioned by relation."""
    for kind in NODE_TYPES:
        graph.nodes[kind].write.mode(mode).parquet(f"{path}/nodes/{kind}")
        graph.id_maps[kind].write.mode(mode).parquet(f"{path}/id_map/{kind}")
    graph.edges.write.mode(mode).partitionBy("rel").parquet(f"{path}/edges")
    graph.mapping.write.mode(mode).parquet(f"{path}/mapping")


def load_graph(spark: SparkSession, path: str) -> RetailGraph:
    read = spark.read.parquet
    return RetailGraph(
        nodes={kind: read(f"{path}/nodes/{kind}") for kind in NODE_TYPES},
        id_maps={kind: read(f"{path}/id_map/{kind}") for kind in NODE_TYPES},
        edges=read(f"{path}/edges"),
        mapping=read(f"{path}/mapping"),
    )
