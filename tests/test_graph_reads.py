"""Graph queries join their source once, and distinct counts are shuffled by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import graph as gr
from riskgraph.operators.features import (
    customer_aggregates,
    engineer_features,
    product_aggregates,
    purchase_moments,
)
from riskgraph.operators.graph import store_nodes
from riskgraph.plans import risk
from riskgraph.plans.catalog import graph_queries as gq
from riskgraph.plans.catalog import model_queries as mq
from riskgraph.plans.catalog.graph_queries import graph

LINES = [
    "id as trans_id", "timestamp_seconds(1714557600 + 60 * id) as trans_date",
    "cast(id % 3 + 1 as int) as store_code", "id % 4 + 1 as cust_id", "id % 5 + 1 as product_code",
    "id as barcode", "cast(id % 7 + 1 as int) as amount", "1.5d + id as unit_price",
    "1.5d + id as no_discount", "1.0d + id as discounted_unit_price",
    "2.0d * id as discounted_total_price", "0.5d as total_discount_amount",
    "0.0d as unit_campaign_discount",
]


def test_graph_frames_do_not_join_the_source_again(spark, tmp_path):
    spark.range(60).selectExpr(
        "id div 3 as l_orderkey", "cast(id % 3 as int) as l_linenumber", "id % 4 + 1 as l_suppkey",
        "id % 5 + 1 as l_partkey", "double(id % 7 + 1) as l_quantity",
        "10.0d + id as l_extendedprice", "0.1d as l_discount", "0.1d as l_tax",
        "'A' as l_returnflag",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(20).selectExpr(
        "id as o_orderkey", "id % 6 + 1 as o_custkey",
        "timestamp_seconds(1714557600 + 86400 * id) as o_orderdate",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    built = graph(spark, str(tmp_path))
    assert built.mapping.count() == 60
    for frame in (built.edges, built.mapping, *built.nodes.values(), *built.id_maps.values()):
        assert not [f for f in frame.inputFiles() if str(tmp_path) in f]


def test_flagship_computes_its_features_once(spark, monkeypatch):
    seen = []
    build = risk.build_graph
    monkeypatch.setattr(risk, "build_graph", lambda df: seen.append(df) or build(df))
    rows = risk.flagship_report(spark.range(40).selectExpr(*LINES), ["trans_id"]).collect()
    assert [r["customer_transaction_count"] for r in rows] == [10] * 4
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_distinct_counts_do_not_carry_other_figures(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 2.0), (1, 1, 2, 3.0), (1, None, 2, 4.0), (2, None, None, 5.0),
         (None, 3, 1, 6.0), (1, 2, None, 7.0)],
        "cust_id long, product_code long, store_code int, total_price double",
    ).withColumns(
        {
            "amount": F.lit(1), "has_discount": F.lit(0), "has_campaign": F.lit(1),
            "effective_price": F.col("total_price"),
            "trans_date": F.timestamp_seconds(F.lit(1714557600)),
        }
    )
    customers, products, stores = customer_aggregates(df), product_aggregates(df), store_nodes(df)
    for frame in (customers, stores):
        assert "Expand" not in frame._jdf.queryExecution().optimizedPlan().toString()
    wanted = ("customer_unique_products", "unique_stores", "customer_transaction_count")
    assert {r["cust_id"]: tuple(r[c] for c in wanted) for r in customers.collect()} == {
        1: (2, 2, 4), 2: (0, 0, 1),
    }
    assert {r["product_code"]: r["product_unique_customers"] for r in products.collect()} == {
        1: 1, 2: 1, 3: 0,
    }
    assert {
        r["store_code"]: (r["unique_customers"], r["unique_products"]) for r in stores.collect()
    } == {1: (1, 2), 2: (1, 1), None: (2, 1)}


PAIRED = [
    (1, 1, 1, 2.0), (1, 1, 2, 3.0), (1, None, 2, 4.0), (2, 0, 3, 5.0), (None, 3, 1, 6.0),
    (1, 2, None, 7.0), (2, 1, 1, 8.0), (2, 1, 1, 9.0), (0, 4, 1, 1.0),
]


def _paired(spark):
    return spark.createDataFrame(
        PAIRED, "cust_id long, product_code long, store_code int, total_price double"
    ).withColumns(
        {
            "txn_key": F.concat_ws("-", "cust_id", "product_code", "total_price"),
            "fraud_label": (F.col("total_price") > 8).cast("int"),
            "first": (F.col("total_price") < 3).cast("int"),
            "amount": F.lit(1), "has_discount": F.lit(0), "has_campaign": F.lit(1),
            "effective_price": F.col("total_price"),
            "trans_date": F.timestamp_seconds(F.lit(1714557600)),
        }
    )


def _figured(spark):
    df = _paired(spark)
    joined = df.join(customer_aggregates(df), "cust_id", "left")
    return gr.checkpointed(joined.join(product_aggregates(df), "product_code", "left"))


def _set(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_figures_and_edges_from_shared_pairs(spark):
    df = _paired(spark)
    pairs = gr.line_pairs(df)
    rows, known = gr.valid_lines(df), gr.valid_pairs(pairs)
    for build in (customer_aggregates, product_aggregates):
        assert _set(build(df, pairs), "*") == _set(build(df), "*")
    assert _set(store_nodes(rows, known), "*") == _set(store_nodes(rows), "*")
    ids = gr.node_id_maps(rows)
    assert _set(gr.build_edges(rows, ids, known), "*") == _set(gr.build_edges(rows, ids), "*")


def test_graph_pairs_and_edges_are_written_once(spark, monkeypatch):
    built = gr.build_graph(_figured(spark))
    plan = built.edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    sizes = []
    write = gr.checkpointed
    monkeypatch.setattr(gr, "checkpointed", lambda df: sizes.append(df.count()) or write(df))
    kept = gr.materialize(built)
    columns = ["src_type", "rel", "dst_type", "src_idx", "dst_idx", "n"]
    assert kept.edges.columns == built.edges.columns == columns
    assert _set(kept.edges, *columns) == _set(built.edges, *columns)
    assert built.edges.count() // 2 in sizes and built.edges.count() not in sizes


def test_labellings_meet_the_lines_once(spark):
    df = _figured(spark)
    built = gr.materialize(gr.build_graph(df))
    found = gr.relabel_all(built, df, ["first", "fraud_label"])
    for name, wanted in {"first": {1: 1, 2: 0}, "fraud_label": {1: 0, 2: 1}}.items():
        nodes = found[name].nodes["customer"]
        assert {r["cust_id"]: r["y"] for r in nodes.collect()} == wanted
        assert str(built.mapping.inputFiles()[0]) not in nodes.inputFiles()
        assert found[name].mapping.count() == built.mapping.count()


def _tables(spark, tmp_path):
    spark.range(60).selectExpr(
        "id div 3 as l_orderkey", "cast(id % 3 as int) as l_linenumber", "id % 4 + 1 as l_suppkey",
        "id % 5 + 1 as l_partkey", "double(id % 7 + 1) as l_quantity",
        "10.0d + id as l_extendedprice", "0.1d as l_discount", "0.1d as l_tax",
        "'A' as l_returnflag",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(20).selectExpr(
        "id as o_orderkey", "id % 6 + 1 as o_custkey",
        "timestamp_seconds(1714557600 + 86400 * id) as o_orderdate",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def _text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_figures_without_gaps_do_not_look_back(spark):
    features = engineer_features(spark.range(40).selectExpr(*LINES), ["trans_id"])
    assert "_day" in _text(features.select("time_since_last_trans"))
    assert "_day" in _text(features.select("same_product_time_gap"))
    assert "_day" not in _text(features.select("customer_total_spending", "product_popularity"))


def test_moments_leave_out_missing_keys(spark):
    df = spark.sql(
        "select * from values (1L, 'a', 10), (1L, 'b', 20), (1L, 'c', 90020), (null, 'd', 30),"
        " (2L, 'e', null) as t(cust_id, txn_key, at)"
    ).withColumn("trans_date", F.timestamp_seconds("at"))
    found = purchase_moments(df, ["cust_id"]).select("cust_id", "_carrier", "_previous").collect()
    assert sorted(tuple(r) for r in found if r["_carrier"] != "a") == [
        (1, "b", 10_000_000), (1, "c", 20_000_000), (2, "e", None),
    ]
    assert [tuple(r) for r in found if r["_carrier"] == "a"] == [(1, "a", None)]


def test_flagship_writes_no_line_keys(spark, monkeypatch):
    seen = []
    build = risk.build_graph
    monkeypatch.setattr(risk, "build_graph", lambda df: seen.append(df) or build(df))
    assert risk.flagship_report(spark.range(40).selectExpr(*LINES), ["trans_id"]).count() == 4
    assert not {"txn_key", "trans_id"} & set(seen[0].columns)


def test_mapping_is_written_only_for_its_readers(spark, tmp_path, monkeypatch):
    path = _tables(spark, tmp_path)
    written = []
    write = gr.checkpointed
    monkeypatch.setattr(gr, "checkpointed", lambda df: written.append(df.columns) or write(df))
    _, vectors = gq.count_graph(spark, path)
    assert {kind: v.count() for kind, v in vectors.items()} == {
        "customer": 6, "product": 5, "store": 4,
    }
    assert not [c for c in written if "customer_idx" in c]
    lazy = gr.materialize(graph(spark, path), mapping=False).mapping
    assert _set(lazy, "*") == _set(gr.materialize(graph(spark, path)).mapping, "*")


def test_fit_of_scoring_carries_no_line_key(spark, tmp_path):
    path = _tables(spark, tmp_path)
    built, _, rows = mq.line_vectors(spark, path, key=())
    assert rows.columns == ["fraud_label", "x"] and rows.count() == 60
    assert sorted(built.mapping.columns) == [
        "customer_idx", "fraud_label", "product_idx", "store_idx",
    ]
    keyed = mq.line_vectors(spark, path)[2]
    assert _set(rows, "*") == _set(keyed.select("fraud_label", "x"), "*")
