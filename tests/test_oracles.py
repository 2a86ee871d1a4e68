"""Registered queries against their SQL texts in DuckDB.

One query per family by default; RISKGRAPH_ALL_ORACLES=1 runs every text.
"""

import os

import pytest
from conftest import SF
from oracle_check import compare, connect

import __spark_entry__ as entry

HEADLINE = [
    "s3_headered_csv", "s10_table_info", "s13_describe", "s14_missing_values", "k2_dense_ids",
    "k3_lookup_ids", "f3_price_level_flags", "f13_date_parts", "f36_event_gaps",
    "f38_same_product_time_gap", "f40_no_dates", "f42_cleanup", "f43_engineer_features",
    "a3_guest_free_aggregates", "a8_product_deviation", "l1_quantile_labels", "l6_minority_flag",
    "l10b_silhouette_rows", "l13_metric_fallbacks", "l19_best_per_algorithm", "l20_weighted_vote",
    "l22_keyed_sample", "g2_customer_nodes", "g6_buys_edges", "g13_v1_product_nodes",
    "p3_degree_neighbors_with_self", "p4_attention_neighbors", "p5_two_layers", "b1_random_split",
    "b3_stratified_folds", "e4_roc_auc", "e6_evaluation_record", "e10_pivot_f1",
    "e12_best_per_metric", "e15_composite_score", "x3_risk_level", "o2_f1_threshold",
    "o3_sampled_in_edges", "flagship_riskiest_customers",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("RISKGRAPH_ALL_ORACLES") else HEADLINE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) == ""


def test_every_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 20
