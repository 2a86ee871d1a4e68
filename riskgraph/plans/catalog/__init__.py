"""All registered queries."""

from riskgraph.plans.catalog import (  # noqa: F401
    evaluation_queries,
    feature_queries,
    graph_queries,
    label_queries,
    model_queries,
)
from riskgraph.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
