"""The fifteen-feature vectors are read from one written frame."""

from __future__ import annotations

from riskgraph.plans.catalog import model_queries as mq

SF = "/root/testdata/sf0.001"


def test_vectors_are_not_written_beside_their_source(spark, monkeypatch):
    written = []
    plain = mq.checkpointed
    monkeypatch.setattr(mq, "checkpointed", lambda df: written.append(df.columns) or plain(df))
    points = mq.fifteen(spark, SF)
    assert points.columns == ["txn_key", "x"] and len(points.first()["x"]) == 15
    assert written == [["txn_key", *mq.CLUSTERING_FEATURES]]
