from __future__ import annotations

from pulsegrid.operators import graph
from pulsegrid.plans import graph_queries
from tests.test_whole import events


def test_influence_signals_by_hand(spark, tmp_path):
    # 2 -> 1 mentions, 3 -> 2 follows (k = 0, 1, 2: follow, like, mention)
    d = events(spark, tmp_path, [(1, "a", 6), (2, "a", 4), (3, "a", 2)])
    got = {r["id"]: r["influence"] for r in graph_queries.top_influencers(spark, d).collect()}
    users = spark.createDataFrame([("x:1",), ("x:2",), ("x:3",)], "id string")
    rank = {r["id"]: r["pagerank"] for r in graph.pagerank(users, spark.createDataFrame([("x:2", "x:1"), ("x:3", "x:2")], "src string, dst string"), tolerance=1e-12).collect()}
    # likes 6, 4, 2; replies and reposts 0, 1, 2; quotes null, 1, 0; reach 100, 200, 300
    impact, received, activity = {1: 6, 2: 6, 3: 6}, {1: 1, 2: 3, 3: 2}, {1: 6, 2: 8, 3: 7}
    for i in (1, 2, 3):
        want = 100 * (0.30 * impact[i] / 6 + 0.25 * rank[f"x:{i}"] / max(rank.values()) + 0.15 * i / 3 + 0.20 * received[i] / 3 + 0.10 * activity[i] / 8)
        assert abs(got[f"x:{i}"] - want) < 0.011


def test_regions(spark):
    from pulsegrid.operators.normalize import region
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Mumbai, India",), ("Pune",), ("New Delhi",), ("Kochi",), ("Berlin",), (None,)], "place string")
    assert [r[0] for r in rows.select(region(F.col("place"))).collect()] == ["India", "Maharashtra", "Delhi", "Kerala", "Other", "Other"]
