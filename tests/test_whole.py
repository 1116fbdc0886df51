"""Queries that read whole tables: rows that a narrower reading would leave out."""

from __future__ import annotations

from datetime import datetime, timedelta

from pulsegrid.plans import graph_queries, trend_queries, views

START = datetime(2024, 1, 1)


def events(spark, path, rows):
    """A folder with an events table of (user, trend, value) rows, an hour apart."""
    full = [(i, START + timedelta(hours=i), u, t, float(v), f'{{"k": {i}}}') for i, (u, t, v) in enumerate(rows)]
    spark.createDataFrame(full, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_snapshots_hold_events_of_all_users(spark, tmp_path):
    d = events(spark, tmp_path, [(4, "a", 100), (8, "b", 50), (3, "a", 300)])  # b only by a user whose id four divides
    got = {r["trend"]: (r["engagement"], r["score"]) for r in views.snapshots(spark, d).collect()}
    assert got == {"a": (400.0, 40.0), "b": (50.0, 10.0)}
    assert {r["trend"] for r in trend_queries.leaderboard(spark, d).collect()} == {"a", "b"}


def test_all_users_are_nodes(spark, tmp_path):
    d = events(spark, tmp_path, [(3, "a", 1), (1, "a", 1), (6, "a", 1), (None, "b", 1)])  # 1 -> 3, 6 -> 1
    got = {r["id"]: (r["in_degree"], r["out_degree"], r["degree_centrality"]) for r in graph_queries.degree_centrality(spark, d).collect()}
    assert got == {"x:3": (1, 0, 0.25), "x:1": (1, 1, 0.5), "x:6": (0, 1, 0.25)}
    summary = graph_queries.graph_summary(spark, d).first()
    assert (summary["nodes"], summary["observed"], summary["external"], summary["edges"]) == (3, 3, 0, 2)
    assert graph_queries.anti_new_nodes(spark, d).count() == 0
    assert graph_queries.semi_edges_topk(spark, d).count() == 2
