from __future__ import annotations

from pulsegrid.operators import graph


def test_large_graphs_leave_the_small_tasks(spark, monkeypatch):
    """A ring of 20 and a chain without a name beside one of three: those over the bound go by frontiers."""
    ring = [("ring", f"n{i:02}", f"n{(i + 1) % 8:02}") for i in range(8)]
    nameless = [(None, f"n{i}", f"n{i + 1}") for i in range(6)]
    edges = spark.createDataFrame([*ring, *nameless, ("chain", "a", "b"), ("chain", "b", "c")], "day string, src string, dst string")
    seen: list = []
    kept = graph._frontier_betweenness
    monkeypatch.setattr(graph, "_frontier_betweenness", lambda links, by, share: seen.append(links.select(by).distinct().count()) or kept(links, by, share))
    whole = {tuple(r) for r in graph.betweenness(edges, "day").collect()}
    assert not seen
    assert {tuple(r) for r in graph.betweenness(edges, "day", 5).collect()} == whole and seen == [2]
    assert ("chain", "b", 0.5) in whole and ("ring", "n07", 0.5) in whole
    assert {r for r in whole if r[0] is None} == {(None, f"n{i}", round(i * (6 - i) / 30, 6)) for i in range(7)}
