"""Betweenness by frontiers, PageRank's stop and communities against plain Python."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import graph as G
from pulsegrid.plans import graph_queries, views
from tests.test_no_sql import paths_through

SF = "/root/testdata/sf0.001"


def made(seed, n=14, m=30):
    dice = np.random.default_rng(seed)
    return {(f"n{a}", f"n{b}") for a, b in dice.integers(0, n, (m, 2)).tolist() if a != b}


def test_frontiers_give_the_betweenness_of_small_tasks(spark):
    graphs = {"a": made(1), "b": made(2, 8, 9), "c": {("x", "y")}, "d": {("p", "q"), ("q", "r"), ("r", "s"), ("p", "t"), ("t", "r")}}
    rows = [(g, s, d) for g, e in graphs.items() for s, d in e] + [("a", None, "n1")]
    frame = spark.createDataFrame(rows, "g string, src string, dst string")
    want = {(g, v): x for g, e in graphs.items() for v, x in paths_through(e).items()}
    for small in (0, 8, 1_000):
        got = {(r["g"], r["id"]): r["betweenness"] for r in G.betweenness(frame, "g", small).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want), small


def test_sampled_sources_are_unbiased_within_their_bound(spark):
    edges = made(5, 40, 160)
    frame = spark.createDataFrame([("g", s, d) for s, d in edges], "g string, src string, dst string")
    want, got = paths_through(edges), {r["id"]: r["betweenness"] for r in G.betweenness(frame, "g", 0, 0.5).collect()}
    top = max(want.values())
    assert set(got) == set(want) and np.mean([abs(got[v] - want[v]) for v in want]) < 0.5 * top


def plain_rank(ids, edges, tolerance):
    out = defaultdict(set)
    for s, d in edges:
        if d in ids:
            out[s].add(d)
    rank, rounds = dict.fromkeys(ids, 1 / len(ids)), 0
    while True:
        loose = sum(r for i, r in rank.items() if not out[i])
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * loose / len(ids))
        for i in ids:
            for d in out[i]:
                new[d] += 0.85 * rank[i] / len(out[i])
        change, rank, rounds = sum(abs(new[i] - rank[i]) for i in ids), new, rounds + 1
        if change < tolerance or rounds == 100:
            return rank


def test_pagerank_stops_with_the_first_small_change(spark):
    edges = made(7, 20, 50) | {("n1", "lost")}
    ids = sorted({x for e in edges for x in e} - {"lost"}) + ["alone"]
    frame = spark.createDataFrame(list(edges), "src string, dst string")
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    for tolerance in (1e-2, 1e-6):
        want = plain_rank(ids, edges, tolerance)
        got = {r["id"]: r["pagerank"] for r in G.pagerank(nodes, frame, tolerance=tolerance).collect()}
        assert set(got) == set(ids) and all(abs(got[i] - want[i]) < 6e-9 for i in ids)


def plain_communities(ids, edges, rounds=10):
    weight: dict = defaultdict(lambda: defaultdict(float))
    for s, d, w in edges:
        if s != d and s in ids and d in ids:
            weight[s][d] += w
            weight[d][s] += w
    label, still = {i: i for i in ids}, 0
    for k in range(2 * rounds):
        new = dict(label)
        for i in ids:
            if zlib.crc32(i.encode()) % 2 == k % 2 and weight[i]:
                votes: dict = defaultdict(float)
                for d, w in weight[i].items():
                    votes[label[d]] += w
                new[i] = min(votes, key=lambda v: (-votes[v], v != label[i], v))
        still = still + 1 if new == label else 0
        label = new
        if still == 2:
            break
    total = sum(w for own in weight.values() for w in own.values())
    q = sum((label[s] == label[d]) * w for s, own in weight.items() for d, w in own.items()) / total if total else 0.0
    degree: dict = defaultdict(float)
    for s, own in weight.items():
        degree[label[s]] += sum(own.values())
    return label, q - sum((x / total) ** 2 for x in degree.values()) if total else 0.0


def test_communities_against_plain_propagation(spark):
    dice = np.random.default_rng(11)
    rows = [(f"u{g}{a}", f"u{g}{b}", float(dice.integers(1, 5))) for g in range(4) for a, b in dice.integers(0, 8, (22, 2)).tolist()]
    rows += [("u00", "u10", 1.0), ("u20", "u30", 1.0), ("u00", "stranger", 9.0), ("u01", "u01", 5.0)]
    ids = sorted({x for s, d, _ in rows for x in (s, d)} - {"stranger"}) + ["hermit"]
    label, q = plain_communities(set(ids), rows, 3)
    found = G.communities(spark.createDataFrame([(i,) for i in [*ids, None]], "id string"), spark.createDataFrame(rows, "src string, dst string, weight double"), 3).collect()
    assert {r["id"]: r["community"] for r in found} == label
    assert all(abs(r["modularity"] - q) < 1e-6 and r["size"] == sum(x == r["community"] for x in label.values()) for r in found) and q > 0.4


def test_a_dense_evenly_timed_day_is_flagged(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 5, 1)
    # three accounts, each linked to the others in a ring and back, a post a second: dense; a path through each
    posts = [("day", f"x:{i % 3}", t0 + dt.timedelta(seconds=i), i, ["#a"]) for i in range(30)]
    other = [("calm", f"x:{i % 5}", t0 + dt.timedelta(hours=i * i), 100 + i, []) for i in range(9)]
    links = [("day", f"x:{a}", f"x:{b}", "reply", t0, str(a)) for a in range(3) for b in range(3) if a != b] + [("calm", "x:1", "x:2", "like", t0, "9")]
    frame = spark.createDataFrame(posts + other, "day string, id string, published_at timestamp, event_id long, hashtags array<string>")
    edges = spark.createDataFrame(links, "day string, src string, dst string, kind string, published_at timestamp, event_id string")
    got = {r["day"]: r for r in G.analyze_network(frame, edges, "day").collect()}
    assert got["day"]["density"] == 1.0 and got["day"]["deviation_ms"] == 0.0 and got["day"]["mean_ms"] == 1000.0 and got["day"]["overlap"] == 1.0
    assert not got["day"]["suspected"] and not got["calm"]["suspected"]  # a complete graph has no one between
    flags = spark.createDataFrame([(0.8, 0.7, 2, 1999.0, 499.0), (0.75, 0.7, 2, 1.0, 1.0), (0.8, 0.65, 2, 1.0, 1.0), (0.8, 0.7, 1, 1.0, 1.0), (0.8, 0.7, 2, 2000.0, 1.0), (0.8, 0.7, 2, 1.0, 500.0)], "a double, b double, c int, d double, e double")
    assert [r[0] for r in flags.select(G.coordinated(flags["a"], flags["b"], flags["c"], flags["d"], flags["e"])).collect()] == [True] + [False] * 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_registered_communities(spark):
    rows = defaultdict(float)
    for r in views.links(spark, SF).where("kind <> 'like'").collect():
        rows[r["src"], r["dst"]] += G.EDGE_WEIGHTS[r["kind"]]
    ids = {f"x:{r['user_id']}" for r in views.posts(spark, SF).collect() if r["user_id"] is not None}
    label, q = plain_communities(ids, [(s, d, w) for (s, d), w in rows.items()])
    found = graph_queries.communities(spark, SF).collect()
    assert {r["id"]: r["community"] for r in found} == label and all(abs(r["modularity"] - q) < 1e-6 for r in found)


def test_a_large_graph_is_solved_by_tasks_for_a_share_of_its_sources_each(spark, monkeypatch):
    """3,000 edges went by frontiers, a round of joins for each step of the longest path."""
    chain = [("long", f"c{i:04}", f"c{i + 1:04}") for i in range(3_000)]
    some = made(9, 12, 40)
    frame = spark.createDataFrame([*chain, *(("some", s, d) for s, d in some)], "g string, src string, dst string")
    monkeypatch.setattr(G, "_frontier_betweenness", None)
    monkeypatch.setattr(G, "WORK", 100)
    monkeypatch.setattr(G, "PARTS", 7)
    got = {(r["g"], r["id"]): r["betweenness"] for r in G.betweenness(frame, "g").collect()}
    want = {("some", v): x for v, x in paths_through(some).items()} | {("long", f"c{i:04}"): i * (3_000 - i) / (3_000 * 2_999) for i in range(3_001)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_credits_of_sources_taken_singly_or_together(monkeypatch):
    starts, nexts = np.array([0, 2, 3, 4, 4]), np.array([1, 2, 3, 3])  # two ways from 0 to 3
    whole = G._credits(starts, nexts, np.arange(4))
    monkeypatch.setattr(G, "TOGETHER", 1)
    assert whole.tolist() == G._credits(starts, nexts, np.arange(4)).tolist() == [0.0, 0.5, 0.5, 0.0]
    assert G._credits(starts, nexts, np.arange(0)).tolist() == [0.0] * 4


def test_sizes_estimated_in_loops_stay_those_of_the_rows(spark):
    """The estimates of checkpointed joins double their digits each round."""
    from pulsegrid.session import stored

    state = spark.range(5)
    for _ in range(4):
        state = stored(state.join(state.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert sorted(r["id"] for r in state.collect()) == [0, 1, 2, 3, 4]
    assert int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000
    assert stored(state.where("id > 9")).collect() == []


def test_flags_of_a_large_day_need_no_frontiers(spark, monkeypatch):
    import datetime as dt

    monkeypatch.setattr(G, "_frontier_betweenness", None)
    t0 = dt.datetime(2024, 5, 1)
    links = [("day", f"c{i:04}", f"c{i + 1:04}", "like", t0, str(i)) for i in range(2_100)]
    posts = [("day", f"c{i:04}", t0 + dt.timedelta(minutes=i), i, ["#a"]) for i in range(12)]
    frame = spark.createDataFrame(posts, "day string, id string, published_at timestamp, event_id long, hashtags array<string>")
    edges = spark.createDataFrame(links, "day string, src string, dst string, kind string, published_at timestamp, event_id string")
    got = G.analyze_network(frame, edges, "day").first()
    want = sum(i * (2_100 - i) for i in range(1, 11)) / (2_100 * 2_099) / 10
    assert abs(got["avg_betweenness"] - want) < 2e-6 and got["suspected"] is False
