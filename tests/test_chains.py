"""Betweenness of graphs with chains: nodes that one edge ends and one begins in, which begin no search of their own."""

from __future__ import annotations

from threading import Timer

import numpy as np

from pulsegrid.operators import graph as G
from tests.test_no_sql import paths_through


def stretched(seed, n, m):
    """A graph, loops among it, with nodes put into its edges, some edges twice, and rings of their own."""
    dice, edges = np.random.default_rng(seed), set()
    for k, (a, b) in enumerate(dice.integers(0, n, (m, 2)).tolist()):
        path = [f"n{a}", *(f"e{k}.{i}" for i in range(dice.choice([0, 0, 1, 2, 4]))), f"n{b}"]
        edges |= set(zip(path, path[1:], strict=False))
    return edges | {(f"r{k}.{i}", f"r{k}.{(i + 1) % k}") for k in (2, 4, 5)[: seed % 4] for i in range(k)}


def test_long_chains_take_no_search_a_node(spark):
    """30,000 nodes, each a search of up to 30,000 steps, were not done in an hour; the job is ended after a minute."""
    n = 30_000
    chain = spark.range(n).selectExpr("'long' AS g", "format_string('c%05d', id) AS src", "format_string('c%05d', id + 1) AS dst")
    ring = spark.range(n).selectExpr("'ring' AS g", "format_string('r%05d', id) AS src", f"format_string('r%05d', (id + 1) % {n}) AS dst")
    late = Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = {(r["g"], r["id"]): r["betweenness"] for r in G.betweenness(chain.unionByName(ring), "g").collect()}
    finally:
        late.cancel()
    assert all(abs(got["long", f"c{i:05}"] - i * (n - i) / (n * (n - 1))) < 2e-6 for i in range(n + 1))
    assert {got["ring", f"r{i:05}"] for i in range(n)} == {0.5} and len(got) == 2 * n + 1


def test_chains_have_the_betweenness_of_plain_counting(spark):
    graphs = {f"g{seed}": stretched(seed, 2 + seed, 4 + 2 * seed) for seed in range(10)}
    graphs |= {"loop": {("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "a")}, "alone": {("a", "a")}, "pair": {("a", "b"), ("b", "a")}, "ways": {("a", "x"), ("x", "z"), ("a", "y"), ("y", "z"), ("z", "t"), ("t", "a")}}
    frame = spark.createDataFrame([(g, s, d) for g, e in graphs.items() for s, d in e], "g string, src string, dst string")
    got = {(r["g"], r["id"]): r["betweenness"] for r in G.betweenness(frame, "g").collect()}
    want = {(g, v): x for g, e in graphs.items() for v, x in paths_through(e).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_copies_of_users_in_a_row_begin_one_search_for_all():
    """Tables repeated with shifted keys: a user's copies follow each other, so their searches are those of the first."""
    dice = np.random.default_rng(3)
    walk, copies = np.concatenate([dice.permutation(50), dice.integers(0, 50, 150)]), 20
    at = np.concatenate([u * copies + np.arange(copies) for u in walk])  # the copies of each event, one after another
    pairs = np.unique(np.stack([at[1:], at[:-1]], 1)[at[1:] != at[:-1]], axis=0)
    folded = G._folded(pairs[:, 0], pairs[:, 1], 50 * copies)
    assert len(folded["starts"]) - 1 <= 2 * 50 and folded["inner"].max() >= copies - 2
    assert (folded["place"] > 0).sum() + len(folded["starts"]) - 1 == 50 * copies


def test_sources_dealt_over_parts_add_up(monkeypatch):
    edges = sorted(stretched(7, 9, 20))
    ids = sorted({x for e in edges for x in e})
    src, dst = (np.array([ids.index(e[k]) for e in edges if e[0] != e[1]]) for k in (0, 1))
    folded = G._folded(src, dst, len(ids))
    args, n = (folded["starts"], folded["nexts"]), len(folded["starts"]) - 1

    def solved(parts):
        sums = np.zeros((4, len(args[1])))
        return sum(G._credits(*args, np.arange(p, n, parts), folded["inner"], sums) for p in range(parts)), sums

    whole, sums = solved(1)
    monkeypatch.setattr(G, "TOGETHER", 1)
    for parts in (1, 3, n + 2):
        credit, some = solved(parts)
        assert np.allclose(credit, whole) and np.allclose(some, sums)


def test_flags_of_a_day_of_long_chains(spark):
    """The same for the flags: 20,000 accounts that each answer the next one."""
    import datetime as dt

    n, t0 = 20_000, dt.datetime(2024, 5, 1)
    chain = spark.range(n).selectExpr("'day' AS day", "format_string('c%05d', id) AS src", "format_string('c%05d', id + 1) AS dst", "'reply' AS kind", "timestamp'2024-05-01' AS published_at", "cast(id AS string) AS event_id")
    posts = [("day", f"c{i:05}", t0 + dt.timedelta(minutes=i), i, ["#a"]) for i in range(12)]
    frame = spark.createDataFrame(posts, "day string, id string, published_at timestamp, event_id long, hashtags array<string>")
    late = Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = G.analyze_network(frame, chain, "day").first()
    finally:
        late.cancel()
    want = sum(i * (n - i) for i in range(1, 11)) / (n * (n - 1)) / 10  # the ten of degree two with the smallest names
    assert abs(got["avg_betweenness"] - want) < 2e-6 and got["suspected"] is False and got["edges"] == n


def test_links_are_read_once(spark):
    """Nodes, edges, sizes, names and the graphs each read the links anew, on large tables most of the time."""
    import datetime as dt

    t0, read = dt.datetime(2024, 5, 1), spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            read.add(len(rows))
            yield rows

    made = [("day", a, b, "reply", t0, a + b) for a, b in sorted(stretched(5, 8, 20)) if a != b]
    shape = "day string, src string, dst string, kind string, published_at timestamp, event_id string"
    links = spark.createDataFrame(made, shape).mapInPandas(counted, shape)
    posts = spark.createDataFrame([("day", "n1", t0, 1, ["#a"])], "day string, id string, published_at timestamp, event_id long, hashtags array<string>")
    assert G.betweenness(links, "day").count() and read.value == len(made)
    assert G.analyze_network(posts, links, "day").collect() and read.value == 2 * len(made)
