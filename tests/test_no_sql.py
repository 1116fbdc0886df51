"""Queries without SQL against plain Python over the smallest tables."""

from __future__ import annotations

import os
import re
from collections import defaultdict, deque

import pytest

from pulsegrid.operators import integrity
from pulsegrid.plans import graph_queries, more_queries, views
from pulsegrid.session import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def paths_through(edges: set[tuple[str, str]]) -> dict[str, float]:
    """Betweenness by counting shortest paths of every pair."""
    ids, out = sorted({x for e in edges for x in e}), defaultdict(list)
    for s, d in edges:
        out[s].append(d)
    dist, count = {}, {}
    for s in ids:
        far, n, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            v = todo.popleft()
            for w in out[v]:
                if w not in far:
                    far[w], n[w] = far[v] + 1, 0
                    todo.append(w)
                if far[w] == far[v] + 1:
                    n[w] += n[v]
        dist[s], count[s] = far, n
    total = dict.fromkeys(ids, 0.0)
    for s in ids:
        for t in dist[s]:
            for v in ids:
                if v not in (s, t) and s != t and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    total[v] += count[s][v] * count[v][t] / count[s][t]
    scale = (len(ids) - 1) * (len(ids) - 2)
    return {v: total[v] / scale if len(ids) > 2 else 0.0 for v in ids}


def test_betweenness_and_flags(spark):
    days = defaultdict(set)
    for r in views.links(spark, SF).collect():
        days[r["published_at"].strftime("%Y-%m-%d")].add((r["src"], r["dst"]))
    want = {(day, v): x for day, edges in days.items() for v, x in paths_through(edges).items()}
    got = {(r["day"], r["id"]): r["betweenness"] for r in graph_queries.betweenness(spark, SF).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    posted = defaultdict(set)
    for r in views.posts(spark, SF).where("user_id is not null").select("published_at", "user_id").collect():
        posted[r["published_at"].strftime("%Y-%m-%d")].add(f"x:{r['user_id']}")
    for r in more_queries.network_flags(spark, SF).collect():
        degree = defaultdict(int)
        for e in days[r["day"]]:
            for x in e:
                degree[x] += 1
        top = sorted(posted[r["day"]], key=lambda i: (-degree[i], i))[:10]
        assert abs(r["avg_betweenness"] - sum(want.get((r["day"], i), 0.0) for i in top) / len(top)) < 1e-5 and r["suspected"] is False


def test_mentions_and_tags_of_documents(spark):
    def distinct(items):
        seen, out = set(), []
        for x in items:
            if x.lower() not in seen:
                seen.add(x.lower())
                out.append(x)
        return ",".join(out)

    want = set()
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        m = distinct(re.findall(r"(?<![^\W]|@)@([A-Za-z0-9_]+)", r["text"].replace(" re", " @re")))
        t = distinct(re.findall(r"(?<![^\W]|#)#([^\W\d_][\w-]*)", r["text"].replace(" T", " #T")))
        if m or t:
            want.add((r["doc_id"], m, t))
    assert {(r["doc_id"], r["mentions"], r["tags"]) for r in graph_queries.mentions_of_documents(spark, SF).collect()} == want


def test_merkle_roots(spark):
    by = defaultdict(list)
    for r in graph_queries.field_leaves(spark, SF).collect():
        by[r["id"].split("@")[0]].append((r["id"], r["field"], bytes.fromhex(r["leaf"][2:])))

    def root(level):
        while len(level) > 1:
            level = [integrity.keccak256(min(level[i : i + 2]) + max(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return "0x" + level[0].hex()

    got = {r["batch"]: (r["root"], r["leaves"], r["all_ok"]) for r in graph_queries.merkle_roots(spark, SF).collect()}
    dealt = {f"{b}#{k // 100}": sorted(rows)[k : k + 100] for b, rows in by.items() for k in range(0, len(rows), 100)}
    assert got == {b: (root([x[2] for x in rows]), len(rows), True) for b, rows in dealt.items()}
