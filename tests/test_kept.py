"""Commits over several tables and the score registry, against plain Python."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import commits as C
from pulsegrid.operators import scoreboard as B

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_nothing_is_seen_of_a_collection_that_fails_between_two_tables(spark, tmp_path):
    root, schema = f"file://{tmp_path}/kept", "k long, v string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda t: sorted(map(tuple, C.read(spark, root, t, schema).select("k", "v").collect()))
    assert read("events") == [] and C.commit(spark, root, "c1", {"events": rows((1, "a")), "edges": rows((1, "e"))})
    broken = rows((3, "x")).select(F.raise_error(F.lit("no edges")).cast("long").alias("k"), "v")
    with pytest.raises(Exception, match="no edges"):
        C.commit(spark, root, "c2", {"events": rows((2, "b")), "edges": broken})
    assert read("events") == [(1, "a")] and read("edges") == [(1, "e")]
    assert C.manifest(spark, root).count() == 1
    assert C.commit(spark, root, "c2", {"events": rows((2, "c")), "edges": rows((2, "f"))})  # the retry replaces the stage
    assert read("events") == [(1, "a"), (2, "c")] and read("edges") == [(1, "e"), (2, "f")]
    assert not C.commit(spark, root, "c2", {"events": rows((9, "z")), "edges": rows((9, "z"))})
    assert read("events") == [(1, "a"), (2, "c")]
    assert C.compact(spark, root, "c3", "events", schema, lambda r: r.groupBy("k").agg(F.max("v").alias("v"), F.max("sequence").alias("sequence")).where("k > 1"))
    assert read("events") == [(2, "c")] and read("edges") == [(1, "e"), (2, "f")]
    C.commit(spark, root, "c4", {"events": rows((4, "d"))})
    assert read("events") == [(2, "c"), (4, "d")] and read("missing") == []


def test_counters_are_replaced_and_texts_kept(spark):
    rows = [("x", 1, "text", 5, 9, 1, 0, 100, at(0)), ("x", 1, None, 3, None, 2, 0, 120, at(2)), ("x", 1, "late", 4, 7, 1, 0, 110, at(1)), ("x", 2, None, 1, 1, 1, 1, 1, at(0)), ("y", 1, "same", 1, 1, 1, 1, 1, at(0)), ("y", 1, "same", 2, 1, 1, 1, 1, at(0))]
    frame = spark.createDataFrame(rows, "platform string, event_id long, text string, likes long, replies long, reposts long, quotes long, views long, observed_at timestamp")
    got = {(r["platform"], r["event_id"]): r for r in C.upsert_events(frame).collect()}
    assert set(got) == {("x", 1), ("x", 2), ("y", 1)}
    one = got["x", 1]
    assert (one["text"], one["likes"], one["replies"], one["reposts"], one["views"], one["observed_at"]) == ("late", 3, None, 2, 120, at(2))
    assert got["y", 1]["likes"] == 2  # of equal times the larger row


def test_the_latest_row_of_a_snapshot_wins_whole(spark):
    rows = [("t", at(0), 1.0, None, 0), ("t", at(0), None, 2.0, 1), ("u", at(0), 5.0, 5.0, 0), ("u", at(0), 6.0, 1.0, 0)]
    frame = spark.createDataFrame(rows, "trend string, captured_at timestamp, score double, velocity double, sequence long")
    got = sorted((r["trend"], r["score"], r["velocity"]) for r in C.latest_snapshots(frame).collect())
    assert got == [("t", None, 2.0), ("u", 6.0, 1.0)]


def plain_standings(last):
    order = sorted(last, key=lambda m: (last[m][0], m))
    return {m: (last[m][0], i, len(order) - i, math.floor(100 * i / len(order) + 0.5)) for i, m in enumerate(order)}


def test_replayed_batches_give_the_ranks_of_all_members(spark, tmp_path, monkeypatch):
    root, dice = f"file://{tmp_path}/scores", np.random.default_rng(1)
    kept: dict = {}
    tiers = ["dormant", "emerging", "trending", "viral", "mega_viral", "odd", None]
    for batch in range(4):
        rows = []
        for _ in range(60):
            score = float([0.0, 0.0, 50.0, round(dice.random() * 100, 2), dice.random() * 1e-6, -3.25][dice.integers(6)])
            rows.append((f"m{dice.integers(80)}", score, tiers[dice.integers(7)], at(int(dice.integers(0, 400)))))
        rows += [(None, 1.0, "viral", at(1)), ("m1", None, "viral", at(900)), ("m2", float("nan"), "viral", at(900))]
        frame = spark.createDataFrame(rows, "member string, score double, tier string, captured_at timestamp")
        assert B.record(spark, root, f"b{batch}", frame) and not B.record(spark, root, f"b{batch}", frame)
        for m, s, t, c in rows:
            if m is not None and s is not None and s == s:
                kept.setdefault(m, []).append((c, s, t))
    order = {t: i for i, t in enumerate(tiers[:5])}
    key = lambda o: (o[0], o[1], o[2] is not None, o[2] or "")
    last = {m: max(o, key=key) for m, o in kept.items()}
    want = plain_standings({m: (o[1], o[2]) for m, o in last.items()})

    def check(asked):
        found = B.enrich(spark, root, spark.createDataFrame([(m,) for m in asked], "member string")).collect()
        assert len(found) == len({m for m in asked if m in want})
        for r in found:
            assert (r["score"], r["rank"], r["position"], r["percentile"]) == want[r["member"]] and r["total"] == len(want)
            own = sorted(kept[r["member"]], key=key, reverse=True)
            then = own[1] if len(own) > 1 else None
            assert r["score_delta"] == (own[0][1] - then[1] if then else None)
            moved = "stable" if then is None or then[2] == own[0][2] else "rising" if order.get(own[0][2], -1) > order.get(then[2], -1) else "falling"
            assert r["tier_movement"] == moved

    check(list(want))
    check(["m1", "m5", "m5", "nobody"])
    B.trim(spark, root, "t1", 2)
    check(list(want))
    newest = B.history(spark, root, spark.createDataFrame([("m3",)], "member string"))
    assert [r["place"] for r in newest.orderBy("place").collect()] == list(range(1, min(2, len(kept["m3"])) + 1))


def test_places_without_sorting_a_group_in_one_task(spark):
    rows = [("hot", float(i % 5), f"m{i % 400:03}") for i in range(3_000)] + [(None, 1.0, "a"), (None, 0.5, "b"), ("small", 2.0, "z")]
    frame = spark.createDataFrame(rows, "g string, score double, member string").repartition(7)
    found = B.row_numbers(frame, ["g"], ["score", "member"], "place").collect()
    for g in ("hot", None, "small"):
        own = sorted(((r["score"], r["member"], r["place"]) for r in found if r["g"] == g))
        assert [p for *_, p in sorted(own, key=lambda r: r[2])] == list(range(1, len(own) + 1))
        assert [(s, m) for s, m, _ in sorted(own, key=lambda r: r[2])] == [(s, m) for s, m, _ in own]


def test_tree_of_buckets(spark):
    dice = np.random.default_rng(3)
    n = {int(b): int(c) for b, c in zip(np.unique(np.concatenate([dice.integers(-(1 << 40), 1 << 40, 40), dice.integers(-300, 300, 60), [-(1 << 63), (1 << 63) - 1, 0, -1]])), dice.integers(1, 9, 200))}
    by = spark.createDataFrame(list(n.items()), "bucket long, n long")
    assert {r["bucket"]: r["below"] for r in B.below(by, by).collect()} == {b: sum(c for x, c in n.items() if x < b) for b in n}


def test_an_empty_registry(spark, tmp_path):
    nobody = spark.createDataFrame([("a",)], "member string")
    assert B.enrich(spark, f"file://{tmp_path}/none", nobody).collect() == []
