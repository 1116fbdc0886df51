"""Crossings of moving averages against plain Python, for many pairs of windows in one plan."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import rules as P
from pulsegrid.operators import sinks as K


def test_many_pairs_of_windows_in_one_plan(spark):
    dice, day = np.random.default_rng(3), dt.datetime(2024, 1, 1)
    closes = {i: [None if dice.random() < 0.04 else int(dice.integers(0, 50)) for _ in range(90)] for i in ("a", "b")} | {"short": [5, 6]}
    prices = spark.createDataFrame([(i, day + dt.timedelta(days=k), c) for i, own in closes.items() for k, c in enumerate(own)], "instrument string, date timestamp, close long")
    asked = [(f"{i}-{s}-{t}-{way}", i, "ma_cross", way, s, t) for i in ("a", "b", "short", "none") for s in range(1, 8) for t in range(s + 1, 12) for way in ("above", "below")]
    asked += [("a-1-2-above", "a", "ma_cross", "above", 1, 2), ("level", "a", "level", "above", 1, 2)]
    rules = spark.createDataFrame(asked, "rule_id string, instrument string, type string, direction string, short int, long int")
    want = []
    for rule, i, kind, way, s, t in asked:
        own, before = closes.get(i, []), None
        for k in range(len(own) if kind == "ma_cross" else 0):
            last = own[k + 1 - t : k + 1] if k + 1 >= t else []
            g = int(np.sign(sum(last[-s:]) * t - sum(last) * s)) if last and None not in last else None
            if g is not None and before is not None and (before <= 0 < g if way == "above" else before >= 0 > g):
                want.append((day + dt.timedelta(days=k), rule, i, way))
            before = g
    found = P.average_alerts(prices, rules)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 200
    few = P.average_alerts(prices, rules.limit(1))
    plan = lambda f: f._jdf.queryExecution().optimizedPlan().toString().count("Window")
    assert plan(found) == plan(few)


def test_ties_of_labels_and_of_absent_keys(spark):
    at = dt.datetime(2024, 1, 1)
    rows = lambda *r: spark.createDataFrame(list(r), "trend_key string, label string, first_seen timestamp, last_seen timestamp")
    found = K.upsert_trends(rows(("t", "B", at, at)), rows(("t", "a", at, at), ("t", "A", at, at))).collect()
    assert [(r["label"], r["status"]) for r in found] == [("a", "active")]
    new = spark.createDataFrame([(1, "z"), (1, "b"), (2, "c")], "k long, v string")
    assert [tuple(r) for r in K.insert_absent(new.where("k = 2"), new, ["k"]).collect()] == [(1, "b")]
    assert [tuple(r) for r in K.insert_absent(new.where("k = 2").select("k"), new.select("k"), ["k"]).select(F.col("k")).collect()] == [(1,)]
