"""Operators that avoid sorting or collecting whole groups, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pulsegrid.operators import distributions, ranking, trend

DICE = random.Random(5)
START = datetime(2024, 1, 1)


def test_values_at_ranks_are_exact(spark, monkeypatch):
    rows = [(DICE.choice(["a", "b", None]), None if DICE.random() < 0.05 else round(DICE.expovariate(0.01), 1)) for _ in range(3000)] + [("one", 5.0)]
    table = spark.createDataFrame(rows, "g string, x double")
    for accuracy in (10_000, 50):
        monkeypatch.setattr(distributions, "ACCURACY", accuracy)
        got = {r["g"]: r for r in distributions.nearest_rank(table, "x", {"low": 0.0, "p50": 0.5, "p95": 0.95, "top": 1.0}, "g").collect()}
        assert set(got) == {"a", "b", None, "one"}
        for g, r in got.items():
            xs = sorted(x for k, x in rows if k == g and x is not None)
            at = lambda q: xs[min(int(len(xs) * q), len(xs) - 1)]  # noqa: E731, B023
            assert (r["n"], r["min"], r["max"], r["low"], r["p50"], r["p95"], r["top"]) == (len(xs), xs[0], xs[-1], at(0), at(0.5), at(0.95), xs[-1])


def test_kept_share_with_ties_and_nulls(spark):
    rows = [(i, DICE.choice([1.0, 2.0, 3.0, None])) for i in range(200)]
    table = spark.createDataFrame(rows, "id int, s double")
    for least, share in ((2, 0.3), (190, 0.1), (0, 0.0), (3, 1.0)):
        most = max(least, int(200 * share + 0.5))
        want = sorted(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:most])
        assert sorted(tuple(r) for r in distributions.kept_by_share(table, "s", "id", least, share).collect()) == want


def test_value_before_in_a_series_over_slots(spark):
    rows = [(i, DICE.choice(["a", "b", None]), START + timedelta(minutes=DICE.choice([0, 0, 1, 7, 11, 500]), seconds=DICE.randrange(30)), DICE.choice([1, 2, 3, None])) for i in range(300)]
    table = spark.createDataFrame(rows, "id int, g string, at timestamp, v int")
    got = {r["id"]: r["previous"] for r in trend.before(table, "v", "g", "at", "id").collect()}
    for g in ("a", "b", None):
        series = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in series] == [None, *(r[3] for r in series[:-1])]


def test_every_trend_in_every_batch(spark):
    rows = [("a", START, 1), ("b", START, 2), ("a", START + timedelta(days=1), 1), ("c", START + timedelta(days=2), 1)]
    got = sorted((r["trend"], r["captured_at"], r["rank"]) for r in ranking.densified(spark.createDataFrame(rows, "trend string, captured_at timestamp, rank int")).collect())
    known = {(t, d): r for t, d, r in rows}
    assert got == [(t, START + timedelta(days=d), known.get((t, START + timedelta(days=d)))) for t in "abc" for d in range(3)]
