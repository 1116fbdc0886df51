"""Keyed state over several batches and a restart, against the batch operators and plain Python."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import numpy as np
import pytest

from pulsegrid.operators import distributions as D
from pulsegrid.streaming import state as T

T0 = dt.datetime(2024, 1, 1)


class Source:
    """Files that arrive one batch after the other; every run is a query of its own over the same checkpoint."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.schema, self.build, self.seen = spark, folder, schema, build, []
        T.stateful(spark)

    def run(self, rows):
        if rows:
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        found = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        got = []
        query = found.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/cp").trigger(availableNow=True)
        query.foreachBatch(lambda b, _: got.extend(b.collect())).start().awaitTermination()
        self.seen += got
        return got


@pytest.fixture(autouse=True)
def restored(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_score_histories_equal_one_batch_and_go_when_stale(spark, tmp_path):
    source, dice = Source(spark, tmp_path, "trend string, captured_at timestamp, score double", T.score_histories), np.random.default_rng(1)
    batches = [[(f"t{k % 3}", hours(40 * b + int(dice.integers(0, 40))), float(dice.integers(0, 90))) for k in range(30)] for b in range(2)]
    batches[0] += [("t0", hours(30 + k / 60), float(k)) for k in range(120)] + [("old", hours(0), 7.0), ("t1", None, 1.0), ("t1", hours(1), None)]
    late: dict = {}
    for rows in batches:
        for r in source.run(rows):
            late[r["trend"]] = (r["n"], r["newest"], r["previous"], r["peak"])
    every = defaultdict(list)
    for i, rows in enumerate(batches):
        for t, at, score in rows:
            if at is not None and score is not None:
                every[t].append((at, score, i))
    mark = max(at for t, at, *_ in batches[0] if at is not None) - dt.timedelta(hours=1)
    for t, own in every.items():
        kept = sorted(((at, s) for at, s, i in own if i == 0 or at > mark), reverse=True)[:100]
        assert late[t] == (len(kept), kept[0][1], kept[1][1] if len(kept) > 1 else None, max(s for _, s in kept)), t
    source.run([("new", hours(24 * 30), 1.0)])  # the watermark passes all of them
    source.run([("new", hours(24 * 30 + 1), 2.0), ("t0", hours(24 * 30), 5.0)])
    assert {r["trend"]: r["n"] for r in source.seen[-2:]} == {"new": 2, "t0": 1}


def test_narrative_pools_keep_the_newest_of_a_week(spark, tmp_path):
    source = Source(spark, tmp_path, "label string, narrative string, seen_at timestamp", T.narrative_pools)
    batches = [
        [("pos", f"n{k}", hours(k)) for k in range(60)] + [("neg", "x", hours(0)), ("neg", None, hours(1))],
        [("pos", "n0", hours(61)), ("pos", "n59", hours(59)), ("pos", "z", hours(61)), ("neg", "y", hours(24 * 7))],
    ]
    late: dict = {}
    for rows in batches:
        for r in source.run(rows):
            late[r["label"]] = r["narratives"]
    seen = {f"n{k}": k for k in range(10, 60)} | {"n0": 61, "z": 61}
    assert late["pos"] == sorted(seen, key=lambda n: (-seen[n], n))[:50]
    assert late["neg"] == ["y"]  # the other was seen a week before
    source.run([("other", "o", hours(24 * 40))])
    source.run([("other", "p", hours(24 * 41))])
    assert {r["label"]: r["narratives"] for r in source.seen if not r["narratives"]} == {"pos": [], "neg": []}


def test_results_in_three_batches_give_one_row(spark, tmp_path):
    source = Source(spark, tmp_path, "run_id long, category string, payload string, at timestamp", T.awaited_runs)
    batches = [
        [(1, "sentiment", "s", hours(0)), (1, "trend", "t", hours(0)), (2, "sentiment", "a", hours(0)), (2, "sentiment", "b", hours(0)), (3, "network", "n", hours(0)), (3, "weather", "w", hours(0))],
        [(1, "demographic", "d", hours(1)), (2, "trend", None, hours(1)), (2, "network", "n", hours(1)), (2, "demographic", "d", hours(1))],
        [(1, "network", "n", hours(2)), (1, "network", "m", hours(2))],
    ]
    got = [[r["run_id"] for r in source.run(rows)] for rows in batches]
    assert got == [[], [2], [1]]
    assert source.run([(1, "network", "late", hours(3)), (2, "trend", "late", hours(3))]) == []
    source.run([(9, "trend", "t", hours(40))])  # the watermark passes the others' timers
    source.run([(9, "trend", "t", hours(41))])
    source.run([(8, "trend", "t", hours(42))])  # and nothing is reported twice
    assert sorted(r["run_id"] for r in source.seen) == [1, 2, 3]
    want = {r["run_id"]: tuple(r) for r in D.fan_in(spark.createDataFrame([r[:3] for rows in batches for r in rows], "run_id long, category string, payload string")).collect()}
    assert {r["run_id"]: tuple(r) for r in source.seen} == {k: want[k] for k in (1, 2, 3)}
