"""Keyed state that outlives micro-batches: score histories, narrative pools, and runs that await their results.

Each is a processor for transformWithStateInPandas with list or map state and event-time timers. State lies in the
cluster's state store (RocksDB) under the query's checkpoint, so a restart goes on where the last batch ended. Rows later
than the watermark are dropped by Spark before they get here; rows out of order within it are put in order here. A batch
of one key is read frame by frame, and what is kept of a key is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.operators.distributions import CATEGORIES

#: Scores kept of a trend, narratives of a label; days without an update after which they go; hours that a run waits.
SCORES, NARRATIVES, DAYS, WAITS = 100, 50, 7, 6
DAY, HOUR = 86_400_000, 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Sets the state store that list and map state need; before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def millis(times: pd.Series) -> list[int]:
    return [int(t.value // 1_000_000) for t in times]


class _Timed(StatefulProcessor):
    """Keeps one timer of a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class ScoreHistory(_Timed):
    """A trend's newest scores; gone when the watermark passes DAYS after the newest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.scores = handle.getListState("scores", "at long, score double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [(int(at), float(score)) for at, score in self.scores.get()]
        for frame in rows:
            kept = sorted([*kept, *zip(millis(frame["captured_at"]), frame["score"].tolist(), strict=True)], reverse=True)[:SCORES]
        self.scores.put(kept)
        self.wake(kept[0][0] + DAYS * DAY)
        values = [s for _, s in kept]
        yield pd.DataFrame({"trend": [key[0]], "n": [len(values)], "newest": [values[0]], "previous": [values[1] if len(values) > 1 else None], "peak": [max(values)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.scores.clear()
        yield pd.DataFrame({"trend": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "newest": pd.Series(dtype=float), "previous": pd.Series(dtype=float), "peak": pd.Series(dtype=float)})


class NarrativePool(_Timed):
    """A label's narratives with the time each was seen last: the newest NARRATIVES of the last DAYS before the label's
    newest one; ties by name. The whole pool goes when the watermark passes DAYS after the newest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pool = handle.getMapState("pool", "narrative string", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: int(v[0]) for k, v in self.pool.iterator()}
        seen = dict(before)
        for frame in rows:
            for at, narrative in zip(millis(frame["seen_at"]), frame["narrative"], strict=True):
                if narrative is not None:
                    seen[narrative] = max(at, seen.get(narrative, at))
            seen = dict(self.newest(seen))
        for gone in before.keys() - seen.keys():
            self.pool.removeKey((gone,))
        for narrative, at in seen.items():
            if before.get(narrative) != at:
                self.pool.updateValue((narrative,), (at,))
        if seen:
            self.wake(max(seen.values()) + DAYS * DAY)
        yield pd.DataFrame({"label": [key[0]], "narratives": [[n for n, _ in self.newest(seen)]]})

    @staticmethod
    def newest(seen: dict[str, int]) -> list[tuple[str, int]]:
        last = max(seen.values(), default=0)
        return sorted(((n, at) for n, at in seen.items() if at > last - DAYS * DAY), key=lambda x: (-x[1], x[0]))[:NARRATIVES]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pool.clear()
        yield pd.DataFrame({"label": [key[0]], "narratives": [[]]})


class RunResults(_Timed):
    """A run's results by category until all four are there: then one row. A run that waits for longer than WAITS after
    its first result gives one row that names what is missing. What comes after its row changes nothing, until the run
    is forgotten with the timer. Repeated results before it are named, the largest payload counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.results = handle.getMapState("results", "category string", "n long, payload string")

    def row(self, run: object, found: dict[str, tuple[int, str | None]]) -> pd.DataFrame:
        names = [f"missing {c}" for c in CATEGORIES if c not in found] + [f"duplicate {c}" for c in CATEGORIES if found.get(c, (0, None))[0] > 1]
        if any(c not in (*CATEGORIES, "") for c in found):
            names.append("unexpected category")
        return pd.DataFrame({"run_id": [run], **{c: [found[c][1] if c in found else None] for c in CATEGORIES}, "problem": ["; ".join(names)]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: (int(v[0]), v[1]) for k, v in self.results.iterator()}
        found, first = dict(before), None
        for frame in rows:
            at = min(millis(frame["at"]))
            first = at if first is None else min(first, at)
            for category, payload in zip(frame["category"], frame["payload"], strict=True):
                name = category if category in CATEGORIES else "unexpected"
                n, old = found.get(name, (0, None))
                found[name] = (n + 1, max((p for p in (old, payload) if p is not None), default=None))
        if not before:
            self.wake(first + WAITS * HOUR)
        if "" in before:  # the run has had its row
            return
        done = all(c in found for c in CATEGORIES)
        for name, value in {**found, **({"": (1, None)} if done else {})}.items():
            self.results.updateValue((name,), value)
        if done:
            yield self.row(key[0], found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = {k[0]: (int(v[0]), v[1]) for k, v in self.results.iterator()}
        self.results.clear()
        if found and "" not in found:
            yield self.row(key[0], found)


def score_histories(scores: DataFrame, late: str = "1 hour") -> DataFrame:
    """(trend, n, newest, previous, peak) of each trend that a batch of (trend, captured_at, score) touches."""
    kept = scores.where("score is not null and captured_at is not null").withWatermark("captured_at", late)
    return kept.groupBy("trend").transformWithStateInPandas(ScoreHistory(), "trend string, n long, newest double, previous double, peak double", "Update", "EventTime")


def narrative_pools(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """(label, narratives, newest first) of each label that a batch of (label, narrative, seen_at) touches; empty when a
    label's pool has gone."""
    kept = rows.where("seen_at is not null").withWatermark("seen_at", late)
    return kept.groupBy("label").transformWithStateInPandas(NarrativePool(), "label string, narratives array<string>", "Update", "EventTime")


def awaited_runs(results: DataFrame, late: str = "1 hour") -> DataFrame:
    """(run_id, a payload for each category, problem) once for each run of (run_id, category, payload, at)."""
    kinds = ", ".join(f"{c} string" for c in CATEGORIES)
    kept = results.where("at is not null").withWatermark("at", late)
    return kept.groupBy("run_id").transformWithStateInPandas(RunResults(), f"run_id long, {kinds}, problem string", "Update", "EventTime")
