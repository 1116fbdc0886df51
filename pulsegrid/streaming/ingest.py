"""Structured Streaming ingestion: collections as files, idempotent micro-batches, score history state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.normalize import normalize
from pulsegrid.operators.validate import validated_envelopes
from pulsegrid.sources.collections import events_of, parse_envelopes

#: Collections taken by a micro-batch, seconds between two, days that late posts are waited for, scores kept, days without an update after which a trend's state goes.
PER_BATCH, EVERY, LATE, KEPT, STALE = 5, "60 seconds", "30 days", 100, 7


def collections_stream(spark: SparkSession, path: str, per_batch: int = PER_BATCH) -> DataFrame:
    """New files of one JSON collection a line, oldest first."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(path)


def posts_stream(raw: DataFrame) -> DataFrame:
    """Normalised posts of valid collections, each event once within the watermark."""
    good, _ = parse_envelopes(raw)
    kept = validated_envelopes(good).where(F.size("all_errors") == 0)
    return normalize(events_of(kept)).withWatermark("published_at", LATE).dropDuplicatesWithinWatermark(["event_id"])


def windowed(posts: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Posts and interactions of each trend and window of event time."""
    w = F.window("published_at", size, slide) if slide else F.window("published_at", size)
    found = posts.groupBy(w.alias("w"), "trend").agg(F.count(F.lit(1)).alias("posts"), F.sum("interactions").alias("interactions"))
    return found.select(F.col("w.start").alias("bucket_start"), "trend", "posts", "interactions")


def idempotent(path: str, dead_letters: str, analyse: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of raw text: each collection replaces its own partitions, so a replayed batch changes
    nothing; texts that are no valid collection go to the dead letters, by batch. All analyses share one cached batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = parse_envelopes(batch)
        checked = validated_envelopes(good).persist()
        try:
            kept = checked.where(F.size("all_errors") == 0)
            rejected = bad.select(F.col("value")).unionByName(checked.where(F.size("all_errors") > 0).select(F.to_json(F.struct("collection", "all_errors")).alias("value")))
            rejected.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(dead_letters)
            for name, rows in analyse(normalize(events_of(kept))).items():
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_id").parquet(f"{path}/{name}")
        finally:
            checked.unpersist()

    return write


def score_history(scores: DataFrame, most: int = KEPT, stale_days: int = STALE) -> DataFrame:
    """(trend, n, newest, previous, peak) after each micro-batch from (trend, captured_at, score): the state of a trend
    is its newest scores, and goes when it isn't updated for days of
    event time."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, values = (list(x) for x in state.get) if state.exists else ([], [])
        for frame in frames:
            times += [int(t.value // 1000) for t in frame["captured_at"]]
            values += frame["score"].tolist()
        order = sorted(range(len(times)), key=lambda i: -times[i])[:most]
        times, values = [times[i] for i in order], [values[i] for i in order]
        state.update((times, values))
        state.setTimeoutTimestamp(max(times[0] // 1000, state.getCurrentWatermarkMs()) + stale_days * 86_400_000)
        yield pd.DataFrame({"trend": [key[0]], "n": [len(values)], "newest": [values[0]], "previous": [values[1] if len(values) > 1 else None], "peak": [max(values)]})

    return scores.withWatermark("captured_at", "1 hour").groupBy("trend").applyInPandasWithState(
        update, "trend string, n long, newest double, previous double, peak double", "times array<long>, scores array<double>", "update", GroupStateTimeout.EventTimeTimeout
    )


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> Any:
    """Process all that has arrived, then stop; a scheduler calls it again. The checkpoint remembers what was done."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_always(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], every: str = EVERY) -> Any:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
