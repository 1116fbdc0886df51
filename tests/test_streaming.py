from __future__ import annotations

import json

from pyspark.sql import functions as F

from pulsegrid.streaming import ingest
from tests.test_operators import ENVELOPE


def envelope(n: int) -> str:
    events = [{**e, "eventId": f"{e['eventId']}{n}" if e["platform"] == "x" else e["eventId"]} for e in ENVELOPE["events"]]
    return json.dumps({**ENVELOPE, "collection": {"collectionId": f"c{n}"}, "events": events})


def test_replayed_collections_change_nothing_and_bad_ones_are_kept_apart(spark, tmp_path):
    source, sink, dead = (str(tmp_path / x) for x in ("in", "out", "dead"))
    spark.createDataFrame([(envelope(1),), (envelope(2),), ("broken",)], "value string").coalesce(1).write.text(source)
    each = ingest.idempotent(sink, dead, lambda posts: {"posts": posts.select("collection_id", "event_id", "interactions")})
    ingest.run_once(ingest.collections_stream(spark, source), str(tmp_path / "cp"), each)
    first = sorted(map(tuple, spark.read.parquet(f"{sink}/posts").collect()))
    assert len(first) == 4 and spark.read.parquet(dead).count() == 1
    spark.createDataFrame([(envelope(1),)], "value string").coalesce(1).write.mode("append").text(source)
    ingest.run_once(ingest.collections_stream(spark, source), str(tmp_path / "cp"), each)
    assert sorted(map(tuple, spark.read.parquet(f"{sink}/posts").collect())) == first


def test_posts_stream_drops_repeated_events_like_the_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(envelope(1),), (envelope(1),), (envelope(2),)], "value string").coalesce(1).write.text(source)
    got: list = []
    stream = ingest.posts_stream(ingest.collections_stream(spark, source))
    ingest.run_once(stream, str(tmp_path / "cp"), lambda batch, _: got.extend(r["event_id"] for r in batch.collect()))
    assert sorted(got) == ["t3_e", "x:11", "x:12"]


def test_score_history_keeps_state_between_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    got: dict = {}

    def run() -> None:
        rows = spark.readStream.schema("trend string, captured_at timestamp, score double").parquet(source)
        query = ingest.score_history(rows).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        query.foreachBatch(lambda b, _: got.update({r["trend"]: (r["n"], r["newest"], r["previous"], r["peak"]) for r in b.collect()})).start().awaitTermination()

    frame = lambda rows: spark.createDataFrame(rows, "trend string, t string, score double").select("trend", F.col("t").cast("timestamp").alias("captured_at"), "score").coalesce(1)
    frame([("a", "2024-01-01", 5.0), ("b", "2024-01-01", 1.0)]).write.parquet(source)
    run()
    assert got == {"a": (1, 5.0, None, 5.0), "b": (1, 1.0, None, 1.0)}
    frame([("a", "2024-01-03", 2.0), ("a", "2024-01-02", 9.0)]).write.mode("append").parquet(source)
    run()
    assert got["a"] == (3, 2.0, 9.0, 9.0)


def test_windowed_counts(spark, tmp_path):
    posts = spark.createDataFrame([("2024-01-01 00:10:00", "t", 1.0), ("2024-01-01 00:50:00", "t", 2.0), ("2024-01-01 01:10:00", "t", 4.0)], "at string, trend string, interactions double").withColumn("published_at", F.col("at").cast("timestamp"))
    assert sorted((r["posts"], r["interactions"]) for r in ingest.windowed(posts).collect()) == [(1, 4.0), (2, 3.0)]
