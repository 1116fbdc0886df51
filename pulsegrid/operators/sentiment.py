"""Sentiment and narratives of a batch of posts: a pluggable scorer and the decisions around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import js_round

#: Posts of a batch, characters of its text, confidence from which a narrative match counts, pool size.
POSTS, CHARACTERS, ACCEPTED, POOL = 30, 112_000, 0.7, 50
AFFECTS = ("joy", "trust", "fear", "surprise", "sadness", "disgust", "anger", "anticipation")
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
SCORED = "run_id string, label string, confidence double, positive int, negative int, affects map<string,double>, narrative string, narrative_confidence double, stance string"
#: A small deterministic lexicon; a real model is passed in as a scorer.
LEXICON = {
    "positive": {"good", "great", "love", "happy", "win", "excellent", "best"}, "negative": {"bad", "hate", "sad", "lose", "worst", "angry", "awful"},
    "joy": {"happy", "love", "win"}, "trust": {"good", "best"}, "fear": {"afraid", "worry"}, "surprise": {"sudden", "wow"},
    "sadness": {"sad", "lose"}, "disgust": {"awful"}, "anger": {"angry", "hate"}, "anticipation": {"soon", "next"},
}


def batches(posts: DataFrame, run: str = "trend") -> DataFrame:
    """(run_id, n, state): the posts of a run with most interactions as one JSON text, cut at CHARACTERS.

    Only the best posts of each task and run are shuffled.
    """
    w = f"row_number() OVER (PARTITION BY {run} ORDER BY interactions DESC, event_id)"
    few = posts.selectExpr(f"{run} AS run_id", "event_id", "interactions", "text", f"{w} AS place").where(F.col("place") <= POSTS)
    listed = few.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "event_id", "interactions", "text"))).alias("posts"))
    return listed.select("run_id", F.size("posts").alias("n"), F.substring(F.to_json("posts"), 1, CHARACTERS).alias("state"), F.transform("posts", lambda p: p["text"]).alias("texts"))


def lexicon_scorer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for run_id, texts in zip(frame["run_id"], frame["texts"], strict=True):
            words = [w.strip(".,!?;:").lower() for t in texts if t for w in t.split()]
            hits = {k: sum(w in v for w in words) for k, v in LEXICON.items()}
            p, n = hits["positive"], hits["negative"]
            total = p + n
            label = "neutral" if not total else "mixed" if min(p, n) / total > 0.3 else "positive" if p > n else "negative"
            confidence = 0.5 if not total else max(p, n) / total
            rows.append((run_id, label, confidence, p, n, {a: min(1.0, hits[a] / max(total, 1)) for a in AFFECTS}, None, 0.0, "none"))
        yield pd.DataFrame(rows, columns=["run_id", "label", "confidence", "positive", "negative", "affects", "narrative", "narrative_confidence", "stance"])


def score(batched: DataFrame, scorer: Scorer = lexicon_scorer) -> DataFrame:
    """One row a run from the scorer, with its counts as a distribution in percent."""
    found = batched.select("run_id", "texts").mapInPandas(scorer, SCORED)
    total = F.greatest(F.col("positive") + F.col("negative"), F.lit(1))
    return found.withColumns({"positive_share": js_round(100 * F.col("positive") / total, 2), "negative_share": js_round(100 * F.col("negative") / total, 2)})


def decide(scored: DataFrame, pool: DataFrame) -> DataFrame:
    """Match each run's narrative against the pool (run_id, narrative_id, narrative_text): accepted, an existing one by
    text or id, a new one, or none where the pool is full."""
    sizes = pool.groupBy("run_id").agg(F.count(F.lit(1)).alias("pool"))
    by_text = pool.groupBy("run_id", F.col("narrative_text").alias("narrative")).agg(F.min("narrative_id").alias("text_id"))
    by_id = pool.select("run_id", F.col("narrative_id").alias("narrative"), F.col("narrative_id").alias("own_id")).distinct()
    both = scored.join(by_text, ["run_id", "narrative"], "left").join(by_id, ["run_id", "narrative"], "left").join(sizes, "run_id", "left")
    known = F.coalesce("own_id", "text_id")
    return both.select("run_id", "narrative", known.alias("narrative_id"), status(known.isNotNull(), F.col("narrative"), F.col("narrative_confidence"), F.coalesce("pool", F.lit(0))).alias("decision"))


def status(known: Column, narrative: Column, confidence: Column, pool: Column) -> Column:
    none = narrative.isNull() | (narrative == "none")
    return F.when(known & (confidence >= ACCEPTED), "accepted").when(known, "fallback_existing").when(none, "none").when(pool >= POOL, "pool_full").otherwise("fallback_new")


def append_narratives(pool: DataFrame, fresh: DataFrame) -> DataFrame:
    """The pool with new narratives behind the old ones, at most POOL for each run; known texts are not added."""
    new = fresh.join(pool.select("run_id", "narrative_text"), ["run_id", "narrative_text"], "left_anti")
    rows = pool.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    kept = rows.selectExpr("*", "row_number() OVER (PARTITION BY run_id ORDER BY age, created_at, narrative_id) AS place").where(F.col("place") <= POOL)
    return kept.drop("age", "place")
