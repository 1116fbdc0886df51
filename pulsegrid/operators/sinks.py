"""Idempotent merges and snapshot tables without a merge-capable format: windows over old and new rows, written as
whole partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counters that a newer observation replaces even where it is smaller; others keep the last known value.
REPLACED = ("likes", "replies", "reposts", "quotes", "views")


def merge_latest(rows: DataFrame, keys: list[str], order: str, replaced: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """One row for each key: replaced columns from the newest row, all others their newest known value.

    max_by and a null-skipping maximum combine before the shuffle, so a key with very many rows is no hot spot.
    """
    when = F.struct(order, tie) if tie else F.col(order)
    others = [c for c in rows.columns if c not in {*keys, order}]
    newest = lambda c: F.max_by(c, when) if c in replaced else F.max(F.when(F.col(c).isNotNull(), F.struct(when.alias("w"), F.col(c).alias("v"))))["v"]
    return rows.groupBy(*keys).agg(F.max(order).alias(order), *[newest(c).alias(c) for c in others])


def upsert_trends(old: DataFrame, new: DataFrame) -> DataFrame:
    """(trend_key, label, first_seen, last_seen, status): last_seen never falls; the newest label wins, of equal times the
    larger; active again."""
    rows = old.select("trend_key", "label", "first_seen", "last_seen").unionByName(new.select("trend_key", "label", "first_seen", "last_seen"))
    return rows.groupBy("trend_key").agg(F.max_by("label", F.struct("last_seen", "label")).alias("label"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")).withColumn("status", F.lit("active"))


def sequence(collections: DataFrame) -> DataFrame:
    """Number of each collection within its trend, by time."""
    return collections.withColumn("collection_sequence", F.row_number().over(Window.partitionBy("trend").orderBy("observed_at", "collection_id")))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not there yet, once each: of several the smallest."""
    rest = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in new.columns]) if rest else new.distinct()
    return once.join(old.select(*keys), keys, "left_anti")


def conflicting(old: DataFrame, new: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that belong to another owner already."""
    return new.join(old.select(key, F.col(owner).alias("held_by")), key).where(F.col(owner) != F.col("held_by"))


def first_profiles(profiles: DataFrame, posts: DataFrame) -> DataFrame:
    """Author profiles, the first of each id; authors without one get theirs from their first post."""
    given = profiles.where("author_id is not null").groupBy("platform", "author_id").agg(F.min_by("name", "ord").alias("name"))
    seen = posts.where("author_id is not null").groupBy("platform", "author_id").agg(F.min_by("author_name", F.struct("published_at", "event_id")).alias("fallback"))
    both = seen.join(given, ["platform", "author_id"], "full")
    return both.select("platform", "author_id", F.coalesce("name", "fallback").alias("name"), F.col("name").isNull().alias("from_post"))


def completed(collections: DataFrame, now: Column) -> DataFrame:
    return collections.withColumn("completed_at", F.coalesce("completed_at", now))


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that rows holds: a rerun of a collection replaces what it wrote."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
