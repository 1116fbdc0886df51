"""Readers and writers of collections, comment trees, prices and rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.scoreboard import row_numbers
from pulsegrid.session import checkpoint_folder
from pulsegrid.sources.schemas import ENVELOPE

PRICES = "date date, instrument string, close double"
RULES = "rule_id string, instrument string, type string, direction string, level double, short int, long int"


def parse_envelopes(rows: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(envelopes, quarantine) from JSON texts: what is no object of the schema goes to the quarantine with its text."""
    parsed = rows.withColumn("e", F.from_json(F.col(column), f"{ENVELOPE}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("e").isNull() | F.col("e._corrupt").isNotNull() | ~F.trim(F.col(column)).startswith("{")
    good = parsed.where(~bad).select(*[c for c in rows.columns if c != column], "e.*").drop("_corrupt")
    return good, parsed.where(bad).select(*rows.columns)


def read_envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Envelopes from files of one JSON document each line."""
    return parse_envelopes(spark.read.text(path))


def events_of(envelopes: DataFrame) -> DataFrame:
    """One row for each event with its collection and its place in it."""
    return envelopes.select(
        F.col("collection.collectionId").alias("collection_id"), F.coalesce("trend.label", "trend.query").alias("trend"), F.posexplode("events").alias("ord", "e")
    ).select("collection_id", "trend", "ord", "e.*")


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """Compact JSON, one envelope a line."""
    envelopes.select(F.to_json(F.struct(*envelopes.columns)).alias("value")).write.mode("append").text(path)


def pairs_to_map(fields: str = "fields") -> Column:
    """An alternating key, value list as a map."""
    odd = F.filter(fields, lambda _, i: i % 2 == 1)
    return F.map_from_arrays(F.filter(fields, lambda _, i: i % 2 == 0), odd)


def _lifted(rows: DataFrame, start: Column, joined: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """(post, id, way) of the comments that a root is above: the joined starts on the way down from it. Pointers are
    doubled: in each round a comment's way is put behind that of the one its pointer leads to, so a thread of depth d
    takes about log2(d) rounds, each over one written table."""
    state = rows.select("post", "id", F.col("parent_id").alias("up"), start.alias("way")).checkpoint()
    for _ in range(most.bit_length() + 1):  # a circle's pointers never end
        if not state.where("up IS NOT NULL").limit(1).count():
            break
        above = state.select("post", F.col("id").alias("up"), F.col("up").alias("next_up"), F.col("way").alias("above"), F.lit(True).alias("there"))
        met = state.join(above, ["post", "up"], "left").where("up IS NULL OR there")
        way = F.when(F.col("up").isNull(), F.col("way")).otherwise(joined(F.col("above"), F.col("way")))
        state = met.select("post", "id", F.when(F.col("up").isNotNull(), F.col("next_up")).alias("up"), way.alias("way")).checkpoint()
    return state.where("up IS NULL").select("post", "id", "way")


def comment_tree(comments: DataFrame, most: int | None = None) -> DataFrame:
    """Depth-first order of comments (post, id, parent_id, ord), ids once in a post; roots have no parent. Adds depth, path
    and place.

    Depths are found first, then the paths of the comments that have one, both by doubled pointers; parents that form a
    circle, or that aren't there, have no root and are left out. Places are offsets of range partitions, so no post's
    comments are sorted in one task. A path holds the ord of every comment above.
    """
    checkpoint_folder(comments.sparkSession)
    rows = comments.select("post", "id", "parent_id", "ord").checkpoint()
    n = rows.count()
    depths = _lifted(rows, F.lit(0), lambda a, b: a + b + 1, n).withColumnRenamed("way", "depth")
    rooted = rows.join(depths.select("post", "id"), ["post", "id"], "left_semi")
    paths = _lifted(rooted, F.array("ord"), lambda a, b: F.concat(a, b), n).withColumnRenamed("way", "path")
    tree = row_numbers(depths.join(paths, ["post", "id"]), ["post"], ["path", "id"], "place")
    return tree if most is None else tree.where(F.col("place") <= most)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily prices; line ends of either kind. A file with two prices of an instrument for one day is refused."""
    prices = spark.read.csv(path, schema=PRICES, header=True, mode="FAILFAST", dateFormat="yyyy-MM-dd", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    twice = prices.groupBy("instrument", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two prices of {twice[0]['instrument']} on {twice[0]['date']}")
    return prices


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=RULES, multiLine=True)


def trends_with_rank(rows: DataFrame, column: str = "trends") -> DataFrame:
    """One row for each listed trend with its rank from 1."""
    return rows.select("*", F.posexplode(column).alias("pos", "trend")).withColumn("rank", F.col("pos") + 1).drop("pos", column)
