"""Rollups at nested grains with mergeable distinct counts.

Rows are read once, into slots of six hours; days are merged from slots, weeks and months of thirty days from days. A slot
has one row for each member seen in it, so the distinct members of a longer time are those of merged rows, not a second
look at the input, and no row or sum holds more than numbers. All sums combine within tasks first.

Members without a name count in no distinct number, rows without a time in no slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import checkpoint_folder

HOUR = 3_600_000_000
#: Name of a grain, its hours, and the grain it is merged from.
GRAINS = (("6h", 6, None), ("1d", 24, "6h"), ("7d", 168, "1d"), ("30d", 720, "1d"))


def slot(at: Column, hours: int) -> Column:
    """The start of the slot in microseconds."""
    return (F.floor(at / (hours * HOUR)) * (hours * HOUR)).cast("long")


def merged_rollups(rows: DataFrame, keys: list[str], at: str, member: str, sums: dict[str, Column], most: dict[str, Column] | None = None, distinct: str = "members") -> DataFrame:
    """(keys, granularity, bucket_start, rows_, sums, maxima, distinct) of all four grains, for rows with a time."""
    checkpoint_folder(rows.sparkSession)
    most = most or {}
    named = rows.where(F.col(at).isNotNull())
    plain = named.select(*keys, slot(F.unix_micros(at), 6).alias("slot"), F.col(member).alias("m_"), *[c.alias(k) for k, c in {**sums, **most}.items()])
    totals = [F.sum("rows_").alias("rows_"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most]]
    first = [F.count(F.lit(1)).alias("rows_"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most]]
    grains = {"6h": plain.groupBy(*keys, "slot", "m_").agg(*first).checkpoint()}
    for name, hours, source in GRAINS[1:]:
        grains[name] = grains[source].withColumn("slot", slot(F.col("slot"), hours)).groupBy(*keys, "slot", "m_").agg(*totals)
        if name == "1d":
            grains[name] = grains[name].checkpoint()
    every = None
    for name, table in grains.items():
        own = table.withColumn("granularity", F.lit(name))
        every = own if every is None else every.unionByName(own)
    found = every.groupBy(*keys, "granularity", "slot").agg(*totals, F.count("m_").alias(distinct))  # one row a member
    return found.select(*keys, "granularity", F.timestamp_micros("slot").alias("bucket_start"), "rows_", *sums, *most, distinct)


def edge_rollups(links: DataFrame, weight: Column) -> DataFrame:
    """(src, dst, granularity, bucket_start, links, weight, events): an edge's links and distinct events."""
    found = merged_rollups(links, ["src", "dst"], "published_at", "event_id", {"weight": weight}, distinct="events")
    return found.withColumnRenamed("rows_", "links")


def node_rollups(links: DataFrame, weight: Column) -> DataFrame:
    """(id, granularity, bucket_start, links, weight, weight_in, peers): a node's links either way and distinct peers."""
    end = lambda own, other, into: F.struct(F.col(own).alias("id"), F.col(other).alias("peer"), weight.alias("weight"), (weight * into).alias("weight_in"))
    ends = links.select("published_at", F.explode(F.array(end("src", "dst", 0), end("dst", "src", 1))).alias("e")).select("published_at", "e.*")
    found = merged_rollups(ends, ["id"], "published_at", "peer", {"weight": F.col("weight"), "weight_in": F.col("weight_in")}, distinct="peers")
    return found.withColumnRenamed("rows_", "links")
