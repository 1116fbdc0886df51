"""The driver tables in their domain roles, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import influence
from pulsegrid.session import table

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def jr(x: str, digits: int = 0) -> str:
    """js_round as SQL text."""
    scale = f"{10.0**digits!r}"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: type is the trend, value the interactions; the rest is derived from the JSON counter k."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    platform = F.when(F.col("k") % 3 == 0, "x").when(F.col("k") % 3 == 1, "reddit").otherwise("telegram")
    reach = F.when(F.col("k") % 5 > 0, (1000 + F.col("k") * 10).cast("double"))
    return e.select(
        "event_id", F.col("event_type").alias("trend"), platform.alias("platform"), F.col("ts").alias("published_at"), "user_id", F.col("user_id").cast("string").alias("author_id"),
        F.col("value").alias("interactions"), "k", (F.col("user_id") * 100).alias("followers"), influence(F.col("user_id") * 100).alias("influence"), reach.alias("reach"),
        (F.col("value") / reach).alias("engagement_rate"), (F.col("k") % 48 + 1).cast("double").alias("velocity_window"),
        F.col("value").cast("long").alias("likes"), (F.col("k") % 7).alias("replies"), (F.col("k") % 4).alias("reposts"), F.when(F.col("k") % 3 > 0, F.col("k") % 2).alias("quotes"),
        (F.col("k") * 3).alias("views"), (F.col("k") % 10 == 0).alias("verified"), F.when(F.col("k") % 3 == 1, F.col("k") % 11).alias("score"),
    )


POSTS = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
posts AS (SELECT event_id, event_type AS trend, CASE k % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'reddit' ELSE 'telegram' END AS platform, ts AS published_at, user_id,
  CAST(user_id AS VARCHAR) AS author_id, value AS interactions, k, user_id * 100 AS followers,
  CASE WHEN user_id * 100 > 0 THEN 1 + log10(1 + CAST(user_id * 100 AS DOUBLE)) ELSE 1.0 END AS influence,
  CASE WHEN k % 5 > 0 THEN CAST(1000 + k * 10 AS DOUBLE) END AS reach, value / CASE WHEN k % 5 > 0 THEN CAST(1000 + k * 10 AS DOUBLE) END AS engagement_rate,
  CAST(k % 48 + 1 AS DOUBLE) AS velocity_window, CAST(trunc(value) AS BIGINT) AS likes, k % 7 AS replies, k % 4 AS reposts, CASE WHEN k % 3 > 0 THEN k % 2 END AS quotes,
  k * 3 AS views, k % 10 = 0 AS verified, CASE WHEN k % 3 = 1 THEN k % 11 END AS score FROM e)
"""

SNAPSHOTS = f"""
{POSTS},
daily AS (SELECT trend, date_trunc('day', published_at) AS captured_at, sum(interactions) AS engagement, count(*) AS n, count(DISTINCT platform) AS platforms,
  {jr("avg(interactions)", 6)} AS m, max(interactions) AS mx FROM posts GROUP BY 1, 2),
snapshots AS (SELECT trend, captured_at, least(100.0, {jr("m / 5", 2)}) AS score, {jr("m / 10", 8)} AS velocity, {jr("n / 10.0", 4)} AS acceleration, {jr("mx / 5", 4)} AS burst,
  {jr("engagement", 2)} AS engagement, {jr("m / 500", 4)} AS virality, platforms,
  row_number() OVER (PARTITION BY captured_at ORDER BY {jr("m / 5", 2)} DESC, trend) AS rank,
  CASE WHEN {jr("m / 500", 4)} <= 0.2 THEN 'dormant' WHEN {jr("m / 500", 4)} <= 0.4 THEN 'emerging' WHEN {jr("m / 500", 4)} <= 0.6 THEN 'trending' WHEN {jr("m / 500", 4)} <= 0.8 THEN 'viral' ELSE 'mega_viral' END AS tier FROM daily)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots of each trend."""
    from pyspark.sql import Window

    from pulsegrid.functions.numbers import js_round, tier

    day = posts(spark, sf_dir).groupBy("trend", F.date_trunc("day", "published_at").alias("captured_at")).agg(
        F.sum("interactions").alias("engagement"), F.count(F.lit(1)).alias("n"), F.count_distinct("platform").alias("platforms"), js_round(F.avg("interactions"), 6).alias("m"), F.max("interactions").alias("mx")
    )
    m = F.col("m")
    w = Window.partitionBy("captured_at").orderBy(F.desc(js_round(m / 5, 2)), "trend")
    virality = js_round(m / 500, 4)
    return day.select(
        "trend", "captured_at", F.least(F.lit(100.0), js_round(m / 5, 2)).alias("score"), js_round(m / 10, 8).alias("velocity"), js_round(F.col("n") / 10.0, 4).alias("acceleration"),
        js_round(F.col("mx") / 5, 4).alias("burst"), js_round(F.col("engagement"), 2).alias("engagement"), virality.alias("virality"), "platforms", F.row_number().over(w).alias("rank"), tier(virality).alias("tier"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions between users: each user's event points to the user of the event before it in the same trend."""
    from pulsegrid.operators.trend import before

    kind = F.element_at(F.array(*map(F.lit, ("follow", "like", "mention", "reply", "quote", "repost"))), (F.col("k") % 6 + 1).cast("int"))
    p = before(posts(spark, sf_dir).select("trend", "published_at", "event_id", "user_id", "k"), "user_id", "trend", "published_at", "event_id").withColumnRenamed("previous", "other")
    p = p.where(F.col("other").isNotNull() & (F.col("other") != F.col("user_id")))
    node = lambda c: F.concat(F.lit("x:"), F.col(c).cast("string"))
    return p.select(node("user_id").alias("src"), node("other").alias("dst"), kind.alias("kind"), "published_at", F.col("event_id").cast("string").alias("event_id"))


LINKS = f"""
{POSTS},
l0 AS (SELECT *, lag(user_id) OVER (PARTITION BY trend ORDER BY published_at, event_id) AS other FROM posts),
links AS (SELECT 'x:' || user_id AS src, 'x:' || other AS dst, (['follow','like','mention','reply','quote','repost'])[k % 6 + 1] AS kind, published_at, CAST(event_id AS VARCHAR) AS event_id
  FROM l0 WHERE other IS NOT NULL AND other <> user_id)
"""
