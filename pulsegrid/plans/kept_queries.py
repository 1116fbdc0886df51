"""Queries over tables that the engine keeps between batches (commits, the score registry), language profiles and
dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import js_round, tier
from pulsegrid.operators import commits as C
from pulsegrid.operators import languages as L
from pulsegrid.operators import matching as A
from pulsegrid.operators import scoreboard as B
from pulsegrid.plans.views import POSTS, SNAPSHOTS, jr, posts, snapshots
from pulsegrid.session import checkpoint_folder, table

S = SparkSession
#: The times at which the replayed batches end.
CUTS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


def root(spark: S, name: str) -> str:
    """A new folder for kept tables, in the shared folder."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _author_scores(spark: S, d: str) -> DataFrame:
    """(member, score, tier, captured_at): each author's mean interactions of each day as a score."""
    day = posts(spark, d).groupBy(F.col("author_id").alias("member"), F.date_trunc("day", "published_at").alias("captured_at")).agg(js_round(F.avg("interactions"), 6).alias("m"))
    return day.select("member", js_round(F.col("m") / 5, 2).alias("score"), tier(js_round(F.col("m") / 500, 4)).alias("tier"), "captured_at")


def score_registry(spark: S, d: str) -> DataFrame:
    """Authors' daily scores, recorded in three batches (the second one twice), then every author's standing."""
    path, rows = root(spark, "scores"), _author_scores(spark, d).checkpoint()
    at = [F.lit(c).cast("timestamp") for c in CUTS]
    parts = [F.col("captured_at") < at[0], (F.col("captured_at") >= at[0]) & (F.col("captured_at") < at[1]), F.col("captured_at") >= at[1]]
    for number in (0, 1, 1, 2):
        B.record(spark, path, f"batch-{number}", rows.where(parts[number]))
    return B.enrich(spark, path, rows.select("member")).select("member", "score", "rank", "position", "percentile", "total", "score_delta", "tier_movement")


ORD = "CASE {} WHEN 'dormant' THEN 0 WHEN 'emerging' THEN 1 WHEN 'trending' THEN 2 WHEN 'viral' THEN 3 WHEN 'mega_viral' THEN 4 ELSE -1 END"
REGISTRY = f"""WITH {POSTS}, a AS (SELECT author_id AS member, date_trunc('day', published_at) AS captured_at, {jr("avg(interactions)", 6)} AS m FROM posts GROUP BY 1, 2),
b AS (SELECT member, captured_at, {jr("m / 5", 2)} AS score, CASE WHEN {jr("m / 500", 4)} <= 0.2 THEN 'dormant' WHEN {jr("m / 500", 4)} <= 0.4 THEN 'emerging' WHEN {jr("m / 500", 4)} <= 0.6 THEN 'trending' WHEN {jr("m / 500", 4)} <= 0.8 THEN 'viral' ELSE 'mega_viral' END AS tier FROM a),
h AS (SELECT *, lag(score) OVER w AS ps, lag(tier) OVER w AS pt, row_number() OVER (PARTITION BY member ORDER BY captured_at DESC) AS rn FROM b WINDOW w AS (PARTITION BY member ORDER BY captured_at)),
r AS (SELECT *, row_number() OVER (ORDER BY score, member) - 1 AS rank, count(*) OVER () AS total FROM h WHERE rn = 1)
SELECT member, score, rank, total - rank AS position, {jr("rank / total * 100")} AS percentile, total, score - ps AS score_delta,
  CASE WHEN pt IS NULL OR pt = tier THEN 'stable' WHEN {ORD.format("tier")} > {ORD.format("pt")} THEN 'rising' ELSE 'falling' END AS tier_movement FROM r"""

EVENT = "platform string, event_id long, trend string, author_id string, likes long, replies long, reposts long, quotes long, views long, observed_at timestamp"


def event_upserts(spark: S, d: str) -> DataFrame:
    """Events observed again three hours later without their author and with other counters, in a second commit; a third
    collection stages all its tables and fails before it publishes them."""
    path, seen = root(spark, "events"), posts(spark, d)
    columns = ["platform", "event_id", "trend", "author_id", "likes", "replies", "reposts", "quotes", "views"]
    first = seen.select(*columns, F.col("published_at").alias("observed_at"))
    again = seen.where("likes % 2 = 0").select(
        "platform", "event_id", F.lit(None).cast("string").alias("trend"), F.lit(None).cast("string").alias("author_id"), F.col("likes") + F.col("k"), F.greatest(F.col("replies") - 1, F.lit(0)),
        "reposts", F.lit(None).cast("long").alias("quotes"), F.col("views") * 2, F.col("published_at") + F.expr("INTERVAL 3 HOURS"),
    ).toDF(*columns, "observed_at")
    C.commit(spark, path, "first", {"events": first, "collections": first.groupBy("trend").count()})
    C.commit(spark, path, "second", {"events": again, "collections": first.groupBy("trend").count()})
    C.stage(path, "third", "events", first.withColumn("likes", F.lit(0).cast("long")))
    return C.upsert_events(C.read(spark, path, "events", EVENT).drop("sequence"))


EVENTS = f"""WITH {POSTS}
SELECT platform, event_id, trend, author_id, likes + CASE WHEN likes % 2 = 0 THEN k ELSE 0 END AS likes, CASE WHEN likes % 2 = 0 THEN greatest(replies - 1, 0) ELSE replies END AS replies, reposts,
  CASE WHEN likes % 2 = 0 THEN NULL ELSE quotes END AS quotes, views * CASE WHEN likes % 2 = 0 THEN 2 ELSE 1 END AS views, published_at + CASE WHEN likes % 2 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS observed_at FROM posts"""


def snapshot_upserts(spark: S, d: str) -> DataFrame:
    """Daily snapshots taken from posts up to the first cut's noon, then once more from all posts: one row for each trend and day."""
    path, every = root(spark, "snapshots"), snapshots(spark, d).select("trend", "captured_at", "score", "engagement", "tier")
    noon = F.lit(CUTS[0]).cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    early = posts(spark, d).where(F.col("published_at") < noon).groupBy("trend", F.date_trunc("day", "published_at").alias("captured_at"))
    partial = early.agg(js_round(F.sum("interactions"), 2).alias("engagement")).select("trend", "captured_at", F.lit(0.0).alias("score"), "engagement", F.lit("dormant").alias("tier"))
    C.commit(spark, path, "early", {"snapshots": partial})
    C.commit(spark, path, "late", {"snapshots": every.where(F.col("captured_at") >= F.lit(CUTS[0]).cast("timestamp"))})
    return C.latest_snapshots(C.read(spark, path, "snapshots", "trend string, captured_at timestamp, score double, engagement double, tier string")).drop("sequence")


UPSERTS = f"""WITH {SNAPSHOTS}, p AS (SELECT trend, date_trunc('day', published_at) AS captured_at, {jr("sum(interactions)", 2)} AS engagement FROM posts WHERE published_at < TIMESTAMP '{CUTS[0]}' GROUP BY 1, 2)
SELECT trend, captured_at, score, engagement, tier FROM snapshots WHERE captured_at >= TIMESTAMP '{CUTS[0]}' UNION ALL SELECT trend, captured_at, 0.0, engagement, 'dormant' FROM p"""


def language_detection(spark: S, d: str) -> DataFrame:
    """Language and confidence of every document; profiles learn from those whose crc32(doc_id as text) mod 3 isn't 1."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    known = L.profiles(docs.where(~fold))
    return L.detect(docs, known).select("doc_id", "lang", "detected", "confidence", fold.alias("held_out"))


def _words(spark: S, d: str, least: int) -> DataFrame:
    """(name, ord): the different words of the benchmark texts, longer ones listed first."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"\\p{{L}}{{{least},}}"), F.lit(0))).alias("name")).distinct()
    return B.row_numbers(words.withColumn("shorter", -F.length("name")), [], ["shorter", "name"], "ord").select("name", "ord")


WORDS = "w AS (SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}{LEAST,}')) AS name FROM benchmark))"


def dictionary_hits(spark: S, d: str) -> DataFrame:
    """The first listed word of the benchmark (of eight letters or more) that each document's whole text contains."""
    return A.first_contained(table(spark, d, "documents").select("doc_id", "text"), "text", _words(spark, d, 8)).select("doc_id", "found")


def matched_topics(spark: S, d: str) -> DataFrame:
    """The listed word that each page's first host label names: the same, else one that lies in it or around it."""
    label = F.regexp_extract("url", r"^[a-zA-Z]+://([^./?#]*)", 1)
    return A.matched(table(spark, d, "pages").select("page_id", label.alias("label")), "label", _words(spark, d, 4)).select("page_id", "label", "matched")


QUERIES = {
    "dictionary_hits": (dictionary_hits, f"WITH {WORDS.replace('LEAST', '8')} SELECT doc_id, arg_min(name, ord) AS found FROM documents LEFT JOIN w ON contains(lower(text), name) GROUP BY doc_id"),
    "matched_topics": (matched_topics, f"""WITH {WORDS.replace('LEAST', '4')}, v AS (SELECT name, ord, regexp_replace(name, '[^a-z0-9]', '', 'g') AS k FROM w), p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^./?#]*)', 1) AS label FROM pages),
      l AS (SELECT DISTINCT label, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS k FROM p), s AS (SELECT label, arg_min(name, ord) AS name FROM l JOIN v USING (k) WHERE k <> '' GROUP BY 1),
      n AS (SELECT label, arg_min(name, ord) AS name FROM l JOIN v ON l.k <> '' AND v.k <> '' AND (contains(l.k, v.k) OR contains(v.k, l.k)) GROUP BY 1)
      SELECT page_id, label, coalesce(s.name, n.name) AS matched FROM p LEFT JOIN s USING (label) LEFT JOIN n USING (label)"""),
    "score_registry": (score_registry, REGISTRY),
    "event_upserts": (event_upserts, EVENTS),
    "snapshot_upserts": (snapshot_upserts, UPSERTS),
    "language_detection": (language_detection, None),
}
