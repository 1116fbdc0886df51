"""Validation that names problems and never drops rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.times import zoned_timestamp
from pulsegrid.sources.schemas import PLATFORMS, VERSION

METRICS = ("likes", "replies", "reposts", "quotes", "bookmarks", "views", "impressions")
STATUSES = ("success", "success_with_results", "success_empty", "rate_limited", "unavailable", "error")


def messages(rules: list[tuple[Column, str]]) -> Column:
    """The messages of the rules that are broken; a rule that can't be told is not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(text)) for broken, text in rules]))


def event_rules() -> list[tuple[Column, str]]:
    p, i, post = F.col("platform"), F.col("eventId"), F.col("platformPostId")
    reply = F.col("relationships.replyToId")
    rules = [
        (i.isNull() | (F.trim(i) == ""), "eventId is required"), (~p.isin(*PLATFORMS) | p.isNull(), "unsupported platform"), (post.isNull() | (F.trim(post) == ""), "platformPostId is required"),
        ((p == "x") & ~i.rlike(r"^x:\d+$"), "x event ids are x:<id>"), ((p == "reddit") & ~post.rlike(r"^t[13]_"), "reddit posts are t3_ or t1_"),
        ((p == "reddit") & ~F.col("author.authorId").rlike(r"^t2_"), "reddit authors are t2_"), ((p == "telegram") & (F.size(F.split(i, ":")) != 4), "telegram event ids are telegram:<kind>:<peer>:<message>"),
        ((p == "telegram") & ~reply.rlike(r"^telegram:[^:]+:[^:]+:[^:]+$"), "telegram replies are telegram:<peer_kind>:<peer>:<message>"),
    ]
    for name in ("publishedAt", "observedAt", "editedAt"):
        t = F.col(f"time.{name}")
        missing = [(t.isNull(), f"time.{name} is required")] if name != "editedAt" else []
        rules += [*missing, (t.isNotNull() & zoned_timestamp(t).isNull(), f"time.{name} needs a timezone"), (zoned_timestamp(t) == F.lit("1970-01-01 00:00:00").cast("timestamp"), f"time.{name} is an epoch fallback")]
    return rules + [(F.col(f"engagement.{m}") < 0, f"engagement.{m} must be an integer or null") for m in METRICS]


def validated_events(events: DataFrame) -> DataFrame:
    """Adds errors: array of messages; ids that repeat in a collection are named too. Ids are counted before the shuffle,
    and only those that repeat are joined, so an id that very many events share (a blank one) is one row of the join."""
    again = events.where(F.col("eventId").isNotNull()).groupBy(F.col("collection_id").alias("of_"), F.col("eventId").alias("id_")).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    found = events.withColumn("errors", messages(event_rules())).join(again, F.col("collection_id").eqNullSafe(F.col("of_")) & (F.col("eventId") == F.col("id_")), "left")
    named = F.when(F.col("n_").isNotNull(), F.array_append("errors", F.lit("duplicate eventId in collection"))).otherwise(F.col("errors"))
    return found.withColumn("errors", named).drop("of_", "id_", "n_")


def validated_envelopes(envelopes: DataFrame) -> DataFrame:
    """Adds errors and warnings, appended to what the envelope reports itself, each once."""
    ids = F.transform(F.col("events"), lambda e: e["eventId"])
    authors = F.transform(F.col("events"), lambda e: e["author"]["authorId"])
    profiles = F.transform(F.coalesce("authorProfiles", F.array().cast("array<struct<authorId:string>>")), lambda p: p["authorId"]) if "authorProfiles" not in envelopes.columns else F.transform("authorProfiles", lambda p: p["authorId"])
    pages = F.transform(F.map_values("platforms"), lambda b: b["pagination"])
    off = F.exists(pages, lambda p: (p["primaryResultsReturned"] > p["recordsCollected"]) | (p["primaryResultsReturned"] + F.coalesce(p["relationshipRecordsCollected"], F.lit(0)) != p["recordsCollected"]))
    rules = [
        (~F.col("schemaVersion").eqNullSafe(VERSION), "schemaVersion must be 1.0.0"), (F.coalesce(F.trim("collection.collectionId"), F.lit("")) == "", "collectionId is required"),
        (F.coalesce("trend.label", "trend.query").isNull(), "trend needs a label or query"), (F.col("events").isNull(), "events must be an array"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "duplicate eventId"), (F.col("quality.recordsCollected") != F.size("events"), "recordsCollected differs from the events"),
        (F.exists(F.map_keys("platforms"), lambda k: ~k.isin(*PLATFORMS)), "unsupported platform block"), (F.exists(F.map_values("platforms"), lambda b: ~b["status"].isin(*STATUSES)), "unknown platform status"),
        (off, "pagination doesn't add up"),
    ]
    strangers = F.size(F.array_except(profiles, authors)) > 0
    none = F.array().cast("array<string>")
    return envelopes.withColumns({
        "all_errors": F.array_union(F.coalesce("quality.errors", none), messages(rules)),
        "all_warnings": F.array_union(F.coalesce("quality.warnings", none), messages([(strangers, "profile of an author who is not in the collection")])),
    })


def relationship_records(envelopes: DataFrame) -> Column:
    return F.aggregate(F.map_values("platforms"), F.lit(0), lambda a, b: a + F.coalesce(b["pagination"]["relationshipRecordsCollected"], F.lit(0)))


def http_status(code: Column) -> Column:
    """Platform status of a failed request: rate limits and server errors may be tried again."""
    return F.struct(F.when(code == 429, "rate_limited").otherwise("error").alias("status"), ((code == 429) | (code >= 500)).alias("retryable"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Events of several platforms; a first-seen row for each eventId is kept by the caller where needed."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def conserved(parts: list[DataFrame], whole: DataFrame) -> bool:
    return whole.count() == sum(p.count() for p in parts)


def platform_errors(envelopes: DataFrame) -> DataFrame:
    """Adds platform_errors: one code for each platform block that failed, by name; PLATFORM_ERROR where it gives none."""
    names = F.array_sort(F.map_keys("platforms"))
    codes = F.transform(names, lambda k: F.when(F.col("platforms")[k]["status"].isin("error", "rate_limited"), F.concat_ws(":", k, F.coalesce(F.col("platforms")[k]["code"], F.lit("PLATFORM_ERROR")))))
    return envelopes.withColumn("platform_errors", F.array_compact(codes))
