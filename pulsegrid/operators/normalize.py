"""One flat, analytics-friendly row for each canonical event; all platforms in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import null_sum
from pulsegrid.functions.text import blank_to_null, hashtags, prefixed
from pulsegrid.functions.times import hours_between, to_timestamp_lenient

#: Place names and the region they stand for, in order.
REGIONS = (
    ("india", "India"), ("mumbai", "Maharashtra"), ("pune", "Maharashtra"), ("nagpur", "Maharashtra"), ("maharashtra", "Maharashtra"),
    ("delhi", "Delhi"), ("new delhi", "Delhi"), ("ncr", "Delhi"),
    ("bangalore", "Karnataka"), ("bengaluru", "Karnataka"), ("karnataka", "Karnataka"), ("mysore", "Karnataka"),
    ("hyderabad", "Telangana"), ("telangana", "Telangana"),
    ("chennai", "Tamil Nadu"), ("coimbatore", "Tamil Nadu"), ("tamil nadu", "Tamil Nadu"),
    ("kolkata", "West Bengal"), ("west bengal", "West Bengal"),
    ("ahmedabad", "Gujarat"), ("surat", "Gujarat"), ("gujarat", "Gujarat"),
    ("jaipur", "Rajasthan"), ("rajasthan", "Rajasthan"),
    ("lucknow", "Uttar Pradesh"), ("kanpur", "Uttar Pradesh"), ("noida", "Uttar Pradesh"), ("up", "Uttar Pradesh"), ("uttar pradesh", "Uttar Pradesh"),
    ("chandigarh", "Punjab/Haryana"), ("punjab", "Punjab/Haryana"), ("haryana", "Punjab/Haryana"), ("gurgaon", "Punjab/Haryana"),
    ("bhopal", "Madhya Pradesh"), ("indore", "Madhya Pradesh"), ("madhya pradesh", "Madhya Pradesh"),
    ("patna", "Bihar"), ("bihar", "Bihar"),
    ("kerala", "Kerala"), ("kochi", "Kerala"), ("trivandrum", "Kerala"),
    ("andhra pradesh", "Andhra Pradesh"), ("vizag", "Andhra Pradesh"),
)


def platform(name: Column) -> Column:
    p = F.lower(F.trim(name))
    p = F.when(p == "twitter", "x").otherwise(p)
    return F.when(p.isin("x", "reddit", "telegram"), p).otherwise("unknown")


def interactions(p: Column, e: str = "engagement", d: str = "platformData") -> Column:
    """Null-aware: x sums its counters, reddit counts replies, telegram reactions and replies; unknown: all known counters."""
    c = lambda n: F.col(f"{e}.{n}")
    every = null_sum(*[c(n) for n in ("likes", "replies", "reposts", "quotes", "bookmarks")])
    return F.when(p == "reddit", c("replies")).when(p == "telegram", null_sum(F.col(f"{d}.reactionsTotal"), c("replies"))).otherwise(every)


def engagement_rate(interactions_: Column, reach: Column) -> Column:
    return F.when(reach > 0, interactions_ / reach)


def region(location: Column) -> Column:
    """The first listed place that the location names; Other where none does."""
    low = F.lower(location)
    return F.coalesce(*[F.when(low.contains(k), v) for k, v in REGIONS], F.lit("Other"))


def normalize(events: DataFrame, reach: Column | None = None) -> DataFrame:
    """events: canonical events. Reach is not derived from views; it stays null unless given."""
    p = platform(F.col("platform"))
    published, observed = to_timestamp_lenient(F.col("time.publishedAt")), to_timestamp_lenient(F.col("time.observedAt"))
    i, r = interactions(p), F.lit(None).cast("double") if reach is None else reach
    text = F.concat_ws(" ", "content.title", "content.text")
    tags = F.when(F.size("content.hashtags") > 0, F.col("content.hashtags")).when(p == "reddit", hashtags(text)).otherwise(F.col("content.hashtags"))
    base = [c for c in ("collection_id", "trend", "ord") if c in events.columns]
    return events.select(
        *base, F.col("eventId").alias("event_id"), p.alias("platform"), blank_to_null(F.col("author.authorId")).alias("author_id"), F.col("author.authorHandle").alias("handle"),
        published.alias("published_at"), observed.alias("observed_at"), hours_between(published, observed).alias("velocity_window"), i.cast("double").alias("interactions"),
        r.alias("reach"), engagement_rate(i, r).alias("engagement_rate"), F.when(p == "reddit", F.col("platformData.upvoteRatio")).alias("approval"),
        F.when(p == "reddit", F.col("platformData.score")).alias("score"), *[F.col(f"engagement.{c}").alias(c) for c in ("likes", "replies", "reposts", "quotes", "views")],
        F.col("platformData.authorFollowers").alias("followers"), F.col("platformData.authorVerified").alias("verified"), tags.alias("hashtags"), F.col("content.mentions").alias("mentions"),
        blank_to_null(F.col("relationships.replyToAuthorId")).alias("reply_to_author"), blank_to_null(F.col("relationships.quoteOfId")).alias("quote_of"),
        blank_to_null(F.col("relationships.forwardOfId")).alias("forward_of"), F.col("content.text").alias("text"), region(F.col("author.authorLocation")).alias("region"),
    )


def tolerant_interactions(p: Column, given: Column, e: dict[str, Column], m: dict[str, Column], reactions: Column) -> Column:
    """A given number first; else the platform's counters: reddit replies and comments, telegram reactions, replies and
    comments, others every counter and the metrics' likes, comments and shares. Null where all are missing."""
    every = null_sum(*[e[k] for k in ("likes", "replies", "reposts", "quotes", "bookmarks") if k in e], *[m[k] for k in ("likes", "comments", "shares") if k in m])
    comments = [m["comments"]] if "comments" in m else []
    by = F.when(p == "reddit", null_sum(e["replies"], *comments)).when(p == "telegram", null_sum(reactions, e["replies"], *comments)).otherwise(every)
    return F.coalesce(given, by)


def first_label(*paths: Column) -> Column:
    """The first label that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(c) for c in paths])


def kept_on_ingest(p: Column, region_: Column, engagement: Column, least: int = 10) -> Column:
    """Posts with enough engagement; those of x only with a known region."""
    return (F.coalesce(engagement, F.lit(0)) >= least) & ((p != "x") | (region_ != "Other"))


def matches(query: str, *columns: Column) -> Column:
    """Some column contains the query; a blank query matches all."""
    found = F.lit(not query.strip())
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(query.strip().lower()), F.lit(False))
    return found


def prefixed_id(platform_: str, *paths: Column) -> Column:
    """The first known id of several payload paths, with its platform's prefix once."""
    return prefixed(platform_, first_label(*paths))


def distinct_attachments(items: Column) -> Column:
    """Attachments (type, url, …) without repeats of type and url, the first kept; those without a url all stay."""
    keys = F.transform(items, lambda a: F.when(a["url"].isNotNull(), F.concat_ws("|", a["type"], a["url"])))
    return F.filter(items, lambda a, i: a["url"].isNull() | (F.array_position(keys, F.concat_ws("|", a["type"], a["url"])) == i + 1))


def resolved_urls(raw: Column, entities: Column) -> Column:
    """The resolved form of each raw URL by the entities (raw, resolved) of its post, else the URL itself."""
    known = F.map_from_entries(F.transform(F.filter(entities, lambda e, i: F.array_position(F.transform(entities, lambda x: x["raw"]), e["raw"]) == i + 1), lambda e: F.struct(e["raw"], e["resolved"])))
    return F.transform(raw, lambda u: F.coalesce(F.try_element_at(known, u), u))


def keyword_class(texts: DataFrame, text: str, keywords: DataFrame, key: str) -> DataFrame:
    """(key, class, hits): the class most of whose keywords (class, keyword) stand in the text as words; ties to the
    smaller name; null where none does. Texts meet keywords by word, so nothing is compared with everything."""
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("keyword"))
    hits = words.join(keywords.select("class", F.lower("keyword").alias("keyword")), "keyword").groupBy(key, "class").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy(F.col(key).alias("of")).agg(F.min(F.struct((-F.col("hits")).alias("n"), F.col("class").alias("c"))).alias("m"))
    return texts.select(key).join(best, F.col(key) == F.col("of"), "left").select(key, F.col("m.c").alias("class"), F.coalesce(-F.col("m.n"), F.lit(0)).alias("hits"))


def matched_name(name: Column, known: list[str]) -> Column:
    """The known name that equals a name but for case, spaces and punctuation, else the first that contains it or lies in it."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    n = plain(name)
    exact = [F.when(n == plain(F.lit(k)), F.lit(k)) for k in known]
    near = [F.when((n != "") & (n.contains(plain(F.lit(k))) | plain(F.lit(k)).contains(n)), F.lit(k)) for k in known]
    return F.coalesce(*exact, *near)
