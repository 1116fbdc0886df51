"""Trend dynamics over posts (trend, published_at, interactions, …): windows, growth, peaks, lifecycle, virality.

All functions take the present as a parameter and return one row for each trend (and window). Buckets are anchored
at a trend's first post, except those of the lifecycle, which are anchored at the window's start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import clamp01, humanize, js_round, tier
from pulsegrid.functions.times import HOUR, age_hours, day_label


@dataclass(frozen=True)
class Span:
    """A trailing window: its hours, the half-life of its weights and the size of its buckets, all in hours."""

    name: str
    hours: int
    half_life: int
    bucket: int


#: The three windows.
SPANS = (Span("24h", 24, 4, 1), Span("7d", 168, 24, 6), Span("30d", 720, 72, 24))
#: Weights of the virality score's parts and the references they are scaled by.
VIRALITY = {"velocity": 0.35, "burst": 0.20, "acceleration": 0.15, "engagement": 0.15, "influence": 0.15}
ACCELERATION_REF, ENGAGEMENT_REF, INFLUENCE_REF = 10.0, 0.10, 3.0
PEAK_BUCKET = 6


def aged(posts: DataFrame, now: Column) -> DataFrame:
    return posts.withColumn("age_h", age_hours(F.col("published_at"), now))


def in_spans(posts: DataFrame, now: Column) -> DataFrame:
    """Each post once for every window that holds it; one pass, no union of three scans."""
    spans = F.array(*[F.struct(F.lit(s.name).alias("span"), F.lit(s.hours).alias("hours"), F.lit(s.half_life).alias("half_life"), F.lit(s.bucket).alias("bucket_h")) for s in SPANS])
    rows = aged(posts, now).where(F.col("age_h").isNotNull() & (F.col("published_at") <= now))
    return rows.withColumn("w", F.explode(F.filter(spans, lambda s: F.col("age_h") <= s["hours"]))).select("*", "w.*").drop("w")


def platform_activity(posts: DataFrame) -> DataFrame:
    return posts.groupBy("platform").agg(
        F.count(F.lit(1)).alias("posts"), js_round(F.sum(F.coalesce("interactions", F.lit(0.0))), 4).alias("interactions"), F.avg("engagement_rate").alias("r")
    ).select("platform", "posts", "interactions", F.when(F.col("r").isNotNull(), js_round(F.col("r"), 4)).alias("avg_engagement_rate"))


def reach(posts: DataFrame) -> DataFrame:
    total = posts.groupBy("trend").agg(F.sum("reach").alias("total"))
    return total.select("trend", F.when(F.coalesce("total", F.lit(0)) == 0, "Unknown").otherwise(humanize(F.col("total"))).alias("approximate_reach"))


def growth(posts: DataFrame) -> DataFrame:
    """First half of a trend's posts by time against the rest, by number of posts."""
    i = F.coalesce("interactions", F.lit(0.0))
    hour = F.floor(F.unix_micros("published_at") / HOUR).alias("hour")
    # sums by hour find the hour that holds the middle; only that hour's posts are put in order
    hours = posts.groupBy("trend", hour).agg(F.count(F.lit(1)).alias("n"), F.sum(i).alias("s"))
    w = Window.partitionBy("trend").orderBy("hour")
    upto = hours.select("*", F.sum("n").over(w).alias("upto"), F.floor(F.sum("n").over(Window.partitionBy("trend")) / 2).alias("half"))
    s = upto.groupBy("trend").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("upto") <= F.col("half"), F.col("s")).otherwise(0.0)).alias("before"), F.sum("s").alias("total"),
        F.min(F.when(F.col("upto") > F.col("half"), F.struct("hour", (F.col("half") - F.col("upto") + F.col("n")).alias("take")))).alias("edge"),
    )
    edge = s.select("trend", "edge.*").where("take > 0")
    at = posts.select("trend", hour, "published_at", "event_id", i.alias("i")).join(edge, ["trend", "hour"])
    first = at.select("trend", "i", "take", F.row_number().over(Window.partitionBy("trend").orderBy("published_at", "event_id")).alias("r")).where("r <= take")
    s = s.join(first.groupBy("trend").agg(F.sum("i").alias("more")), "trend", "left").withColumn("a", F.col("before") + F.coalesce("more", F.lit(0.0)))
    s = s.withColumn("b", F.col("total") - F.col("a"))
    change = js_round((F.col("b") - F.col("a")) / F.col("a") * 100)
    text = (
        F.when(F.col("n") < 2, "+0%")
        .when((F.col("a") == 0) & (F.col("b") > 0), "+∞%")
        .when(F.col("a") == 0, "+0%")
        .otherwise(F.concat(F.when(change >= 0, "+").otherwise(""), change.cast("long").cast("string"), F.lit("%")))
    )
    return s.select("trend", js_round(F.col("a"), 4).alias("first_half"), js_round(F.col("b"), 4).alias("second_half"), text.alias("growth"))


def peak(posts: DataFrame) -> DataFrame:
    """Six-hour bucket with most interactions against the mean of the non-empty ones; ties: the earliest."""
    start = posts.groupBy("trend").agg(F.min("published_at").alias("t0"))
    rows = posts.select("trend", "published_at", F.coalesce("interactions", F.lit(0.0)).alias("i")).join(start, "trend")
    b = F.floor((F.unix_micros("published_at") - F.unix_micros("t0")) / HOUR / PEAK_BUCKET)
    sums = rows.groupBy("trend", "t0", b.alias("b")).agg(F.sum("i").alias("s"), F.count(F.lit(1)).alias("n"))
    best = sums.groupBy("trend", "t0").agg(F.max(F.struct("s", (-F.col("b")).alias("nb"))).alias("m"), F.avg("s").alias("mean"), F.sum("n").alias("n"))
    at = F.timestamp_micros((F.unix_micros("t0") + (-F.col("m.nb")) * F.lit(int(PEAK_BUCKET * HOUR))).cast("long"))
    return best.select("trend", day_label(at).alias("peak_date"), F.concat(F.lit("+"), js_round(F.when((F.col("mean") > 0) & (F.col("n") >= 2), (F.col("m.s") - F.col("mean")) / F.col("mean") * 100).otherwise(0.0)).cast("long").cast("string"), F.lit("%")).alias("peak_growth"))


def fastest_platform(posts: DataFrame) -> DataFrame:
    """Platform with the most interactions an hour of visibility; ties: the one seen first."""
    speed = F.when(F.col("velocity_window") > 0, F.col("interactions") / F.col("velocity_window"))
    by = posts.groupBy("trend", "platform").agg(F.avg(speed).alias("v"), F.min(F.struct("published_at", "event_id")).alias("first"))
    best = by.groupBy("trend").agg(F.min(F.when(F.col("v").isNotNull(), F.struct((-js_round(F.col("v"), 6)).alias("v"), "first", "platform"))).alias("m"))
    return best.select("trend", F.coalesce("m.platform", F.lit("unknown")).alias("fastest_platform"), F.coalesce(-F.col("m.v"), F.lit(0.0)).alias("speed"))


def lifecycle(posts: DataFrame, now: Column, by: list[str] | None = None) -> DataFrame:
    """(…, span, bucket, bucket_start, posts, interactions): empty buckets inside a series kept, outer ones trimmed."""
    by = by or ["trend"]
    rows = in_spans(posts, now)
    start = F.unix_micros(now) - F.col("hours") * F.lit(int(HOUR))
    n = F.floor(F.col("hours") / F.col("bucket_h"))
    b = F.least(n - 1, F.greatest(F.lit(0), F.floor((F.unix_micros("published_at") - start) / HOUR / F.col("bucket_h"))))
    sums = rows.groupBy(*by, "span", "hours", "bucket_h", b.alias("bucket")).agg(F.count(F.lit(1)).alias("posts"), F.sum(F.coalesce("interactions", F.lit(0.0))).alias("s"))
    spine = sums.groupBy(*by, "span", "hours", "bucket_h").agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"))
    spine = spine.withColumn("bucket", F.explode(F.sequence("a", "z"))).drop("a", "z")
    at = F.timestamp_micros((start + F.col("bucket") * F.col("bucket_h") * F.lit(int(HOUR))).cast("long"))
    joined = spine.join(sums.drop("hours", "bucket_h"), [*by, "span", "bucket"], "left")
    return joined.select(*by, "span", "bucket", at.alias("bucket_start"), F.coalesce("posts", F.lit(0)).alias("posts"), js_round(F.coalesce("s", F.lit(0.0)), 4).alias("interactions"))


def dynamics(posts: DataFrame, now: Column, by: list[str] | None = None, least: int = 2) -> DataFrame:
    """Velocity, acceleration, burst, virality and tier for each trend and window; weights fall with age.

    posts: trend, published_at, interactions, influence (multiplier), engagement_rate. The partial sums of the
    buckets are all that is shuffled.
    """
    by = by or ["trend"]
    keys = [*by, "span", "bucket_h"]
    rows = in_spans(posts, now)
    weight = F.exp(-F.log(F.lit(2.0)) / F.col("half_life") * F.col("age_h")) * F.col("influence")
    i = F.coalesce("interactions", F.lit(0.0))
    first = rows.groupBy(*by, "span").agg(F.min("published_at").alias("t0"))
    at = rows.join(first, [*by, "span"])
    b = F.floor((F.unix_micros("published_at") - F.unix_micros("t0")) / HOUR / F.col("bucket_h"))
    sums = at.groupBy(*keys, b.alias("b")).agg(
        F.sum(i * weight).alias("s"), F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"), F.sum("influence").alias("f"),
        F.sum("engagement_rate").alias("e"), F.count("engagement_rate").alias("en"),
    )
    x = F.col("b") * F.col("bucket_h")
    t = sums.groupBy(*keys).agg(
        F.sum("n").alias("post_count"), F.sum("s").alias("total"), F.max("s").alias("most"), F.sum("w").alias("w"), F.min("b").alias("b0"), F.max("b").alias("b1"),
        F.regr_slope("s", x).alias("slope"), F.max(F.struct("s", (-F.col("b")).alias("nb"))).alias("top"), F.sum("f").alias("f"), F.sum("e").alias("e"), F.sum("en").alias("en"),
    )
    enough = F.col("post_count") >= least
    pick = lambda c: F.when(enough, c).otherwise(0.0)
    hours = F.greatest((F.col("b1") - F.col("b0")) * F.col("bucket_h"), F.col("bucket_h"))
    t = t.withColumns({
        "velocity": pick(F.col("total") / hours), "acceleration": pick(js_round(F.coalesce("slope", F.lit(0.0)), 4)),
        "burst_score": pick(F.when(F.col("total") > 0, js_round(F.col("most") / F.col("total"), 4)).otherwise(0.0)),
        "peak_bucket_hour": F.when(enough, -F.col("top.nb") * F.col("bucket_h")).otherwise(0),
        "weighted_mean": pick(F.when(F.col("w") > 0, F.col("total") / F.col("w")).otherwise(0.0)),
        "avg_influence": js_round(F.col("f") / F.col("post_count"), 4), "avg_engagement": F.when(F.col("en") > 0, js_round(F.col("e") / F.col("en"), 4)),
    })
    v = F.when(F.col("velocity") > 0, clamp01(F.log10(1 + F.col("velocity")) / F.log10(F.lit(11.0)))).otherwise(0.0)
    a = F.when(F.col("acceleration") > 0, clamp01(F.col("acceleration") / ACCELERATION_REF)).otherwise(0.0)
    e = F.when(F.col("avg_engagement") > 0, clamp01(F.col("avg_engagement") / ENGAGEMENT_REF)).otherwise(0.0)
    f = F.when(F.col("avg_influence") > 1, clamp01((F.col("avg_influence") - 1) / INFLUENCE_REF)).otherwise(0.0)
    parts = {"velocity": v, "burst": F.col("burst_score"), "acceleration": a, "engagement": e, "influence": f}
    score = sum((VIRALITY[k] * p for k, p in parts.items() if k != "velocity"), VIRALITY["velocity"] * parts["velocity"])
    t = t.withColumn("virality_score", pick(js_round(score, 4)))
    return t.select(
        *by, "span", "post_count", js_round(F.col("velocity"), 4).alias("velocity"), "acceleration", "burst_score", "peak_bucket_hour", js_round(F.col("weighted_mean"), 4).alias("weighted_mean"),
        "avg_influence", "avg_engagement", "virality_score", tier(F.col("virality_score")).alias("virality_tier"), js_round(clamp01(F.col("virality_score")) * 100).alias("trend_score"),
    )


def before(rows: DataFrame, value: str, by: str, at: str, tie: str, minutes: int = 10) -> DataFrame:
    """Adds previous: the value of the row before in its series. Rows are put in order within short slots of time; the
    last value of each slot goes on to the first row of the next, so no series is sorted as a whole."""
    slotted = rows.withColumn("slot", F.floor(F.unix_micros(at) / F.lit(minutes * 60_000_000)))
    w = Window.partitionBy(by, "slot").orderBy(at, tie)
    own = slotted.withColumns({"place": F.row_number().over(w), "lagged": F.lag(value).over(w)})
    ends = slotted.groupBy(by, "slot").agg(F.max_by(value, F.struct(at, tie)).alias("last"))
    ends = ends.select(F.col(by).alias("of"), F.col("slot").alias("in_slot"), F.lag("last").over(Window.partitionBy(by).orderBy("slot")).alias("ended"))
    joined = own.join(ends, F.col(by).eqNullSafe(F.col("of")) & F.col("slot").eqNullSafe(F.col("in_slot")), "left")
    return joined.select(*rows.columns, F.when(F.col("place") == 1, F.col("ended")).otherwise(F.col("lagged")).alias("previous"))


def top_posts(posts: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """For each window its posts of greatest influence; an author may come several times."""
    w = Window.partitionBy("span").orderBy(F.desc("influence"), "event_id")
    return in_spans(posts, now).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("span", "place", "event_id", "user_id", "influence")


def analyze_trend(posts: DataFrame, now: Column) -> DataFrame:
    """One row a trend: the 30-day dynamics, growth, peak, fastest platform and reach together."""
    main = dynamics(posts, now).where(F.col("span") == "30d").drop("span")
    for part in (growth(posts), peak(posts), fastest_platform(posts), reach(posts)):
        main = main.join(part, "trend", "left")
    return main
