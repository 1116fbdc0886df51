"""Leaderboards, score history and forecasts over snapshots (trend, captured_at, score, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import clamp_scale, js_round, tier_order
from pulsegrid.operators.scoreboard import bucket_of, standings
from pulsegrid.session import checkpoint_folder

#: Weights of the forecast score and the bounds its signals are scaled by.
FORECAST = {"velocity": 0.25, "acceleration": 0.20, "burst": 0.15, "engagement": 0.15, "influence": 0.10, "rank": 0.10, "spread": 0.05}
HISTORY, READ, EXPOSED, STALE_DAYS, SPREAD_MINUTES = 100, 20, 10, 7, 45


def _history(by: str = "trend") -> Window:
    return Window.partitionBy(by).orderBy("captured_at")


def latest(snapshots: DataFrame, by: str = "trend") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("captured_at"))
    return snapshots.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def leaderboard(snapshots: DataFrame, most: int = 50) -> DataFrame:
    """Trends by their latest score; ties: the greater name first. A few rows reach one task, the top of each."""
    top = latest(snapshots).select("trend", "score").orderBy(F.desc("score"), F.desc("trend")).limit(most)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("trend"))))


def percentiles(snapshots: DataFrame) -> DataFrame:
    """Position from the top and percentile (ascending rank over number) among all trends, by the order statistics of the
    registry: counts by bucket of score, and places within buckets."""
    checkpoint_folder(snapshots.sparkSession)
    now = latest(snapshots).select(F.col("trend").alias("member"), F.col("score").cast("double").alias("score")).checkpoint()
    by = now.groupBy(bucket_of(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return standings(now, by).select(F.col("member").alias("trend"), "score", "rank", "position", "percentile")


def movement(snapshots: DataFrame) -> DataFrame:
    """Change of score and tier from the snapshot before: the change is null and the movement stable for the first;
    a change between tiers is rising or falling, unknown tiers order below all."""
    w = _history()
    before = F.lag("tier").over(w)
    moved = F.when(F.lag("captured_at").over(w).isNull() | F.col("tier").eqNullSafe(before), "stable").when(tier_order(F.col("tier")) > tier_order(before), "rising").otherwise("falling")
    return snapshots.select("trend", "captured_at", "score", "tier", (F.col("score") - F.lag("score").over(w)).alias("score_delta"), moved.alias("tier_movement"))


def capped_history(snapshots: DataFrame, most: int = HISTORY) -> DataFrame:
    """The newest snapshots of each trend, newest first."""
    w = Window.partitionBy("trend").orderBy(F.desc("captured_at"))
    return snapshots.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def fresh(snapshots: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Trends updated within so many days."""
    last = snapshots.groupBy("trend").agg(F.max("captured_at").alias("updated"))
    return last.where(F.unix_micros("updated") >= F.unix_micros(now) - days * 86_400_000_000)


def momentum(snapshots: DataFrame) -> DataFrame:
    """Differences to the snapshot before; a better rank counts up."""
    w = _history()
    delta = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    return snapshots.select(
        "*", delta("velocity").alias("d_velocity"), delta("acceleration").alias("d_acceleration"), delta("engagement").alias("d_engagement"),
        delta("virality").alias("d_virality"), F.coalesce(F.lag("rank").over(w) - F.col("rank"), F.lit(0)).alias("d_rank"),
        (F.col("platforms") > F.coalesce(F.lag("platforms").over(w), F.col("platforms"))).alias("spread"),
    )


def smoothed(snapshots: DataFrame, alpha: float = 0.3, most: int = READ) -> DataFrame:
    """Exponential moving average, oldest to newest, over the newest snapshots of each trend."""
    lists = capped_history(snapshots, most).groupBy("trend").agg(F.array_sort(F.collect_list(F.struct("captured_at", "score"))).alias("h"))
    scores = F.transform("h", lambda h: h["score"])
    ema = F.aggregate(F.slice(scores, 2, most), F.element_at(scores, 1), lambda a, x: a * (1 - alpha) + x * alpha)
    return lists.select("trend", js_round(ema, 4).alias("ema"))


def hourly_rate(snapshots: DataFrame) -> DataFrame:
    """Change an hour between the newest and the third newest snapshot (or the oldest of fewer)."""
    few = capped_history(snapshots, 3).groupBy("trend").agg(
        F.max_by("score", "captured_at").alias("s0"), F.min_by("score", "captured_at").alias("s2"), F.max("captured_at").alias("t0"), F.min("captured_at").alias("t2"), F.count(F.lit(1)).alias("n")
    )
    hours = (F.unix_micros("t0") - F.unix_micros("t2")) / 3.6e9
    return few.select("trend", "s0", F.when((F.col("n") >= 2) & (hours > 0), (F.col("s0") - F.col("s2")) / hours).otherwise(0.0).alias("rate"))


def forecast(snapshots: DataFrame) -> DataFrame:
    """Score, breakout, growth and decline probabilities, direction, 6/12/24-hour horizons, time to peak, the next likely
    platform and confidence of each trend's newest snapshot against the one before. Only results are rounded.

    snapshots may hold fastest_platform: a trend that has just spread to a further platform goes on to Telegram from X,
    else to Reddit, in about SPREAD_MINUTES; without the column nothing is known of it."""
    if "fastest_platform" not in snapshots.columns:
        snapshots = snapshots.withColumn("fastest_platform", F.lit(None).cast("string"))
    counted = snapshots.groupBy("trend").agg(F.count(F.lit(1)).alias("history"))
    now = latest(momentum(snapshots)).join(hourly_rate(snapshots), "trend").join(counted, "trend")
    signals = {
        "velocity": clamp_scale(F.col("d_velocity"), -10, 10), "acceleration": clamp_scale(F.col("d_acceleration"), -5, 5), "burst": clamp_scale(F.col("burst"), 0, 100),
        "engagement": clamp_scale(F.col("d_engagement"), 0, 1000), "influence": clamp_scale(F.col("d_virality"), 0, 1), "rank": clamp_scale(F.col("d_rank").cast("double"), 0, 10),
        "spread": F.col("spread").cast("double"),
    }
    total = F.lit(0.0)
    for name, weight in FORECAST.items():
        total = total + weight * signals[name]
    now = now.withColumn("forecast_score", js_round(total * 100))
    bonus = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    chance = (
        0.5 * F.col("forecast_score") + bonus(F.col("d_acceleration") > 0, 20) + bonus(F.col("d_acceleration") > 2, 10)
        + bonus(F.col("d_velocity") > 0, 10) + bonus(F.col("d_engagement") > 100, 10) + bonus(F.col("spread"), 10)
    )
    now = now.withColumn("chance", F.greatest(F.lit(0.0), F.least(F.lit(100.0), chance))).withColumn("breakout", js_round(F.col("chance")))
    onward = F.col("spread") & (F.col("platforms") > 1) & F.col("fastest_platform").isNotNull()
    falling = (F.col("d_velocity") < 0) & (F.col("d_acceleration") < 0)
    direction = (
        F.when((F.col("chance") >= 80) & (F.col("d_acceleration") > 0), "breakout")
        .when((F.col("forecast_score") >= 70) & (F.col("d_velocity") > 0), "strongly_rising")
        .when((F.col("forecast_score") >= 50) & (F.col("d_velocity") > 0), "rising")
        .when(falling & (F.col("score") > 70), "weakening")
        .when(falling, "declining")
        .otherwise("stable")
    )
    known = F.col("history") >= 2
    ahead = lambda h: F.when(known, js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") + F.col("rate") * (F.col("forecast_score") / 50) * h))))
    hours = js_round(F.try_divide(100 - F.col("score"), F.col("rate")))
    confidence = F.when(~known, "insufficient_data").when(F.col("history") < 5, "low").when(F.col("history") < 10, "medium").otherwise("high")
    return now.select(
        "trend", "score", "forecast_score", "breakout", direction.alias("direction"), ahead(6).alias("h6"), ahead(12).alias("h12"), ahead(24).alias("h24"),
        F.when(known & (F.col("rate") > 0) & (hours <= 72), hours).alias("hours_to_peak"), js_round(F.col("breakout") * 0.9).alias("growth_6h"), js_round(F.col("breakout") * 0.8).alias("growth_24h"),
        (100 - js_round(F.col("breakout") * 0.9)).alias("decline_6h"), (100 - js_round(F.col("breakout") * 0.8)).alias("decline_24h"),
        F.when(onward, F.when(F.col("fastest_platform") == "x", "telegram").otherwise("reddit")).alias("next_platform"), F.when(onward, SPREAD_MINUTES).alias("spread_minutes"), confidence.alias("confidence"),
    )


def backtest(snapshots: DataFrame, lag: int = 24) -> DataFrame:
    """Share of snapshots whose score lies above the one so many before; trends with fewer snapshots are left out."""
    before = F.lag("score", lag).over(_history())
    compared = snapshots.select("trend", (F.col("score") > before).alias("rose")).where(F.col("rose").isNotNull())
    return compared.groupBy("trend").agg(F.count(F.lit(1)).alias("compared"), F.count_if("rose").alias("rising"), js_round(F.avg(F.col("rose").cast("double")), 4).alias("share"))


def phases(batches: DataFrame) -> DataFrame:
    """rising, decaying or peaking by the last against the first of up to three scores; new for a single one."""
    w = _history().rowsBetween(-2, 0)
    n, first, last = F.count(F.lit(1)).over(w), F.first("score").over(w), F.last("score").over(w)
    return batches.withColumn("phase", F.when(n < 2, "new").when(last > first, "rising").when(last < first, "decaying").otherwise("peaking"))


def rank_score(rank: Column) -> Column:
    """Chart score of a rank: 15 and better count, missing and 0 are 0."""
    return F.when(F.coalesce(rank, F.lit(0)) == 0, 0.0).otherwise(js_round((16 - rank) * 6.67))


def densified(batches: DataFrame) -> DataFrame:
    """Every trend in every batch: rank null and score 0 where it is missing. The spine is trends times batches, the
    series that is asked for; times are dealt into parts and every trend meets each part."""
    parts = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = batches.select("captured_at").distinct().withColumn("part", F.pmod(F.xxhash64("captured_at"), F.lit(parts)))
    trends = batches.select("trend").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    spine = trends.join(times, "part").select("trend", "captured_at")
    found = spine.join(batches.select("trend", "captured_at", "rank"), ["trend", "captured_at"], "left")
    return found.withColumn("chart_score", rank_score(F.col("rank")))
