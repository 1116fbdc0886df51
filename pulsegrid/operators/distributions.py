"""Counts, shares, co-occurrence and other read queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import js_round
from pulsegrid.session import checkpoint_folder


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of each key, most first."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Share of each key in percent; what rounding leaves over goes to the largest."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # over one row a key
    pct = js_round(100 * F.col("n") / F.sum("n").over(every)).cast("long")
    first = F.row_number().over(Window.orderBy(F.desc("n"), by)) == 1
    left = n.withColumn("share", pct).withColumn("left", 100 - F.sum("share").over(every))
    return left.select(by, "n", F.when(first, F.col("share") + F.col("left")).otherwise(F.col("share")).alias("share"))


def age_histogram(rows: DataFrame, created: str, now: Column) -> DataFrame:
    """Accounts by age in years of 365.25 days; all five classes, also empty ones."""
    years = (F.unix_micros(now) - F.unix_micros(created)) / (365.25 * 86_400_000_000)
    label = F.when(years < 0.5, "<6m").when(years < 1, "6m-1y").when(years < 3, "1-3y").when(years < 5, "3-5y").otherwise("5y+")
    spine = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(("<6m", "6m-1y", "1-3y", "3-5y", "5y+"))], "ord int, age string")
    found = rows.where(F.col(created).isNotNull()).groupBy(label.alias("age")).agg(F.count(F.lit(1)).alias("c"))
    return spine.join(found, "age", "left").select("ord", "age", F.coalesce("c", F.lit(0)).alias("n"))


def tag_pairs(rows: DataFrame, tags: str, *by: str) -> DataFrame:
    """(…, tag_a < tag_b, n): pairs of distinct lower-case tags of a post. A post's own tags are paired inside its
    row, so nothing is joined."""
    t = F.array_sort(F.array_distinct(F.transform(F.col(tags), F.lower)))
    pairs = F.flatten(F.transform(t, lambda a, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(*by, F.explode(pairs).alias("p")).groupBy(*by, F.col("p.a").alias("tag_a"), F.col("p.b").alias("tag_b")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_metrics(posts: DataFrame, *by: str) -> DataFrame:
    """Posts, distinct authors by platform, sums of counters (Reddit's score stands in for likes), newest post."""
    author = F.when(F.col("author_id").isNotNull(), F.concat_ws(":", "platform", F.col("author_id").cast("string")))
    likes = F.when(F.col("platform") == "reddit", F.coalesce("likes", "score")).otherwise(F.col("likes"))
    return posts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("posts"), F.count_distinct(author).alias("authors"), F.coalesce(F.sum(likes), F.lit(0)).alias("likes"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("replies", "reposts", "quotes", "views")], F.max("published_at").alias("newest"),
    )


#: Accuracy of the sketch that tells where a rank lies; the share of rows counted by value is about four over it.
ACCURACY = 10_000


def at_ranks(rows: DataFrame, value: str, ranks: dict[str, tuple[float, Column]], *by: str) -> DataFrame:
    """(…, n, mean, min, max, a value for each rank) of each group's known values; exact.

    ranks: name to (about which share of the values lies below, the rank from 0 as an expression of n). A mergeable
    sketch bounds where each rank lies; values below are only counted, those within by value, so no group is sorted.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, value)
    near = lambda q, d: F.percentile_approx(value, min(1.0, max(0.0, q + d)), ACCURACY)
    bounds = [f(q).alias(f"{side}_{k}") for k, (q, _) in ranks.items() for side, f in (("lo", lambda q: near(q, -2 / ACCURACY)), ("hi", lambda q: near(q, 2 / ACCURACY)))]
    stats = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), js_round(F.avg(value), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *bounds)
    named = stats.select(*[F.col(c).alias(f"g_{c}") for c in by], *[c for c in stats.columns if c[:3] in ("lo_", "hi_")])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    v = F.col(value)
    at = F.array(*[F.when(v < F.col(f"lo_{k}"), F.struct(F.lit(k).alias("k"), F.lit(None).cast(dict(rows.dtypes)[value]).alias("v"))).when(v <= F.col(f"hi_{k}"), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k in ranks])
    counted = known.join(named, same).select(*by, F.explode(F.array_compact(at)).alias("at")).groupBy(*by, "at.k", "at.v").agg(F.count(F.lit(1)).alias("c"))
    # null, what lies below, comes first
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)))
    joined = upto.where("v is not null").join(stats.select(*[F.col(c).alias(f"g_{c}") for c in by], "n"), same)
    pick = [F.min(F.when((F.col("k") == k) & (F.col("upto") > rank), F.col("v"))).alias(k) for k, (_, rank) in ranks.items()]
    found = joined.groupBy(*by).agg(*pick)
    renamed = found.select(*[F.col(c).alias(f"g_{c}") for c in by], *ranks)
    return stats.join(renamed, same).select(*by, "n", "mean", "min", "max", *ranks)


def nearest_rank(rows: DataFrame, value: str, quantiles: dict[str, float], *by: str) -> DataFrame:
    """sorted[floor(n * q)] of each group: the row of that place, not an interpolation."""
    n = F.col("n")
    return at_ranks(rows, value, {k: (q, F.least(F.floor(n * q), n - 1)) for k, q in quantiles.items()}, *by)


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def first_folded(rows: DataFrame, name: str, order: str, most: int) -> DataFrame:
    """The first rows of each name, whatever its case, in order, at most so many."""
    key = F.lower(F.trim(F.col(name)))
    first = rows.where(F.coalesce(key, F.lit("")) != "").groupBy(key.alias("key")).agg(F.min_by(name, order).alias(name), F.min(order).alias(order))
    return first.orderBy(order).limit(most).select(name, order)


def interest_timeline(rows: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Mean (two decimals), latest, largest and smallest value of each series."""
    return rows.groupBy(by).agg(js_round(F.avg(value), 2).alias("average"), F.max_by(value, at).alias("latest"), F.max(value).alias("highest"), F.min(value).alias("lowest"))


def kept_by_share(rows: DataFrame, score: str, key: str, least: int, share: float) -> DataFrame:
    """The best rows: a share of them, but at least so many; ties by key. The score of the last is found by its rank, so
    only rows of that score are put in order. The rows are written once, as several steps look at them."""
    checkpoint_folder(rows.sparkSession)
    rows = rows.checkpoint()
    n = rows.count()
    most = max(least, int(n * share + 0.5))
    scored, rest = rows.where(F.col(score).isNotNull()), rows.where(F.col(score).isNull())
    m = scored.count()
    if most >= m:
        return scored.unionByName(rest.orderBy(key).limit(most - m))
    cut = at_ranks(scored.withColumn("of_all", F.lit(1)), score, {"cut": ((m - most) / m, F.lit(m - most))}, "of_all").first()["cut"]
    above = scored.where(F.col(score) > F.lit(cut))
    return above.unionByName(scored.where(F.col(score) == F.lit(cut)).orderBy(key).limit(most - above.count()))


def rollups(posts: DataFrame, grains: dict[str, str] | None = None, *dims: str) -> DataFrame:
    """Metrics of each trend, granularity, bucket and dimension. One pass: each post is expanded to its buckets."""
    grains = grains or {"6h": "6 hours", "1d": "1 day", "7d": "7 days", "30d": "30 days"}
    hours = {"6h": 6, "1d": 24, "7d": 168, "30d": 720}
    at = F.unix_micros("published_at")
    starts = F.array(*[F.struct(F.lit(g).alias("granularity"), F.timestamp_micros((F.floor(at / (hours[g] * 3.6e9)) * int(hours[g] * 3.6e9)).cast("long")).alias("bucket_start")) for g in grains])
    rows = posts.withColumn("g", F.explode(starts)).select("*", "g.*")
    return rows.groupBy("trend", "granularity", "bucket_start", *dims).agg(
        F.count(F.lit(1)).alias("mentions"), F.count_distinct("author_id").alias("authors"), js_round(F.sum("interactions"), 4).alias("engagement"),
        js_round(F.avg("interactions"), 8).alias("average"), F.max("interactions").alias("peak"),
    )


#: Categories of which a run has one result each.
CATEGORIES = ("sentiment", "demographic", "trend", "network")


def fan_in(results: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(run_id, …, problem): one result of each category for a run; missing, duplicate and unexpected ones are named."""
    by = results.groupBy("run_id").agg(
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories], *[F.max(F.when(F.col("category") == c, F.col("payload"))).alias(c) for c in categories],
        F.count_if(~F.col("category").isin(*categories)).alias("unexpected"),
    )
    missing = F.array_compact(F.array(*[F.when(F.col(f"n_{c}") == 0, F.lit(f"missing {c}")) for c in categories], *[F.when(F.col(f"n_{c}") > 1, F.lit(f"duplicate {c}")) for c in categories], F.when(F.col("unexpected") > 0, F.lit("unexpected category"))))
    return by.select("run_id", *categories, F.array_join(missing, "; ").alias("problem"))


def dimension_rollups(posts: DataFrame, dims: tuple[str, ...], grains: dict[str, str] | None = None) -> DataFrame:
    """(trend, granularity, bucket_start, dimension, value, mentions, average, peak, share): each dimension by itself in
    one pass; share in percent of the bucket's mentions, 2 decimals."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    found = rollups(posts.withColumn("d", F.explode(pairs)).select("*", "d.*"), grains, "dimension", "value").select("trend", "granularity", "bucket_start", "dimension", "value", "mentions", "average", "peak")
    total = F.sum("mentions").over(Window.partitionBy("trend", "granularity", "bucket_start", "dimension"))  # over one row a value
    return found.withColumn("share", js_round(100.0 * F.col("mentions") / total, 2))


def benchmark(rows: DataFrame, expected: str, predicted: str, latency: str, *by: str) -> DataFrame:
    """(…, n, correct, accuracy, mean latency, p50, p95): accuracy with 4 decimals, latencies by nearest rank."""
    scores = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(expected).eqNullSafe(F.col(predicted))).alias("correct"))
    late = nearest_rank(rows, latency, {"p50": 0.5, "p95": 0.95}, *by).select(*by, "mean", "p50", "p95")
    return scores.withColumn("accuracy", js_round(F.col("correct") / F.col("n"), 4)).join(late, list(by), "left")


def reaction_total(reactions: Column) -> Column:
    """Sum of the known counts of an array of reactions; null where there is none."""
    counts = F.filter(F.transform(reactions, lambda r: r["count"]), lambda c: c.isNotNull())
    return F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c))


def argmax_label(rows: DataFrame, label: str, value: str, *by: str) -> DataFrame:
    """The label of the largest value of each group, ties to the smaller label, and that value."""
    best = rows.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col(label).alias("l"))).alias("m"))
    return best.select(*by, F.col("m.l").alias(label), (-F.col("m.v")).alias(value))
