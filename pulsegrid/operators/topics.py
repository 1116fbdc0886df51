"""Topics side by side: related ones and orders of narratives; countries, regions of interest, demographics; raw dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.scoreboard import row_numbers

RELATED = 5


def related(topics: DataFrame, most: int = RELATED) -> DataFrame:
    """(topic, place, related, growth): for each topic (topic, growth) the others of highest growth, at most so many;
    ties by name. Only the first most + 1 of all are needed, so topics meet a handful of rows, not each other."""
    first = topics.where("growth is not null").orderBy(F.desc("growth"), "topic").limit(most + 1)
    listed = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("growth")).alias("g"), F.col("topic").alias("related")))).alias("all"))
    others = topics.select("topic").crossJoin(F.broadcast(listed)).select("topic", F.slice(F.filter("all", lambda x: x["related"] != F.col("topic")), 1, most).alias("r"))  # one row
    return others.select("topic", F.posexplode("r").alias("at", "r")).select("topic", (F.col("at") + 1).alias("place"), "r.related", (-F.col("r.g")).alias("growth"))


def narrative_orders(narratives: DataFrame) -> DataFrame:
    """Adds by_most, by_least, by_growth and by_recent: the place of each narrative (trend, n, growth, latest) by activity
    either way, growth and time; ties by name. No order is sorted in one task."""
    keyed = narratives.withColumns({"k_most": -F.col("n"), "k_growth": -F.col("growth"), "k_recent": -F.unix_micros("latest")})
    for name, key in (("by_most", "k_most"), ("by_least", "n"), ("by_growth", "k_growth"), ("by_recent", "k_recent")):
        keyed = row_numbers(keyed, [], [key, "trend"], name)
    return keyed.drop("k_most", "k_growth", "k_recent")


def filtered(narratives: DataFrame, sentiment: str = "", platform: str = "") -> DataFrame:
    """Narratives (sentiment, platforms: map of counts) of a sentiment, whatever the case, and with posts on a platform;
    a narrative without any platforms passes, a blank filter passes all."""
    same = F.lit(not sentiment.strip()) | F.coalesce(F.lower(F.trim("sentiment")) == sentiment.strip().lower(), F.lit(False))
    there = F.lit(not platform.strip()) | F.col("platforms").isNull() | (F.coalesce(F.try_element_at("platforms", F.lit(platform)), F.lit(0)) > 0)
    return narratives.where(same & there)


def country_codes(rows: DataFrame, column: str, countries: DataFrame) -> DataFrame:
    """Adds code and problem: two letters as they are, in capitals; else the code of the country of that name (name, code),
    whatever the case; a blank one is worldwide and has neither; a problem where the name is not known."""
    asked = F.trim(F.col(column))
    known = countries.groupBy(F.lower(F.trim("name")).alias("name_")).agg(F.min("code").alias("code_"))
    met = rows.drop("code", "problem").join(known, F.lower(asked) == F.col("name_"), "left")
    two = asked.rlike("^[A-Za-z]{2}$")
    blank = asked.isNull() | (asked == "")
    code = F.when(two, F.upper(asked)).otherwise(F.col("code_"))
    problem = F.when(~blank & ~two & F.col("code_").isNull(), F.concat(F.lit("unknown country "), asked))
    return met.withColumns({"code": code, "problem": problem}).drop("name_", "code_")


def interest_regions(landed: DataFrame, *by: str) -> DataFrame:
    """(…, place, region, value): landed interest (…, region, value) by region, largest value first, ties by name; a
    missing value is 0."""
    values = landed.groupBy(*by, "region").agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value")).withColumn("k_", -F.col("value"))
    return row_numbers(values, list(by), ["k_", "region"], "place").select(*by, "place", "region", "value")


def demographics(posts: DataFrame, timeline: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """One row of each collection: events, profiles (distinct authors), points of the landed timeline, regions. Age and
    gender stay null: interest by region doesn't tell them."""
    own = posts.groupBy(by).agg(F.count(F.lit(1)).alias("event_count"), F.count_distinct("platform", "author_id").alias("profiles_available"))
    points = timeline.groupBy(by).agg(F.count(F.lit(1)).alias("timeline_points"))
    places = regions.groupBy(by).agg(F.count_distinct("region").alias("regions"))
    met = own.join(points, by, "left").join(places, by, "left")
    none = [F.lit(None).cast("string").alias(c) for c in ("top_age", "top_region", "age_distribution", "gender_distribution", "professional_interests")]
    return met.select(by, "event_count", "profiles_available", F.coalesce("timeline_points", F.lit(0)).alias("timeline_points"), F.coalesce("regions", F.lit(0)).alias("regions"), *none)


def with_referenced(primary: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, each once: a primary row before a referenced one, of equal ones the smaller."""
    rest = [c for c in primary.columns if c != key]
    both = primary.withColumn("rank_", F.lit(0)).unionByName(referenced.select(*primary.columns).withColumn("rank_", F.lit(1)))
    best = both.groupBy(key).agg(F.min(F.struct("rank_", *rest)).alias("r"))
    return best.select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in primary.columns])


def dump_raw(rows: DataFrame, path: str, source: Column, at: Column) -> None:
    """Write raw payloads (value) below their source and day; a rerun of a source's day replaces it."""
    dealt = rows.select("value", source.alias("source"), F.to_date(at).alias("day"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "day").option("compression", "gzip").text(path)
