"""Composed analyses, keys, filters, validation and integrity queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import numbers as N
from pulsegrid.functions import text as X
from pulsegrid.operators import distributions as D
from pulsegrid.operators import graph as G
from pulsegrid.operators import integrity as I
from pulsegrid.operators import merkle as L
from pulsegrid.operators import normalize as M
from pulsegrid.operators import ranking as R
from pulsegrid.operators import topics as O
from pulsegrid.operators import rules as P
from pulsegrid.operators import trend as T
from pulsegrid.operators import validate as V
from pulsegrid.plans import trend_queries as Q
from pulsegrid.plans.views import LINKS, POSTS, SNAPSHOTS, jr, links, now, posts, snapshots
from pulsegrid.session import table

S = SparkSession
LANGUAGES, REGIONS, SENTIMENTS = ("en", "de", "fr", "es"), ("Kerala", "Delhi", "Other", "Bihar", "Gujarat"), ("positive", "neutral", "negative")


def pick(values: tuple[str, ...], of: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (of % len(values) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], of: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({of}) % {len(values)} + 1]"


def _described(spark: S, d: str) -> DataFrame:
    return posts(spark, d).withColumns({"language": pick(LANGUAGES, F.col("k")), "region": pick(REGIONS, F.col("k")), "sentiment": pick(SENTIMENTS, F.col("user_id"))})


DESCRIBED = f"{POSTS}, described AS (SELECT *, {sql_pick(LANGUAGES, 'k')} AS language, {sql_pick(REGIONS, 'k')} AS region, {sql_pick(SENTIMENTS, 'user_id')} AS sentiment FROM posts)"


HALVES = f"""r0 AS (SELECT trend, interactions AS i, row_number() OVER (PARTITION BY trend ORDER BY published_at, event_id) <= count(*) OVER (PARTITION BY trend) // 2 AS early FROM posts),
halves AS (SELECT trend, {jr(f"{jr('sum(CASE WHEN early THEN 0 ELSE i END)', 4)} - {jr('sum(CASE WHEN early THEN i ELSE 0 END)', 4)}", 4)} AS growth FROM r0 GROUP BY 1)"""


def trend_analysis(spark: S, d: str) -> DataFrame:
    """The 30-day dynamics, growth, peak, fastest platform, reach, activity and lifecycle of each trend in one row."""
    p = posts(spark, d).withColumns({"influence": F.lit(1.0), "engagement_rate": F.lit(None).cast("double")})
    found = T.analyze_trend(p, now()).drop("avg_influence", "avg_engagement", "weighted_mean", "first_half", "second_half", "speed")
    life = T.lifecycle(p, now()).where(F.col("span") == "30d").groupBy("trend").agg(F.count(F.lit(1)).alias("life_buckets"), F.max("posts").alias("life_most"))
    platforms = p.groupBy("trend").agg(F.count_distinct("platform").alias("platforms"), N.js_round(F.sum("interactions"), 4).alias("interactions"))
    return found.join(life, "trend", "left").join(platforms, "trend", "left")


def _network(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    day = lambda rows: rows.withColumn("day", F.date_format("published_at", "yyyy-MM-dd"))
    p = day(posts(spark, d)).select("day", F.concat(F.lit("x:"), F.col("user_id").cast("string")).alias("id"), "published_at", "event_id", F.array(F.concat(F.lit("#"), "trend")).alias("hashtags"))
    return p, day(links(spark, d))


def network_analysis(spark: S, d: str) -> DataFrame:
    """The network of each day's collection."""
    return G.analyze_network(*_network(spark, d), "day", exact=False)


def network_flags(spark: S, d: str) -> DataFrame:
    return G.analyze_network(*_network(spark, d), "day").select("day", "avg_betweenness", "suspected")


def rollup_dimensions(spark: S, d: str) -> DataFrame:
    return D.dimension_rollups(_described(spark, d), ("sentiment", "language", "region", "platform"))


def edge_keys(spark: S, d: str) -> DataFrame:
    authors = posts(spark, d).where("k % 5 > 0").select("platform", "author_id", (F.col("user_id") + 1000).alias("author_key")).distinct()
    edges = posts(spark, d).select("platform", F.col("author_id").alias("src"), (F.col("k") % 100).cast("string").alias("dst")).distinct()
    return G.edge_keys(edges, authors)


def post_trends(spark: S, d: str) -> DataFrame:
    p = posts(spark, d).select("event_id", X.trend_key(F.col("trend")).alias("trend_key"))
    return G.trend_bridge(p, p.where("trend_key < 'e'").select("trend_key").distinct())


def leaderboard_details(spark: S, d: str) -> DataFrame:
    """The leaderboard's trends with what is known of them."""
    details = posts(spark, d).groupBy("trend").agg(F.min("published_at").alias("first_seen"), F.count(F.lit(1)).alias("posts"))
    return R.leaderboard(snapshots(spark, d), 3).join(details, "trend", "left").select("position", "trend", "first_seen", "posts")


def latest_batches(spark: S, d: str) -> DataFrame:
    """The newest hour of each platform, and its eight trends of most engagement."""
    rows = posts(spark, d).withColumn("fetched", F.date_trunc("hour", "published_at"))
    newest = rows.groupBy("platform").agg(F.max("fetched").alias("fetched"))
    by = rows.join(newest, ["platform", "fetched"]).groupBy("platform", "fetched", "trend").agg(F.sum("likes").alias("engagement"))
    return D.top_per_group(by, ["platform"], [F.desc("engagement"), "trend"], 8)


def searched_parts(spark: S, d: str) -> DataFrame:
    t = table(spark, d, "part")
    return t.where(M.matches(" RIN ", F.col("p_type"), F.col("p_name"), F.col("p_brand"))).select("p_partkey", "p_type")


def ingest_filter(spark: S, d: str) -> DataFrame:
    return _described(spark, d).where(M.kept_on_ingest(F.col("platform"), F.col("region"), F.col("likes"))).select("event_id")


def narratives(spark: S, d: str) -> DataFrame:
    """Trends with some interactions on a platform and a text, most active first; ties by name."""
    p = posts(spark, d)
    by = p.groupBy("trend").agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("latest"), F.count_if((F.col("platform") == "x") & (F.col("likes") > 0)).alias("on_x"))
    kept = by.where((F.col("on_x") > 0) & M.matches("i", F.col("trend")))
    halves = T.growth(p).select("trend", N.js_round(F.col("second_half") - F.col("first_half"), 4).alias("growth"))
    return O.narrative_orders(kept.join(halves, "trend").select("trend", "n", "latest", "growth"))


def related_topics(spark: S, d: str) -> DataFrame:
    found = T.growth(posts(spark, d)).select(F.col("trend").alias("topic"), N.js_round(F.col("second_half") - F.col("first_half"), 4).alias("growth"))
    return O.related(found, 2)


def country_codes(spark: S, d: str) -> DataFrame:
    """Customers name their country by its name in small letters, by two letters, or by one that nobody knows."""
    nation = table(spark, d, "nation")
    letter = lambda x: F.chr(F.lit(65) + x)
    code = F.concat(letter(F.floor(F.col("n_nationkey") / 26)), letter(F.col("n_nationkey") % 26))
    asked = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))))).when(F.col("c_custkey") % 3 == 1, F.lower(F.substring("c_mktsegment", 1, 2))).otherwise(F.col("c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", asked.alias("country"))
    return O.country_codes(rows, "country", nation.select(F.col("n_name").alias("name"), code.alias("code")))


def interest_regions(spark: S, d: str) -> DataFrame:
    landed = _described(spark, d).groupBy("trend", "region", F.to_date("published_at").alias("day")).agg(F.sum("likes").cast("double").alias("value"))
    return O.interest_regions(landed, "trend")


def demographics(spark: S, d: str) -> DataFrame:
    p = _described(spark, d)
    days = p.select("trend", F.to_date("published_at").alias("day")).distinct()
    return O.demographics(p, days, p.where("region <> 'Other'").select("trend", "region"), "trend")


def mention_targets(spark: S, d: str) -> DataFrame:
    """Every post mentions somebody by a handle, every other one by an id as well."""
    mention = F.struct(F.when(F.col("k") % 2 == 0, (F.col("k") % 300).cast("string")).alias("id"), F.concat(F.lit("@U"), (F.col("k") % 200).cast("string")).alias("username"))
    p = posts(spark, d).withColumns({"event_id": F.col("event_id").cast("string"), "mentions": F.array(mention)})
    nodes = p.where("author_id is not null").select(X.node_id(F.col("platform"), F.col("author_id")).alias("id")).distinct()
    handles = posts(spark, d).groupBy("platform", "author_id").agg(F.min("event_id").alias("ord")).withColumn("handle", F.concat(F.lit("u"), "author_id"))
    return G.mention_targets(p, nodes, handles).select("src", "dst", "event_id")


def resolved_labels(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    paths = (F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")), F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.col("c_name"))), F.col("c_mktsegment"))
    return c.select("c_custkey", M.first_label(*paths).alias("label"))


def tolerant_counts(spark: S, d: str) -> DataFrame:
    p = posts(spark, d)
    e = {k: F.col(k) for k in ("likes", "replies", "reposts", "quotes")}
    m = {"comments": F.when(F.col("k") % 2 == 0, F.col("k") % 13), "shares": F.when(F.col("k") % 4 == 0, F.col("k") % 3)}
    given, reactions = F.when(F.col("k") % 11 == 0, F.col("k")), F.when(F.col("k") % 6 == 2, F.col("k") % 9)
    return p.select("event_id", M.tolerant_interactions(F.col("platform"), given, e, m, reactions).alias("interactions"))


def _events(spark: S, d: str) -> DataFrame:
    """Posts as canonical events, some of them with faults."""
    k, i = F.col("k"), F.col("event_id").cast("string")
    p = posts(spark, d)
    none = F.lit(None).cast("string")
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    event_id = F.when(k % 17 == 0, F.concat(F.lit("x:a"), i)).when(k % 19 == 0, F.lit(" ")).otherwise(F.concat(F.col("platform"), F.when(F.col("platform") == "telegram", F.lit(":channel:7:")).otherwise(F.lit(":")), i))
    metrics = {m: F.lit(None).cast("long") for m in V.METRICS} | {"likes": F.when(k % 23 == 0, F.lit(-1)).otherwise(F.col("likes")).cast("long")}
    return p.select(
        F.col("event_id").alias("n"), F.lit("c1").alias("collection_id"), event_id.alias("eventId"), F.when(k % 29 == 0, F.lit("myspace")).otherwise(F.col("platform")).alias("platform"),
        F.when(F.col("platform") == "reddit", F.concat(F.when(k % 13 == 0, F.lit("q3_")).otherwise(F.lit("t3_")), i)).otherwise(i).alias("platformPostId"),
        F.struct(F.concat(F.lit("t2_"), "author_id").alias("authorId")).alias("author"), F.struct(none.alias("replyToId")).alias("relationships"),
        F.struct(F.concat(stamp, F.when(k % 31 == 0, F.lit("")).otherwise(F.lit("Z"))).alias("publishedAt"), F.when(k % 37 == 0, F.lit("1970-01-01T00:00:00Z")).otherwise(F.concat(stamp, F.lit("Z"))).alias("observedAt"), none.alias("editedAt")).alias("time"),
        F.struct(*[v.alias(m) for m, v in metrics.items()]).alias("engagement"),
    )


def event_rule_errors(spark: S, d: str) -> DataFrame:
    found = V.validated_events(_events(spark, d))
    return found.select("n", F.array_join("errors", "; ").alias("errors")).where("errors <> ''")


def batch_leaves(spark: S, d: str) -> DataFrame:
    """Every event's leaf, in batches of at most 100 of its trend's stream."""
    leaves = posts(spark, d).select(F.col("trend").alias("stream"), F.to_date("published_at").alias("day"), "published_at", "event_id", I.leaf(F.col("event_id").cast("string"), F.col("platform")).alias("leaf"))
    return I.batches(leaves, ["published_at", "event_id"]).select("event_id", "batch", "leaf_index", "leaf")


def batch_roots(spark: S, d: str) -> DataFrame:
    """SHA-256 Merkle root of each batch, with all its proofs checked."""
    trees = I.verified(I.merkle_trees(batch_leaves(spark, d), "batch", ["leaf_index"], I.sha256), I.sha256)
    return trees.groupBy("batch", "root").agg(F.count(F.lit(1)).alias("leaves"), F.bool_and("ok").alias("all_ok"))


def snapshot_hashes(spark: S, d: str) -> DataFrame:
    """Canonical hash of each snapshot's nine payload fields."""
    s = snapshots(spark, d)
    given = {"snapshot_id": F.concat_ws("@", "trend", F.date_format("captured_at", "yyyy-MM-dd")), "trend_label": F.col("trend"), "captured_at": F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"), "virality_score": F.col("rank"), "virality_tier": F.col("tier"), "config_hash": F.lit("0xab")}
    rows = I.payload(s, **given)
    return rows.select("snapshot_id", I.canonical_hash({k: F.col(k) for k in I.PAYLOAD}).alias("hash"))


FIELDS = ["engagement", "platforms", "rank", "score", "tier"]


def _anchored(spark: S, d: str) -> DataFrame:
    """Daily snapshots with an id, as they were anchored."""
    return snapshots(spark, d).select(F.concat_ws("@", "trend", F.date_format("captured_at", "yyyy-MM-dd")).alias("id"), "captured_at", *FIELDS)


def _present(rows: DataFrame) -> DataFrame:
    """As they are now: on Mondays the tier has been overwritten, on Wednesdays those of rank 2 are gone."""
    day = F.dayofweek("captured_at")
    return rows.withColumn("tier", F.when(day == 2, "dormant").otherwise(F.col("tier"))).where(~((day == 4) & (F.col("rank") == 2)))


def merkle_levels(spark: S, d: str) -> DataFrame:
    """The root of each trend's whole stream of events, of any length, with proofs of its first and last leaf checked."""
    rows = posts(spark, d).select(F.col("trend").alias("tree"), "published_at", "event_id", I.leaf(F.col("event_id").cast("string"), F.col("platform")).alias("leaf"))
    leaves = L.placed(rows, "tree", ["published_at", "event_id"])
    table = L.levels(leaves, "tree")
    ends = leaves.groupBy("tree").agg(F.min("place").alias("a"), F.max("place").alias("z")).select("tree", F.explode(F.array_distinct(F.array("a", "z"))).alias("place"))
    checked = L.proofs(table, ends).join(leaves.select("tree", "place", "leaf"), ["tree", "place"]).join(L.roots(table), "tree")
    return checked.groupBy("tree", "root", "leaves").agg(F.bool_and(L.leads_to(F.col("leaf"), F.col("proof"), F.col("root"))).alias("ok"))


def verification_ladder(spark: S, d: str) -> DataFrame:
    """Present snapshots against their anchors: the first of a day by proofs of its fields, the second by the root of its
    fields, the third by a hash of the whole, others without an anchor. All verdicts come from hashes."""
    then, now = _anchored(spark, d), _present(_anchored(spark, d))
    leaves = lambda rows: L.field_places(I.field_leaves(rows, "id", FIELDS), "id")
    table, current = L.levels(leaves(then), "tree"), L.levels(leaves(now), "tree")
    anchor = L.roots(table).select("tree", F.col("root").alias("anchored"))
    whole = lambda rows, name: rows.select(F.col("id").alias("tree"), "rank", I.canonical_hash({c: F.col(c) for c in FIELDS}).alias(name))
    asked = current.where("level = 0").select("tree", "place", F.col("node").alias("leaf"))
    proved = L.proofs(table, asked.select("tree", "place")).join(asked, ["tree", "place"]).join(anchor, "tree")
    proved = proved.groupBy("tree").agg(F.bool_and(L.leads_to(F.col("leaf"), F.col("proof"), F.col("anchored"))).alias("proof_ok"))
    wrong = L.differing(table, current).groupBy("tree").agg(F.count(F.lit(1)).alias("wrong"))
    rows = whole(now, "hash").join(whole(then, "legacy").drop("rank"), "tree").join(L.roots(current).select("tree", "root"), "tree").join(anchor, "tree").join(proved, "tree").join(wrong, "tree", "left")
    rank = F.col("rank")
    found = I.ladder(F.when(rank == 1, F.col("proof_ok")), (rank == 2) & (F.col("root") == F.col("anchored")), (rank == 3) & (F.col("hash") == F.col("legacy")), F.coalesce("wrong", F.lit(0)))
    return rows.select(F.col("tree").alias("id"), found["status"].alias("status"), found["method"].alias("method"), F.coalesce("wrong", F.lit(0)).alias("tampered"))


def latest_audit(spark: S, d: str) -> DataFrame:
    """The forty newest snapshots, hashed anew and held against what was anchored of them."""
    then = _anchored(spark, d)
    leaves = lambda rows: L.field_places(I.field_leaves(rows, "id", FIELDS), "id")
    anchors = then.select(F.col("id").alias("tree"), F.col("captured_at").alias("anchored_at"))
    return L.audit(anchors, L.levels(leaves(then), "tree"), leaves(_present(then)), 40)


def reaction_totals(spark: S, d: str) -> DataFrame:
    k = F.col("k")
    one = lambda m: F.struct(F.when(k % m > 0, k % 10).alias("count"))
    return posts(spark, d).select("event_id", D.reaction_total(F.when(k % 4 > 0, F.array(one(2), one(3)))).alias("reactions"))


def degree_ranks(spark: S, d: str) -> DataFrame:
    return G.degree_rank(G.aggregate_edges(links(spark, d)).where("dst < src"))


def benchmark_by_platform(spark: S, d: str) -> DataFrame:
    return D.benchmark(_described(spark, d).withColumn("predicted", pick(SENTIMENTS, F.col("k"))), "sentiment", "predicted", "interactions", "platform")


def top_languages(spark: S, d: str) -> DataFrame:
    by = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return D.argmax_label(by, "lang", "n", "source")


def polarity_scores(spark: S, d: str) -> DataFrame:
    k = F.col("k")
    return posts(spark, d).select("event_id", N.polarity(k % 50, F.lit(20), 80 - k % 50).alias("polarity"), N.emotion_polarity((k % 9).cast("double")).alias("emotion"))


def short_numbers(spark: S, d: str) -> DataFrame:
    x = F.pow(F.lit(10.0), F.col("c_custkey") % 7) * (F.col("c_custkey") % 97)
    date = F.when(F.col("c_custkey") % 4 == 0, F.lit("2024-02-30")).when(F.col("c_custkey") % 4 == 1, F.lit("2024-2-3")).otherwise(F.lit("2024-02-29"))
    return table(spark, d, "customer").select("c_custkey", N.humanize_fixed(x).alias("text"), N.shortest((F.col("c_custkey") / 2)).alias("number"), N.valid_date(date).alias("valid"))


def edge_platforms(spark: S, d: str) -> DataFrame:
    k, e = F.col("k"), F.col("platform")
    src = F.when(k % 3 == 0, F.concat(e, F.lit(":"), F.col("author_id"))).otherwise(F.col("author_id"))
    dst = F.when(k % 5 == 0, F.concat(F.lit("telegram:"), F.col("author_id"))).otherwise(F.lit("other:1"))
    return posts(spark, d).select("event_id", G.edge_platform(F.when(k % 7 == 0, F.concat(F.lit(" "), F.upper(e))), src, dst, F.when(k % 2 == 0, F.lit("x"))).alias("platform"))


def platform_block_errors(spark: S, d: str) -> DataFrame:
    k = F.col("k")
    block = lambda n: F.struct(pick(("success", "error", "rate_limited", "unavailable"), k + n).alias("status"), F.when((k + n) % 3 == 0, F.lit("E1")).alias("code"))
    e = posts(spark, d).select("event_id", F.create_map(F.lit("x"), block(0), F.lit("reddit"), block(1)).alias("platforms"))
    return V.platform_errors(e).select("event_id", F.array_join("platform_errors", ",").alias("errors"))


def attachments(spark: S, d: str) -> DataFrame:
    k = F.col("k")
    item = lambda m: F.struct(F.when(k % m == 0, "photo").otherwise("video").alias("type"), F.when(k % 4 > 0, F.concat(F.lit("u"), (k % m).cast("string"))).alias("url"))
    kept = M.distinct_attachments(F.array(item(2), item(3), item(2)))
    return posts(spark, d).select("event_id", F.size(kept).alias("n"), F.array_join(F.transform(kept, lambda x: F.concat_ws("=", x["type"], F.coalesce(x["url"], F.lit("-")))), ",").alias("kept"))


def resolved_links(spark: S, d: str) -> DataFrame:
    k = (F.col("k") % 5).cast("string")
    entity = lambda r, t: F.struct(r.alias("raw"), t.alias("resolved"))
    entities = F.array(entity(F.concat(F.lit("t/"), k), F.concat(F.lit("https://a/"), k)), entity(F.lit("t/0"), F.lit("https://zero")))
    return posts(spark, d).select("event_id", F.array_join(M.resolved_urls(F.array(F.concat(F.lit("t/"), k), F.lit("t/0"), F.lit("t/9")), entities), " ").alias("urls"))


def part_classes(spark: S, d: str) -> DataFrame:
    words = spark.createDataFrame([("tools", "bolt"), ("tools", "gear"), ("tools", "ring"), ("looks", "red"), ("looks", "blue"), ("looks", "hot"), ("size", "small")], "class string, keyword string")
    return M.keyword_class(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", words, "p_partkey")


def matched_states(spark: S, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("TAMIL-NADU", "West Bengal, India", "guj", "Oslo", "kerala ")))
    states = ["Tamil Nadu", "West Bengal", "Gujarat", "Kerala"]
    return posts(spark, d).select("event_id", M.matched_name(F.element_at(names, (F.col("k") % 5 + 1).cast("int")), states).alias("state"))


def price_rule_errors(spark: S, d: str) -> DataFrame:
    k = F.col("k")
    r = posts(spark, d).select(
        F.when(k % 11 > 0, F.col("event_id").cast("string")).alias("rule_id"), F.when(k % 13 > 0, F.col("trend")).otherwise(F.lit(" ")).alias("instrument"), pick(("level", "ma_cross", "other"), k).alias("type"),
        pick(("above", "below", "up"), F.col("user_id")).alias("direction"), F.when(k % 2 == 0, 1.0).alias("level"), (k % 4).alias("short"), F.lit(3).alias("long"), "event_id",
    )
    return P.rule_errors(r).select("event_id", F.array_join("errors", "; ").alias("errors"))


_GRAIN = "make_timestamp(CAST(floor(epoch_us(published_at) / (h * 3.6e9)) * (h * 3600000000) AS BIGINT))"
_DAYS = f"""{LINKS}, dl AS (SELECT *, strftime(published_at, '%Y-%m-%d') AS day FROM links), dp AS (SELECT *, strftime(published_at, '%Y-%m-%d') AS day FROM posts),
  de AS (SELECT day, src, dst, CAST(sum(CASE kind WHEN 'reply' THEN 2 WHEN 'quote' THEN 3 WHEN 'repost' THEN 3 ELSE 1 END) AS BIGINT) AS weight, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in G.EDGE_WEIGHTS)} FROM dl GROUP BY 1, 2, 3)"""

QUERIES = {
    "trend_analysis": (trend_analysis, f"""WITH a AS ({Q.QUERIES["trend_virality"][1]}), g AS ({Q.QUERIES["trend_growth"][1]}), p AS ({Q.QUERIES["trend_peak"][1]}), f AS ({Q.QUERIES["fastest_platform"][1]}), r AS ({Q.QUERIES["approximate_reach"][1]}), l AS ({Q.QUERIES["lifecycle"][1]}), {POSTS},
      l1 AS (SELECT trend, count(*) AS life_buckets, max(posts) AS life_most FROM l WHERE span = '30d' GROUP BY 1), c AS (SELECT trend, count(DISTINCT platform) AS platforms, {jr("sum(interactions)", 4)} AS interactions FROM posts GROUP BY 1)
      SELECT a.*, growth, peak_date, peak_growth, fastest_platform, approximate_reach, life_buckets, life_most, platforms, interactions FROM a LEFT JOIN g USING (trend) LEFT JOIN p USING (trend) LEFT JOIN f USING (trend) LEFT JOIN r USING (trend) LEFT JOIN l1 USING (trend) LEFT JOIN c USING (trend)"""),
    "network_analysis": (network_analysis, f"""WITH {_DAYS}, x AS (SELECT day, 'x:' || user_id AS id, true AS o FROM dp WHERE user_id IS NOT NULL UNION ALL SELECT day, src, false FROM de UNION ALL SELECT day, dst, false FROM de), n AS (SELECT day, id, bool_or(o) AS o FROM x GROUP BY 1, 2),
      n1 AS (SELECT day, count(*) AS nodes, count(*) FILTER (WHERE o) AS observed FROM n GROUP BY 1), e1 AS (SELECT day, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS total_weight, {", ".join(f"CAST(sum(n_{k}) AS BIGINT) AS n_{k}" for k in G.EDGE_WEIGHTS)} FROM de GROUP BY 1),
      d0 AS (SELECT day, (epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY day ORDER BY published_at, event_id))) / 1000 AS v FROM dp), d1 AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY v) AS r, count(*) OVER (PARTITION BY day) AS c FROM d0 WHERE v IS NOT NULL),
      d2 AS (SELECT day, count(*) AS delays, {jr("max(CASE WHEN r = c // 2 + 1 THEN v END)", 3)} AS median_ms, {jr("avg(v)", 2)} AS mean_ms, {jr("stddev_pop(v)", 2)} AS deviation_ms FROM d1 GROUP BY 1),
      h0 AS (SELECT day, trend, count(*) AS c FROM dp GROUP BY 1, 2), h AS (SELECT day, {jr("max(c) / sum(c)", 3)} AS overlap FROM h0 GROUP BY 1)
      SELECT n1.day, nodes, observed, nodes - observed AS external, coalesce(edges, 0) AS edges, coalesce(total_weight, 0) AS total_weight, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in G.EDGE_WEIGHTS)}, CASE WHEN nodes > 1 THEN {jr("coalesce(edges, 0) / (nodes * (nodes - 1.0))", 6)} ELSE 0.0 END AS density,
      delays, median_ms, mean_ms, deviation_ms, overlap FROM n1 LEFT JOIN e1 USING (day) LEFT JOIN d2 USING (day) LEFT JOIN h USING (day)"""),
    "network_flags": (network_flags, None),
    "rollup_dimensions": (rollup_dimensions, f"""WITH {DESCRIBED}, g(granularity, h) AS (VALUES ('6h', 6), ('1d', 24), ('7d', 168), ('30d', 720)), u AS (SELECT trend, published_at, interactions, 'sentiment' AS dimension, sentiment AS value FROM described UNION ALL SELECT trend, published_at, interactions, 'language', language FROM described
      UNION ALL SELECT trend, published_at, interactions, 'region', region FROM described UNION ALL SELECT trend, published_at, interactions, 'platform', platform FROM described),
      r AS (SELECT trend, granularity, {_GRAIN} AS bucket_start, dimension, value, count(*) AS mentions, {jr("avg(interactions)", 8)} AS average, max(interactions) AS peak FROM u, g GROUP BY 1, 2, 3, 4, 5)
      SELECT *, {jr("100.0 * mentions / sum(mentions) OVER (PARTITION BY trend, granularity, bucket_start, dimension)", 2)} AS share FROM r"""),
    "edge_keys": (edge_keys, f"""WITH {POSTS}, a AS (SELECT DISTINCT platform, author_id, user_id + 1000 AS author_key FROM posts WHERE k % 5 > 0), ed AS (SELECT DISTINCT platform, author_id AS src, CAST(k % 100 AS VARCHAR) AS dst FROM posts)
      SELECT ed.*, s.author_key AS src_key, t.author_key AS dst_key FROM ed LEFT JOIN a s ON s.platform = ed.platform AND s.author_id = src LEFT JOIN a t ON t.platform = ed.platform AND t.author_id = dst"""),
    "post_trends": (post_trends, f"WITH {POSTS} SELECT DISTINCT event_id, regexp_replace(lower(trim(trend)), '\\s+', '-', 'g') AS trend_key FROM posts WHERE trend_key < 'e'"),
    "leaderboard_details": (leaderboard_details, f"WITH l AS ({Q.QUERIES['leaderboard'][1]}), {POSTS}, t AS (SELECT trend, min(published_at) AS first_seen, count(*) AS posts FROM posts GROUP BY 1) SELECT position, l.trend, first_seen, t.posts FROM l LEFT JOIN t USING (trend)"),
    "latest_batches": (latest_batches, f"""WITH {POSTS}, r AS (SELECT *, date_trunc('hour', published_at) AS fetched FROM posts), m AS (SELECT platform, max(fetched) AS fetched FROM r GROUP BY 1), b AS (SELECT platform, fetched, trend, CAST(sum(likes) AS BIGINT) AS engagement FROM r JOIN m USING (platform, fetched) GROUP BY 1, 2, 3)
      SELECT *, row_number() OVER (PARTITION BY platform ORDER BY engagement DESC, trend) AS place FROM b QUALIFY place <= 8"""),
    "searched_parts": (searched_parts, "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'rin') OR contains(lower(p_name), 'rin') OR contains(lower(p_brand), 'rin')"),
    "ingest_filter": (ingest_filter, f"WITH {DESCRIBED} SELECT event_id FROM described WHERE coalesce(likes, 0) >= 10 AND (platform <> 'x' OR region <> 'Other')"),
    "narratives": (narratives, f"""WITH {POSTS}, b AS (SELECT trend, count(*) AS n, max(published_at) AS latest, count(*) FILTER (WHERE platform = 'x' AND likes > 0) AS on_x FROM posts GROUP BY 1), {HALVES}
      SELECT trend, n, latest, growth, row_number() OVER (ORDER BY n DESC, trend) AS by_most, row_number() OVER (ORDER BY n, trend) AS by_least, row_number() OVER (ORDER BY growth DESC, trend) AS by_growth, row_number() OVER (ORDER BY latest DESC, trend) AS by_recent FROM b JOIN halves USING (trend) WHERE on_x > 0 AND contains(lower(trend), 'i')"""),
    "related_topics": (related_topics, f"""WITH {POSTS}, {HALVES} SELECT a.trend AS topic, CAST(row_number() OVER (PARTITION BY a.trend ORDER BY b.growth DESC, b.trend) AS INTEGER) AS place, b.trend AS related, b.growth FROM halves a, halves b WHERE a.trend <> b.trend QUALIFY place <= 2"""),
    "country_codes": (country_codes, """WITH n AS (SELECT lower(n_name) AS name, chr(CAST(65 + n_nationkey // 26 AS INTEGER)) || chr(CAST(65 + n_nationkey % 26 AS INTEGER)) AS code FROM nation),
      a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' nation_' || c_nationkey WHEN 1 THEN lower(c_mktsegment[1:2]) ELSE c_mktsegment END AS country FROM customer)
      SELECT c_custkey, country, CASE WHEN length(trim(country)) = 2 THEN upper(country) ELSE code END AS code, CASE WHEN length(trim(country)) <> 2 AND code IS NULL THEN 'unknown country ' || trim(country) END AS problem FROM a LEFT JOIN n ON n.name = lower(trim(country))"""),
    "interest_regions": (interest_regions, f"""WITH {DESCRIBED}, l AS (SELECT trend, region, CAST(published_at AS DATE) AS day, CAST(sum(likes) AS DOUBLE) AS value FROM described GROUP BY 1, 2, 3), m AS (SELECT trend, region, max(value) AS value FROM l GROUP BY 1, 2)
      SELECT trend, row_number() OVER (PARTITION BY trend ORDER BY value DESC, region) AS place, region, value FROM m"""),
    "demographics": (demographics, f"""WITH {DESCRIBED} SELECT trend, count(*) AS event_count, count(DISTINCT (platform, author_id)) FILTER (WHERE author_id IS NOT NULL) AS profiles_available, count(DISTINCT CAST(published_at AS DATE)) AS timeline_points, count(DISTINCT region) FILTER (WHERE region <> 'Other') AS regions,
      CAST(NULL AS VARCHAR) AS top_age, CAST(NULL AS VARCHAR) AS top_region, CAST(NULL AS VARCHAR) AS age_distribution, CAST(NULL AS VARCHAR) AS gender_distribution, CAST(NULL AS VARCHAR) AS professional_interests FROM described GROUP BY 1"""),
    "mention_targets": (mention_targets, f"""WITH {POSTS}, n AS (SELECT DISTINCT platform, author_id FROM posts WHERE author_id IS NOT NULL), m AS (SELECT event_id, platform, author_id, CASE WHEN k % 2 = 0 THEN CAST(k % 300 AS VARCHAR) END AS id, CAST(k % 200 AS VARCHAR) AS handle FROM posts WHERE author_id IS NOT NULL),
      r AS (SELECT m.platform || ':' || m.author_id AS src, CASE WHEN a.author_id IS NOT NULL THEN m.platform || ':' || m.id WHEN b.author_id IS NOT NULL THEN m.platform || ':' || m.handle ELSE 'external:' || m.platform || ':' || coalesce(m.id, 'u' || m.handle) END AS dst, CAST(event_id AS VARCHAR) AS event_id
        FROM m LEFT JOIN n a ON a.platform = m.platform AND a.author_id = m.id LEFT JOIN n b ON b.platform = m.platform AND b.author_id = m.handle)
      SELECT * FROM r WHERE src <> dst"""),
    "resolved_labels": (resolved_labels, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN trim(c_name) ELSE trim(c_mktsegment) END AS label FROM customer"),
    "tolerant_counts": (tolerant_counts, f"""WITH {POSTS}, m AS (SELECT *, CASE WHEN k % 2 = 0 THEN k % 13 END AS comments, CASE WHEN k % 4 = 0 THEN k % 3 END AS shares, CASE WHEN k % 6 = 2 THEN k % 9 END AS reactions FROM posts)
      SELECT event_id, CASE WHEN k % 11 = 0 THEN k WHEN platform = 'reddit' THEN replies + coalesce(comments, 0) WHEN platform = 'telegram' THEN coalesce(reactions, 0) + replies + coalesce(comments, 0) ELSE likes + replies + reposts + coalesce(quotes, 0) + coalesce(comments, 0) + coalesce(shares, 0) END AS interactions FROM m"""),
    "event_rule_errors": (event_rule_errors, f"""WITH {POSTS}, v AS (SELECT event_id AS n, k, CASE WHEN k % 29 = 0 THEN 'myspace' ELSE platform END AS p, platform, CASE WHEN k % 17 = 0 THEN 'x:a' || event_id WHEN k % 19 = 0 THEN ' ' WHEN platform = 'telegram' THEN 'telegram:channel:7:' || event_id ELSE platform || ':' || event_id END AS i,
        CASE WHEN platform <> 'reddit' THEN CAST(event_id AS VARCHAR) WHEN k % 13 = 0 THEN 'q3_' || event_id ELSE 't3_' || event_id END AS post FROM posts),
      c AS (SELECT *, count(*) OVER (PARTITION BY i) AS same FROM v),
      x AS (SELECT n, array_to_string(list_filter([CASE WHEN trim(i) = '' THEN 'eventId is required' END, CASE WHEN p = 'myspace' THEN 'unsupported platform' END, CASE WHEN p = 'x' AND NOT regexp_matches(i, '^x:\\d+$') THEN 'x event ids are x:<id>' END,
        CASE WHEN p = 'reddit' AND NOT regexp_matches(post, '^t[13]_') THEN 'reddit posts are t3_ or t1_' END, CASE WHEN p = 'telegram' AND len(string_split(i, ':')) <> 4 THEN 'telegram event ids are telegram:<kind>:<peer>:<message>' END,
        CASE WHEN k % 31 = 0 THEN 'time.publishedAt needs a timezone' END, CASE WHEN k % 37 = 0 THEN 'time.observedAt is an epoch fallback' END, CASE WHEN k % 23 = 0 THEN 'engagement.likes must be an integer or null' END, CASE WHEN same > 1 THEN 'duplicate eventId in collection' END], lambda v: v IS NOT NULL), '; ') AS errors FROM c)
      SELECT * FROM x WHERE errors <> ''"""),
    "batch_leaves": (batch_leaves, f"WITH {POSTS}, p AS (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY published_at, event_id) - 1 AS r FROM posts) SELECT event_id, trend || '#' || (r // 100) AS batch, CAST(r % 100 AS INTEGER) AS leaf_index, '0x' || sha256(event_id || ':' || platform) AS leaf FROM p"),
    "batch_roots": (batch_roots, f"""WITH RECURSIVE {POSTS}, p AS (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY published_at, event_id) - 1 AS r FROM posts),
      t AS (SELECT 0 AS lvl, trend || '#' || (r // 100) AS batch, r % 100 AS i, sha256(event_id || ':' || platform) AS h, count(*) OVER (PARTITION BY trend, r // 100) AS m FROM p UNION ALL
        SELECT any_value(lvl) + 1, batch, i // 2, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(unhex(min(h) || max(h))) END, (any_value(m) + 1) // 2 FROM t WHERE m > 1 GROUP BY batch, i // 2)
      SELECT batch, '0x' || h AS root, (SELECT count(*) FROM p WHERE p.trend || '#' || (p.r // 100) = t.batch) AS leaves, true AS all_ok FROM t WHERE m = 1"""),
    "snapshot_hashes": (snapshot_hashes, f"""WITH {SNAPSHOTS}, i AS (SELECT trend || '@' || strftime(captured_at, '%Y-%m-%d') AS snapshot_id, * FROM snapshots) SELECT snapshot_id, '0x' || sha256('{{"captured_at":"' || strftime(captured_at, '%Y-%m-%dT%H:%M:%S') || '.000Z","centrality_score":null,"config_hash":"0xab","sentiment_result":null,"sentiment_score":null,"snapshot_id":"' || snapshot_id
      || '","trend_label":"' || trend || '","virality_score":' || rank || ',"virality_tier":"' || tier || '"}}') AS hash FROM i"""),
    "verification_ladder": (verification_ladder, f"""WITH {SNAPSHOTS}, c AS (SELECT *, trend || '@' || strftime(captured_at, '%Y-%m-%d') AS id, dayofweek(captured_at) = 1 AND tier <> 'dormant' AS changed FROM snapshots WHERE NOT (dayofweek(captured_at) = 3 AND rank = 2))
      SELECT id, CASE WHEN changed OR rank > 3 THEN 'TAMPER_DETECTED' ELSE 'INTACT' END AS status, CASE WHEN rank = 1 THEN 'field_merkle_tree' WHEN rank = 2 AND NOT changed THEN 'direct' WHEN rank = 3 AND NOT changed THEN 'direct_legacy' ELSE 'unknown' END AS method,
      CAST(changed AS BIGINT) AS tampered FROM c"""),
    "latest_audit": (latest_audit, f"""WITH {SNAPSHOTS}, c AS (SELECT trend || '@' || strftime(captured_at, '%Y-%m-%d') AS tree, captured_at AS anchored_at, dayofweek(captured_at) = 1 AND tier <> 'dormant' AS changed, dayofweek(captured_at) = 3 AND rank = 2 AS gone FROM snapshots)
      SELECT tree, anchored_at, CASE WHEN gone THEN 'MISSING' WHEN changed THEN 'TAMPER_DETECTED' ELSE 'INTACT' END AS verdict, CASE WHEN NOT gone THEN CAST(changed AS BIGINT) END AS tampered FROM c ORDER BY anchored_at DESC, tree LIMIT 40"""),
    "merkle_levels": (merkle_levels, f"""WITH RECURSIVE {POSTS}, p AS (SELECT trend, row_number() OVER (PARTITION BY trend ORDER BY published_at, event_id) - 1 AS place, '0x' || sha256(event_id || ':' || platform) AS node FROM posts),
      t AS (SELECT 0 AS k, trend, place, node FROM p UNION ALL SELECT any_value(k) + 1, trend, place // 2, CASE count(*) WHEN 2 THEN '0x' || sha256(unhex(substr(min(node), 3) || substr(max(node), 3))) ELSE min(node) END FROM t WHERE k < 40 AND k < (SELECT ceil(log2(max(place) + 1)) FROM p) GROUP BY trend, place // 2, k),
      n AS (SELECT trend, count(*) AS leaves FROM p GROUP BY 1)
      SELECT t.trend AS tree, t.node AS root, n.leaves, true AS ok FROM t JOIN n USING (trend) WHERE t.k = (SELECT max(k) FROM t) AND t.place = 0"""),
    "reaction_totals": (reaction_totals, f"WITH {POSTS} SELECT event_id, CASE WHEN k % 4 > 0 AND (k % 2 > 0 OR k % 3 > 0) THEN CASE WHEN k % 2 > 0 THEN k % 10 ELSE 0 END + CASE WHEN k % 3 > 0 THEN k % 10 ELSE 0 END END AS reactions FROM posts"),
    "degree_ranks": (degree_ranks, f"WITH {LINKS}, ed AS (SELECT DISTINCT src, dst FROM links WHERE dst < src), x AS (SELECT src AS id, false AS t FROM ed UNION ALL SELECT dst, true FROM ed) SELECT id, count(*) AS edge_count, CASE WHEN bool_or(t) THEN count(*) ELSE 0 END AS rank FROM x GROUP BY 1"),
    "benchmark_by_platform": (benchmark_by_platform, f"""WITH {DESCRIBED}, r AS (SELECT platform, sentiment = {sql_pick(SENTIMENTS, 'k')} AS ok, interactions AS x, row_number() OVER (PARTITION BY platform ORDER BY interactions) - 1 AS r, count(*) OVER (PARTITION BY platform) AS n FROM described)
      SELECT platform, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, {jr("count(*) FILTER (WHERE ok) / count(*)", 4)} AS accuracy, {jr("avg(x)", 4)} AS mean, max(CASE WHEN r = least(floor(n * 0.5), n - 1) THEN x END) AS p50, max(CASE WHEN r = least(floor(n * 0.95), n - 1) THEN x END) AS p95 FROM r GROUP BY 1"""),
    "top_languages": (top_languages, "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, arg_min(lang, (-n, lang)) AS lang, max(n) AS n FROM n GROUP BY 1"),
    "polarity_scores": (polarity_scores, f"WITH {POSTS} SELECT event_id, (5 * (k % 50) + 60 + (80 - k % 50)) / 100 AS polarity, greatest(1.0, least(5.0, CAST(k % 9 AS DOUBLE))) AS emotion FROM posts"),
    "short_numbers": (short_numbers, """WITH v AS (SELECT c_custkey, pow(10.0, c_custkey % 7) * (c_custkey % 97) AS x FROM customer) SELECT c_custkey, CASE WHEN x >= 1e6 THEN printf('%.1fM', floor(x / 1e6 * 10 + 0.5) / 10) WHEN x >= 1e4 THEN CAST(floor(x / 1e3 + 0.5) AS BIGINT) || 'K' WHEN x >= 1e3 THEN printf('%.1fK', floor(x / 1e3 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(x + 0.5) AS BIGINT) AS VARCHAR) END AS text,
      regexp_replace(CAST(c_custkey / 2 AS VARCHAR), '\\.0$', '') AS number, c_custkey % 4 > 1 AS valid FROM v"""),
    "edge_platforms": (edge_platforms, f"""WITH {POSTS} SELECT event_id, CASE WHEN k % 7 = 0 THEN platform WHEN k % 3 = 0 THEN platform WHEN k % 5 = 0 THEN 'telegram' WHEN k % 2 = 0 THEN 'x' END AS platform FROM posts"""),
    "platform_block_errors": (platform_block_errors, f"""WITH {POSTS} SELECT event_id, array_to_string(list_filter([CASE WHEN (k + 1) % 4 IN (1, 2) THEN 'reddit:' || CASE WHEN (k + 1) % 3 = 0 THEN 'E1' ELSE 'PLATFORM_ERROR' END END,
      CASE WHEN k % 4 IN (1, 2) THEN 'x:' || CASE WHEN k % 3 = 0 THEN 'E1' ELSE 'PLATFORM_ERROR' END END], lambda v: v IS NOT NULL), ',') AS errors FROM posts"""),
    "attachments": (attachments, f"""WITH {POSTS}, a AS (SELECT event_id, CASE WHEN k % 2 = 0 THEN 'photo' ELSE 'video' END AS t2, CASE WHEN k % 3 = 0 THEN 'photo' ELSE 'video' END AS t3, CASE WHEN k % 4 > 0 THEN 'u' || k % 2 END AS u2, CASE WHEN k % 4 > 0 THEN 'u' || k % 3 END AS u3 FROM posts),
      l AS (SELECT event_id, list_filter([t2 || '=' || coalesce(u2, '-'), CASE WHEN u3 IS NULL OR t3 <> t2 OR u3 <> u2 THEN t3 || '=' || coalesce(u3, '-') END, CASE WHEN u2 IS NULL THEN t2 || '=-' END], lambda v: v IS NOT NULL) AS l FROM a) SELECT event_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, ',') AS kept FROM l"""),
    "resolved_links": (resolved_links, f"WITH {POSTS} SELECT event_id, 'https://a/' || k % 5 || ' ' || CASE WHEN k % 5 = 0 THEN 'https://a/0' ELSE 'https://zero' END || ' t/9' AS urls FROM posts"),
    "part_classes": (part_classes, """WITH w(class, keyword) AS (VALUES ('tools', 'bolt'), ('tools', 'gear'), ('tools', 'ring'), ('looks', 'red'), ('looks', 'blue'), ('looks', 'hot'), ('size', 'small')), t AS (SELECT DISTINCT p_partkey, unnest(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+')) AS keyword FROM part),
      h AS (SELECT p_partkey, class, count(*) AS hits FROM t JOIN w USING (keyword) GROUP BY 1, 2), b AS (SELECT p_partkey, arg_min(class, (-hits, class)) AS class, max(hits) AS hits FROM h GROUP BY 1) SELECT p_partkey, class, coalesce(hits, 0) AS hits FROM part LEFT JOIN b USING (p_partkey)"""),
    "matched_states": (matched_states, f"WITH {POSTS} SELECT event_id, (['Tamil Nadu', 'West Bengal', 'Gujarat', NULL, 'Kerala'])[k % 5 + 1] AS state FROM posts"),
    "price_rule_errors": (price_rule_errors, f"""WITH {POSTS} SELECT event_id, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'rule_id is required' END, CASE WHEN k % 13 = 0 THEN 'instrument is required' END, CASE WHEN k % 3 = 2 THEN 'unknown type' END, CASE WHEN user_id % 3 = 2 THEN 'unknown direction' END,
      CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN 'level is required' END, CASE WHEN k % 3 = 1 AND (k % 4 < 1 OR k % 4 >= 3) THEN 'windows need 1 <= short < long' END], lambda v: v IS NOT NULL), '; ') AS errors FROM posts"""),
}
