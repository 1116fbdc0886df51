"""Graph, sink, integrity, rule, text and validation queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import numbers as N
from pulsegrid.functions import text as X
from pulsegrid.functions import times as M
from pulsegrid.operators import distributions as D
from pulsegrid.operators import graph as G
from pulsegrid.operators import integrity as I
from pulsegrid.operators import rollups as U
from pulsegrid.operators import rules as P
from pulsegrid.operators import segmentation as Z
from pulsegrid.operators import sentiment as E
from pulsegrid.operators import sinks as K
from pulsegrid.operators.validate import messages
from pulsegrid.plans.views import LINKS, POSTS, SNAPSHOTS, jr, links, posts, snapshots
from pulsegrid.session import table
from pulsegrid.sources.collections import comment_tree

S = SparkSession

EDGES = f"""{LINKS}, edges AS (SELECT src, dst, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in G.EDGE_WEIGHTS)},
  CAST(sum(CASE kind WHEN 'reply' THEN 2 WHEN 'quote' THEN 3 WHEN 'repost' THEN 3 ELSE 1 END) AS BIGINT) AS weight, min(published_at) AS first_at, max(published_at) AS last_at, count(*) AS links, list_sort(list(DISTINCT event_id))[1:100] AS ids FROM links GROUP BY 1, 2),
  nodes AS (SELECT DISTINCT 'x:' || user_id AS id FROM posts WHERE user_id IS NOT NULL)"""


#: PageRank over nodes and edges, with the first round whose change is below the tolerance; ranks(id, rank).
RANKS = """shares AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM (SELECT DISTINCT src, dst FROM edges)),
  linked AS (SELECT n.id, n.id IN (SELECT src FROM shares) AS linked, (SELECT count(*) FROM nodes) AS n FROM nodes n),
  rounds AS (SELECT 0 AS k, id, linked, n, 1.0::DOUBLE / n AS rank FROM linked UNION ALL
    SELECT g.k + 1, l.id, l.linked, l.n, 0.15 / l.n + 0.85 * (coalesce(g.got, 0) + coalesce(g.loose, 0) / l.n) FROM
      (SELECT any_value(r.k) AS k, x.id, sum(CASE WHEN x.via THEN r.rank * x.share END) AS got, sum(CASE WHEN NOT x.via AND NOT r.linked THEN r.rank END) AS loose
        FROM rounds r JOIN (SELECT src, dst AS id, share, true AS via FROM shares UNION ALL SELECT a.id, b.id, 0.0, false FROM linked a, linked b WHERE NOT a.linked OR a.id = b.id) x ON x.src = r.id WHERE r.k < 80 GROUP BY x.id) g
      JOIN linked l ON l.id = g.id),
  changes AS (SELECT k, sum(abs(rank - old)) AS change FROM (SELECT k, rank, lag(rank) OVER (PARTITION BY id ORDER BY k) AS old FROM rounds) GROUP BY k),
  ranks AS (SELECT id, rank FROM rounds WHERE k = (SELECT coalesce(min(k), 80) FROM changes WHERE change < 1e-6))"""


def _nodes(spark: S, d: str) -> DataFrame:
    return posts(spark, d).where(F.col("user_id").isNotNull()).select(F.concat(F.lit("x:"), F.col("user_id").cast("string")).alias("id")).distinct()


def edge_agg(spark: S, d: str) -> DataFrame:
    found = links(spark, d)
    return G.aggregate_edges(found).join(G.edge_events(found), ["src", "dst"], "left").withColumn("event_ids", F.array_join("event_ids", ","))


def degree_centrality(spark: S, d: str) -> DataFrame:
    return G.degrees(_nodes(spark, d), G.aggregate_edges(links(spark, d)))


def graph_summary(spark: S, d: str) -> DataFrame:
    edges = G.aggregate_edges(links(spark, d))
    nodes = _nodes(spark, d).withColumn("observed", F.lit(True)).unionByName(G.new_nodes(edges, _nodes(spark, d)).withColumn("observed", F.lit(False)))
    return G.graph_summary(nodes, edges)


def anti_new_nodes(spark: S, d: str) -> DataFrame:
    return G.new_nodes(G.aggregate_edges(links(spark, d)), _nodes(spark, d))


def semi_edges_topk(spark: S, d: str) -> DataFrame:
    top = G.degrees(_nodes(spark, d), G.aggregate_edges(links(spark, d))).orderBy(F.desc("degree"), "id").limit(20)
    return G.surviving_edges(G.aggregate_edges(links(spark, d)), top).select("src", "dst", "weight")


def author_nodes(spark: S, d: str) -> DataFrame:
    p = posts(spark, d).withColumn("hashtags", F.array(F.concat(F.lit("#"), "trend")))
    return G.author_nodes(p).withColumn("hashtags", F.array_join("hashtags", ","))


def quote_resolution(spark: S, d: str) -> DataFrame:
    """Posts whose counter is odd quote the post with half their id; a third of the targets is unknown."""
    p = posts(spark, d).withColumns({"event_id": F.col("event_id").cast("string"), "quote_of": F.when(F.col("k") % 2 == 1, F.concat("platform", F.lit(":"), F.floor(F.col("event_id") / 2).cast("string")))})
    found, missing = G.resolved(p, "quote_of", "quote")
    return found.select("src", "dst", "event_id").unionByName(missing.select(F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), "event_id"))


def mention_resolution(spark: S, d: str) -> DataFrame:
    p = posts(spark, d).withColumns({"event_id": F.col("event_id").cast("string"), "mentions": F.array(F.concat(F.lit("@U"), (F.col("k") % 200).cast("string")))})
    handles = posts(spark, d).groupBy("platform", "author_id").agg(F.min("event_id").alias("ord")).withColumn("handle", F.concat(F.lit("u"), "author_id"))
    return G.mention_edges(p, handles).select("src", "dst", "event_id")


def behaviour_pattern(spark: S, d: str) -> DataFrame:
    return G.behaviour(posts(spark, d))


def pagerank(spark: S, d: str) -> DataFrame:
    edges = links(spark, d).select("src", "dst").distinct()
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return G.pagerank(nodes, edges)


def betweenness(spark: S, d: str) -> DataFrame:
    few = links(spark, d).withColumn("day", F.date_format("published_at", "yyyy-MM-dd"))
    return G.betweenness(few, "day")


def top_influencers(spark: S, d: str) -> DataFrame:
    edges = G.aggregate_edges(links(spark, d))
    authors = G.author_nodes(posts(spark, d).withColumns({"platform": F.lit("x"), "hashtags": F.array(F.lit("#all"))}))
    nodes = G.influence_signals(authors, edges, G.pagerank(authors, edges))
    return G.top_influencers(G.influence_scores(nodes)).select("place", "id", "influence", "influence_tier")


def communities(spark: S, d: str) -> DataFrame:
    edges = G.aggregate_edges(links(spark, d).where("kind <> 'like'"))
    return G.communities(_nodes(spark, d), edges)


def _weight() -> Column:
    return F.create_map(*[F.lit(x) for p in G.EDGE_WEIGHTS.items() for x in p])[F.col("kind")]


def edge_rollups(spark: S, d: str) -> DataFrame:
    return U.edge_rollups(links(spark, d), _weight())


def node_rollups(spark: S, d: str) -> DataFrame:
    return U.node_rollups(links(spark, d), _weight())


GRAINS = f"""{LINKS}, v AS (SELECT *, CASE kind WHEN 'reply' THEN 2 WHEN 'quote' THEN 3 WHEN 'repost' THEN 3 ELSE 1 END AS w FROM links), g(granularity, h) AS (VALUES ('6h', 6), ('1d', 24), ('7d', 168), ('30d', 720))"""
START = "make_timestamp(CAST(floor(epoch_us(published_at) / (h * 3.6e9)) * (h * 3600000000) AS BIGINT))"


def author_merge(spark: S, d: str) -> DataFrame:
    rows = posts(spark, d).select("platform", "author_id", "published_at", "likes", "quotes", "views", "event_id")
    return K.merge_latest(rows, ["platform", "author_id"], "published_at", ("likes", "views"), "event_id").drop("event_id")


def trend_upsert(spark: S, d: str) -> DataFrame:
    p = posts(spark, d).select(X.trend_key(F.col("trend")).alias("trend_key"), F.col("trend").alias("label"), F.col("published_at").alias("first_seen"), F.col("published_at").alias("last_seen"), "k")
    return K.upsert_trends(p.where("k % 2 = 0"), p.where("k % 2 = 1"))


def collection_sequence(spark: S, d: str) -> DataFrame:
    c = posts(spark, d).groupBy("trend", F.date_trunc("day", "published_at").alias("observed_at")).agg(F.min("event_id").alias("collection_id"))
    return K.sequence(c)


def insert_absent(spark: S, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return K.insert_absent(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'").select("o_custkey"), ["o_custkey"])


def profile_merge(spark: S, d: str) -> DataFrame:
    p = posts(spark, d).withColumn("author_name", F.concat(F.lit("user "), "author_id"))
    given = p.where("k % 9 = 0").select("platform", "author_id", F.col("event_id").alias("ord"), F.concat(F.lit("profile "), F.col("event_id").cast("string")).alias("name"))
    return K.first_profiles(given, p)


def analytics_fan_in(spark: S, d: str) -> DataFrame:
    c = F.element_at(F.array(*map(F.lit, ("sentiment", "demographic", "trend", "network", "other"))), (F.col("k") % 5 + 1).cast("int"))
    r = posts(spark, d).select((F.col("event_id") / 4).cast("long").alias("run_id"), c.alias("category"), F.col("event_id").cast("string").alias("payload"))
    return D.fan_in(r)


def field_leaves(spark: S, d: str) -> DataFrame:
    return I.field_leaves(snapshots(spark, d).select(F.concat_ws("@", "trend", F.date_format("captured_at", "yyyy-MM-dd")).alias("id"), "tier", "rank", "platforms"), "id", ["tier", "rank", "platforms"])


def tamper_diff(spark: S, d: str) -> DataFrame:
    s = snapshots(spark, d).select(F.concat_ws("@", "trend", F.date_format("captured_at", "yyyy-MM-dd")).alias("id"), "tier", "rank", "platforms")
    changed = s.withColumn("tier", F.when(F.col("rank") == 1, "dormant").otherwise(F.col("tier")))
    f = ["tier", "rank", "platforms"]
    return I.tampered(I.field_leaves(s, "id", f), I.field_leaves(changed, "id", f), "id")


def audit_join(spark: S, d: str) -> DataFrame:
    s = snapshots(spark, d).select(F.concat_ws("@", "trend", F.date_format("captured_at", "yyyy-MM-dd")).alias("snapshot_id"), F.col("trend").alias("label"), "score", "rank")
    anchors = s.select(F.when(F.col("rank") > 2, F.col("snapshot_id")).alias("snapshot_id"), "label", F.col("snapshot_id").alias("anchor"))
    return I.audit_join(anchors, s).select("anchor", "found")


def anchor_registry(spark: S, d: str) -> DataFrame:
    e = posts(spark, d).select((F.col("k") % 50).alias("key"), F.col("interactions").alias("value"), F.col("published_at").alias("at"), "event_id")
    return I.registry(e)


def merkle_roots(spark: S, d: str) -> DataFrame:
    """Keccak roots of batches of at most 100 field leaves of a trend's snapshots, with all proofs checked."""
    at = F.substring_index("id", "@", -1)
    leaves = field_leaves(spark, d).select("id", "field", "leaf", F.substring_index("id", "@", 1).alias("stream"), at.cast("date").alias("day"))
    dealt = I.batches(leaves, ["id", "field"])
    return I.verified(I.merkle_trees(dealt, "batch", ["leaf_index"])).groupBy("batch", "root").agg(F.count(F.lit(1)).alias("leaves"), F.bool_and("ok").alias("all_ok"))


def _prices(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    day = posts(spark, d).groupBy(F.col("trend").alias("instrument"), F.date_trunc("day", "published_at").alias("date")).agg(F.sum("likes").alias("close"))
    rules = spark.createDataFrame(
        [("r1", "click", "level", "above", 3000.0, None, None), ("r2", "view", "level", "below", 3000.0, None, None), ("r3", "click", "ma_cross", "above", None, 3, 7), ("r4", "error", "ma_cross", "below", None, 3, 7)],
        "rule_id string, instrument string, type string, direction string, level double, short int, long int",
    )
    return day, rules


def level_alerts(spark: S, d: str) -> DataFrame:
    return P.level_alerts(*_prices(spark, d))


def average_alerts(spark: S, d: str) -> DataFrame:
    return P.average_alerts(*_prices(spark, d))


def comment_threads(spark: S, d: str) -> DataFrame:
    """Turn n answers turn n / 2 of its conversation."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("post"), F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("parent_id"), F.col("turn").alias("ord"))
    return comment_tree(c.distinct()).select("post", "id", "depth", "place")


def dedupe_fingerprint(spark: S, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))
    return t.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


def url_parts(spark: S, d: str) -> DataFrame:
    key = X.url_key(F.col("url"))
    return table(spark, d, "pages").select("page_id", X.domain(F.col("url")).alias("domain"), key["scheme"].alias("scheme"), key["host"].alias("host"), key["rest"].alias("rest"))


def tags_of_documents(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(X.hashtags(F.replace(F.col("text"), F.lit(" th"), F.lit(" #th")))).alias("tag")).where(F.col("tag").rlike("^#[a-z0-9_]+$"))


def mentions_of_documents(spark: S, d: str) -> DataFrame:
    text = F.col("text")
    marked = table(spark, d, "documents").select("doc_id", F.replace(text, F.lit(" re"), F.lit(" @re")).alias("m"), F.replace(text, F.lit(" T"), F.lit(" #T")).alias("t"))
    found = marked.where(F.col("m").rlike(X.MENTION) | F.col("t").rlike(X.TAG))  # before the lists, so they are made once
    return found.select("doc_id", F.array_join(X.mentions(F.col("m")), ",").alias("mentions"), F.array_join(X.collected_hashtags(F.col("t")), ",").alias("tags"))


def label_slugs(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), X.trend_key(F.col("p_type")).alias("key"))


def relevance_labels(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.relevance(F.col("text"), F.lit("the thing")).alias("label"), X.reliable(F.col("text")).alias("reliable"))


def relation_types(spark: S, d: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("follows", "Likes", "mention", "shares", "reposts", "poke"))), (F.col("k") % 6 + 1).cast("int"))
    return posts(spark, d).groupBy(X.relation_type(names).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def humanized(spark: S, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", N.humanize(F.abs("c_acctbal") * F.pow(F.lit(10.0), F.col("c_custkey") % 6)).alias("text"))


def lenient_times(spark: S, d: str) -> DataFrame:
    us = F.unix_micros("published_at")
    t = F.when(F.col("k") % 4 == 0, (us / 1000000).cast("long").cast("string")).when(F.col("k") % 4 == 1, (us / 1000).cast("long").cast("string")).when(F.col("k") % 4 == 2, F.concat((us / 1000).cast("long").cast("string"), F.lit("-7"))).otherwise("soon")
    return posts(spark, d).select("event_id", M.to_timestamp_lenient(t).alias("at"))


def event_problems(spark: S, d: str) -> DataFrame:
    rules = [(F.col("views") > 250, "too many views"), (F.col("quotes").isNull(), "quotes are missing"), (F.col("reach") < 1300, "low reach")]
    return posts(spark, d).select("event_id", F.array_join(messages(rules), "; ").alias("errors")).where("errors <> ''")


def folded_union(spark: S, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("n")), table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("n"))
    both = c.unionByName(s)
    return both.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.lower("name")).alias("names"))


def segmented_tags(spark: S, d: str) -> DataFrame:
    words = ["the", "and", "for", "trend", "climate", "action", "now", "green", "energy"]
    tags = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0))).alias("tag")).distinct()  # case splits need the case
    return Z.segment_tags(tags, "tag", words)


def sentiment(spark: S, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("source").alias("trend"), F.col("doc_id").alias("event_id"), F.col("n_chars").cast("double").alias("interactions"), "text")
    return E.score(E.batches(texts)).select("run_id", "label", "confidence", "positive", "negative", "positive_share", "negative_share")


QUERIES = {
    "edge_agg": (edge_agg, f"WITH {EDGES.replace('[1:100]', '')} SELECT * EXCLUDE (ids), array_to_string(ids, ',') AS event_ids FROM edges"),
    "degree_centrality": (degree_centrality, f"""WITH {EDGES}, i AS (SELECT * FROM edges WHERE src IN (FROM nodes) AND dst IN (FROM nodes)), x AS (SELECT src AS id, 0 AS i, 1 AS o, 0 AS iw, weight AS ow FROM i UNION ALL SELECT dst, 1, 0, weight, 0 FROM i),
      g AS (SELECT id, sum(i) AS i, sum(o) AS o, sum(iw) AS iw, sum(ow) AS ow FROM x GROUP BY 1) SELECT n.id, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(iw, 0) AS BIGINT) AS weighted_in, CAST(coalesce(ow, 0) AS BIGINT) AS weighted_out,
      CAST(coalesce(i, 0) + coalesce(o, 0) AS BIGINT) AS degree, {jr("(coalesce(i, 0) + coalesce(o, 0)) / (2.0 * ((SELECT count(*) FROM nodes) - 1))", 6)} AS degree_centrality FROM nodes n LEFT JOIN g USING (id)"""),
    "graph_summary": (graph_summary, f"""WITH {EDGES}, ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges UNION SELECT id FROM nodes), n AS (SELECT count(*) AS nodes, (SELECT count(*) FROM nodes) AS observed FROM ends)
      SELECT nodes, observed, e.*, nodes - observed AS external, {jr("e.edges / (nodes * (nodes - 1.0))", 6)} AS density FROM n, (SELECT count(*) AS edges, CAST(sum(weight) AS BIGINT) AS total_weight, {", ".join(f"CAST(sum(n_{k}) AS BIGINT) AS n_{k}" for k in G.EDGE_WEIGHTS)} FROM edges) e"""),
    "anti_new_nodes": (anti_new_nodes, f"WITH {EDGES} SELECT id FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (FROM nodes)"),
    "semi_edges_topk": (semi_edges_topk, f"""WITH {EDGES}, i AS (SELECT * FROM edges WHERE src IN (FROM nodes) AND dst IN (FROM nodes)), x AS (SELECT src AS id FROM i UNION ALL SELECT dst FROM i), g AS (SELECT n.id, count(x.id) AS d FROM nodes n LEFT JOIN x USING (id) GROUP BY 1),
      t AS (SELECT id FROM g ORDER BY d DESC, id LIMIT 20) SELECT src, dst, weight FROM edges WHERE src IN (FROM t) AND dst IN (FROM t)"""),
    "author_nodes": (author_nodes, f"""WITH {POSTS} SELECT platform || ':' || author_id AS id, count(*) AS posts, CAST(sum(likes) AS BIGINT) AS likes, CAST(sum(replies) AS BIGINT) AS replies, CAST(sum(reposts) AS BIGINT) AS reposts, CAST(coalesce(sum(quotes), 0) AS BIGINT) AS quotes,
      CAST(sum(views) AS BIGINT) AS views, CAST(sum(likes + replies + reposts + coalesce(quotes, 0)) AS BIGINT) AS interactions, max(followers) AS followers, greatest(max(followers), max(views)) AS reach, bool_or(verified) AS verified,
      array_to_string(list_sort(list(DISTINCT '#' || trend)), ',') AS hashtags, min(published_at) AS first_seen FROM posts GROUP BY 1"""),
    "quote_resolution": (quote_resolution, f"""WITH {POSTS}, q AS (SELECT platform, author_id, event_id, event_id // 2 AS t FROM posts WHERE k % 2 = 1), j AS (SELECT q.*, p.author_id AS a FROM q LEFT JOIN posts p ON p.platform = q.platform AND p.event_id = q.t)
      SELECT CASE WHEN a IS NOT NULL THEN platform || ':' || author_id END AS src, CASE WHEN a IS NOT NULL THEN platform || ':' || a END AS dst, CAST(event_id AS VARCHAR) AS event_id FROM j WHERE a IS NULL OR a <> author_id"""),
    "mention_resolution": (mention_resolution, f"""WITH {POSTS}, h AS (SELECT DISTINCT platform, author_id, 'u' || author_id AS handle FROM posts), m AS (SELECT platform, author_id, event_id, 'u' || (k % 200) AS handle FROM posts),
      j AS (SELECT m.platform || ':' || m.author_id AS src, CASE WHEN h.author_id IS NOT NULL THEN m.platform || ':' || h.author_id ELSE 'external:' || m.platform || ':' || m.handle END AS dst, CAST(event_id AS VARCHAR) AS event_id FROM m LEFT JOIN h USING (platform, handle)) SELECT * FROM j WHERE src <> dst"""),
    "behaviour_pattern": (behaviour_pattern, f"""WITH {POSTS}, g AS (SELECT author_id, (epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY author_id ORDER BY published_at, event_id))) / 1000 AS d FROM posts),
      r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY d) AS r, count(*) OVER (PARTITION BY author_id) AS n FROM g WHERE d IS NOT NULL)
      SELECT author_id, count(*) AS delays, {jr("max(CASE WHEN r = n // 2 + 1 THEN d END)", 3)} AS median_ms, {jr("avg(d)", 2)} AS mean_ms, {jr("stddev_pop(d)", 2)} AS deviation_ms FROM r GROUP BY 1"""),
    "pagerank": (pagerank, f"""WITH RECURSIVE {LINKS}, edges AS (SELECT DISTINCT src, dst FROM links), nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), {RANKS}
      SELECT id, {jr("rank", 8)} AS pagerank FROM ranks"""),
    "betweenness": (betweenness, None),
    "communities": (communities, None),
    "edge_rollups": (edge_rollups, f"WITH {GRAINS} SELECT src, dst, granularity, {START} AS bucket_start, count(*) AS links, CAST(sum(w) AS BIGINT) AS weight, count(DISTINCT event_id) AS events FROM v, g GROUP BY 1, 2, 3, 4"),
    "node_rollups": (node_rollups, f"""WITH {GRAINS}, n AS (SELECT published_at, src AS id, dst AS peer, w, 0 AS i FROM v UNION ALL SELECT published_at, dst, src, w, w FROM v)
      SELECT id, granularity, {START} AS bucket_start, count(*) AS links, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(i) AS BIGINT) AS weight_in, count(DISTINCT peer) AS peers FROM n, g GROUP BY 1, 2, 3"""),
    "top_influencers": (top_influencers, f"""WITH RECURSIVE {EDGES}, {RANKS}, p AS (SELECT 'x:' || user_id AS id, sum(likes) AS l, sum(replies) AS c, sum(reposts) AS s, coalesce(sum(quotes), 0) AS q, sum(likes + replies + reposts + coalesce(quotes, 0)) AS i, greatest(max(followers), max(views)) AS reach FROM posts WHERE user_id IS NOT NULL GROUP BY 1),
      ev AS (SELECT *, {" + ".join(f"n_{k}" for k in G.EDGE_WEIGHTS)} AS every FROM edges), t AS (SELECT dst AS id, sum(every) AS got, sum(n_repost) AS got_s FROM ev GROUP BY 1), f AS (SELECT src AS id, sum(every) AS gave FROM ev GROUP BY 1),
      g AS (SELECT id, l + c + s + coalesce(got_s, 0) AS a, {jr("rank", 8)} AS b, reach AS c, q + s + coalesce(got, 0) AS d, i + coalesce(gave, 0) AS e FROM p LEFT JOIN t USING (id) LEFT JOIN f USING (id) LEFT JOIN ranks USING (id)),
      s AS (SELECT id, b, {jr("(0.30 * a / max(a) OVER () + 0.25 * b / max(b) OVER () + 0.15 * c / max(c) OVER () + 0.20 * d / max(d) OVER () + 0.10 * e / max(e) OVER ()) * 100", 2)} AS influence FROM g)
      SELECT row_number() OVER (ORDER BY influence DESC, b DESC, id) AS place, id, influence, CASE WHEN influence >= 70 THEN 'high' WHEN influence >= 40 THEN 'medium' ELSE 'low' END AS influence_tier FROM s QUALIFY place <= 10"""),
    "author_merge": (author_merge, f"WITH {POSTS} SELECT platform, author_id, max(published_at) AS published_at, arg_max(likes, (published_at, CAST(event_id AS BIGINT))) AS likes, arg_max(quotes, (published_at, event_id)) FILTER (WHERE quotes IS NOT NULL) AS quotes, arg_max(views, (published_at, event_id)) AS views FROM posts GROUP BY 1, 2"),
    "trend_upsert": (trend_upsert, f"WITH {POSTS} SELECT regexp_replace(lower(trim(trend)), '\\s+', '-', 'g') AS trend_key, max(trend) AS label, min(published_at) AS first_seen, max(published_at) AS last_seen, 'active' AS status FROM posts GROUP BY 1"),
    "collection_sequence": (collection_sequence, f"WITH {POSTS}, c AS (SELECT trend, date_trunc('day', published_at) AS observed_at, min(event_id) AS collection_id FROM posts GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY trend ORDER BY observed_at, collection_id) AS collection_sequence FROM c"),
    "insert_absent": (insert_absent, "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "profile_merge": (profile_merge, f"WITH {POSTS}, g AS (SELECT platform, author_id, 'profile ' || min(event_id) AS name FROM posts WHERE k % 9 = 0 GROUP BY 1, 2), s AS (SELECT DISTINCT platform, author_id FROM posts) SELECT s.*, coalesce(name, 'user ' || author_id) AS name, name IS NULL AS from_post FROM s LEFT JOIN g USING (platform, author_id)"),
    "analytics_fan_in": (analytics_fan_in, f"""WITH {POSTS}, r AS (SELECT event_id // 4 AS run_id, (['sentiment','demographic','trend','network','other'])[k % 5 + 1] AS c, CAST(event_id AS VARCHAR) AS p FROM posts),
      g AS (SELECT run_id, {", ".join(f"count(*) FILTER (WHERE c = '{c}') AS n_{c}, max(CASE WHEN c = '{c}' THEN p END) AS {c}" for c in ("sentiment", "demographic", "trend", "network"))}, count(*) FILTER (WHERE c = 'other') AS x FROM r GROUP BY 1)
      SELECT run_id, sentiment, demographic, trend, network, array_to_string(list_filter([{", ".join(f"CASE WHEN n_{c} = 0 THEN 'missing {c}' END" for c in ("sentiment", "demographic", "trend", "network"))}, {", ".join(f"CASE WHEN n_{c} > 1 THEN 'duplicate {c}' END" for c in ("sentiment", "demographic", "trend", "network"))}, CASE WHEN x > 0 THEN 'unexpected category' END], lambda v: v IS NOT NULL), '; ') AS problem FROM g"""),
    "field_leaves": (field_leaves, f"WITH {SNAPSHOTS}, i AS (SELECT trend || '@' || strftime(captured_at, '%Y-%m-%d') AS id, * FROM snapshots) SELECT id, field, '0x' || sha256(field || ':' || v) AS leaf FROM (SELECT id, 'tier' AS field, tier AS v FROM i UNION ALL SELECT id, 'rank', CAST(rank AS VARCHAR) FROM i UNION ALL SELECT id, 'platforms', CAST(platforms AS VARCHAR) FROM i)"),
    "tamper_diff": (tamper_diff, f"WITH {SNAPSHOTS} SELECT trend || '@' || strftime(captured_at, '%Y-%m-%d') AS id, CASE WHEN rank = 1 AND tier <> 'dormant' THEN 'TAMPER_DETECTED' ELSE 'INTACT' END AS verdict, CASE WHEN rank = 1 AND tier <> 'dormant' THEN 'tier' ELSE '' END AS tampered, CASE WHEN rank = 1 AND tier <> 'dormant' THEN 'platforms,rank' ELSE 'platforms,rank,tier' END AS intact FROM snapshots"),
    "audit_join": (audit_join, f"WITH {SNAPSHOTS}, i AS (SELECT trend || '@' || strftime(captured_at, '%Y-%m-%d') AS id, * FROM snapshots), l AS (SELECT trend, arg_min(score, id) AS s FROM i GROUP BY 1) SELECT id AS anchor, CASE WHEN rank > 2 THEN score ELSE l.s END AS found FROM i JOIN l USING (trend)"),
    "anchor_registry": (anchor_registry, f"WITH {POSTS} SELECT k % 50 AS key, arg_min(interactions, (published_at, event_id)) AS value, min(published_at) AS at, count(*) - 1 AS matches FROM posts GROUP BY 1"),
    "merkle_roots": (merkle_roots, None),
    "level_alerts": (level_alerts, f"""WITH {POSTS}, p AS (SELECT trend AS instrument, date_trunc('day', published_at) AS date, sum(likes) AS c FROM posts GROUP BY 1, 2), l AS (SELECT *, lag(c) OVER (PARTITION BY instrument ORDER BY date) AS b FROM p)
      SELECT date, 'r1' AS rule_id, instrument, 'above' AS direction FROM l WHERE instrument = 'click' AND b < 3000 AND c >= 3000 UNION ALL SELECT date, 'r2', instrument, 'below' FROM l WHERE instrument = 'view' AND b > 3000 AND c <= 3000"""),
    "average_alerts": (average_alerts, f"""WITH {POSTS}, p AS (SELECT trend AS instrument, date_trunc('day', published_at) AS date, sum(likes) AS c FROM posts GROUP BY 1, 2),
      s AS (SELECT *, sum(c) OVER (PARTITION BY instrument ORDER BY date ROWS 2 PRECEDING) * 7 - sum(c) OVER (PARTITION BY instrument ORDER BY date ROWS 6 PRECEDING) * 3 AS g, count(*) OVER (PARTITION BY instrument ORDER BY date ROWS 6 PRECEDING) AS n FROM p),
      l AS (SELECT *, CASE WHEN n = 7 THEN sign(g) END AS x FROM s), m AS (SELECT *, lag(x) OVER (PARTITION BY instrument ORDER BY date) AS y FROM l)
      SELECT date, 'r3' AS rule_id, instrument, 'above' AS direction FROM m WHERE instrument = 'click' AND y <= 0 AND x > 0 UNION ALL SELECT date, 'r4', instrument, 'below' FROM m WHERE instrument = 'error' AND y >= 0 AND x < 0"""),
    "comment_threads": (comment_threads, """WITH RECURSIVE c AS (SELECT DISTINCT conv_id AS post, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent FROM conversations),
      t AS (SELECT post, id, 0 AS depth, [id] AS path FROM c WHERE parent IS NULL UNION ALL SELECT c.post, c.id, t.depth + 1, list_append(t.path, c.id) FROM c JOIN t ON c.post = t.post AND c.parent = t.id)
      SELECT post, id, depth, row_number() OVER (PARTITION BY post ORDER BY path) AS place FROM t"""),
    "dedupe_fingerprint": (dedupe_fingerprint, "SELECT sha256(nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '')) AS fingerprint, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "url_parts": (url_parts, "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS domain, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS rest FROM pages"),
    "tags_of_documents": (tags_of_documents, "WITH t AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(replace(text, ' th', ' #th'), '#[\\p{L}\\p{N}_]+'), lambda x: lower(x)))) AS tag FROM documents) SELECT * FROM t WHERE regexp_matches(tag, '^#[a-z0-9_]+$')"),
    "mentions_of_documents": (mentions_of_documents, None),
    "label_slugs": (label_slugs, """SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS slug,
      regexp_replace(lower(trim(p_type)), '\\s+', '-', 'g') AS key FROM part"""),
    "relevance_labels": (relevance_labels, """WITH w AS (SELECT doc_id, lower(text) AS t, list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda x: NOT regexp_matches(x, '^(#|@|https?://)') AND regexp_matches(x, '\\p{L}')) AS w FROM documents)
      SELECT doc_id, CASE WHEN contains(t, 'the thing') THEN 'lexical' WHEN contains(t, 'the') OR contains(t, 'thing') THEN 'partial_lexical' ELSE 'unknown' END AS label, len(w) >= 3 AND length(array_to_string(w, ' ')) >= 15 AS reliable FROM w"""),
    "relation_types": (relation_types, f"WITH {POSTS} SELECT (['follow','like','mention','repost','repost',NULL])[k % 6 + 1] AS kind, count(*) AS n FROM posts GROUP BY 1"),
    "humanized": (humanized, """WITH v AS (SELECT c_custkey, abs(c_acctbal) * pow(10.0, c_custkey % 6) AS x FROM customer), u AS (SELECT c_custkey, CASE WHEN x >= 1e9 THEN floor(x / 1e9 * 10 + 0.5) / 10 WHEN x >= 1e6 THEN floor(x / 1e6 * 10 + 0.5) / 10 WHEN x >= 1e3 THEN floor(x / 1e3 * 10 + 0.5) / 10 ELSE floor(x + 0.5) END AS v,
      CASE WHEN x >= 1e9 THEN 'B' WHEN x >= 1e6 THEN 'M' WHEN x >= 1e3 THEN 'K' ELSE '' END AS m FROM v) SELECT c_custkey, regexp_replace(CAST(v AS VARCHAR), '\\.0$', '') || m AS text FROM u"""),
    "lenient_times": (lenient_times, f"WITH {POSTS} SELECT event_id, CASE k % 4 WHEN 0 THEN date_trunc('second', published_at) WHEN 1 THEN date_trunc('millisecond', published_at) WHEN 2 THEN date_trunc('millisecond', published_at) END AS at FROM posts"),
    "event_problems": (event_problems, f"WITH {POSTS}, x AS (SELECT event_id, array_to_string(list_filter([CASE WHEN views > 250 THEN 'too many views' END, CASE WHEN quotes IS NULL THEN 'quotes are missing' END, CASE WHEN reach < 1300 THEN 'low reach' END], lambda v: v IS NOT NULL), '; ') AS errors FROM posts) SELECT * FROM x WHERE errors <> ''"),
    "folded_union": (folded_union, "WITH u AS (SELECT c_name AS name, c_nationkey AS n FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier) SELECT n, count(*) AS rows, count(DISTINCT lower(name)) AS names FROM u GROUP BY 1"),
    "segmented_tags": (segmented_tags, None),
    "sentiment": (sentiment, None),
}
