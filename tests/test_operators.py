from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import distributions, graph, integrity, ranking, rules, segmentation, sentiment, sinks, trend, validate
from pulsegrid.operators.normalize import normalize
from pulsegrid.sources.collections import comment_tree, events_of, pairs_to_map, parse_envelopes, trends_with_rank



def now():
    return F.lit("2024-01-10").cast("timestamp")

T0 = datetime(2024, 1, 9)


def posts(spark, rows):
    full = [(f"x:{i}", t, "x", T0 + timedelta(hours=h), v, 1.0, None) for i, (t, h, v) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id string, trend string, platform string, published_at timestamp, interactions double, influence double, engagement_rate double")


def test_dynamics_by_hand(spark):
    got = trend.dynamics(posts(spark, [("a", 0, 10.0), ("a", 1, 30.0), ("b", 2, 5.0), ("c", 400, 1.0)]), now()).where("span = '24h'").collect()
    by = {r["trend"]: r for r in got}
    assert set(by) == {"a", "b"}  # the future post is in no window
    first, second = 10 * 0.5**6, 30 * 0.5 ** (23 / 4)
    assert by["a"]["velocity"] == pytest.approx(first + second, abs=1e-4) and by["a"]["burst_score"] == pytest.approx(second / (first + second), abs=1e-4)
    assert by["a"]["peak_bucket_hour"] == 1 and by["b"]["virality_tier"] == "dormant" and by["b"]["trend_score"] == 0


def test_lifecycle_keeps_inner_gaps_and_counts_every_post(spark):
    got = trend.lifecycle(posts(spark, [("a", 0, 1.0), ("a", 5, 2.0), ("a", 5, None)]), now()).where("span = '24h'").orderBy("bucket").collect()
    assert [r["posts"] for r in got] == [1, 0, 0, 0, 0, 2] and sum(r["interactions"] for r in got) == 3.0


def test_growth_and_peak(spark):
    p = posts(spark, [("a", 0, 10.0), ("a", 7, 30.0), ("b", 0, 1.0), ("c", 0, 0.0), ("c", 1, 4.0)])
    assert {r["trend"]: r["growth"] for r in trend.growth(p).collect()} == {"a": "+200%", "b": "+0%", "c": "+∞%"}
    assert {r["trend"]: (r["peak_growth"], r["peak_date"]) for r in trend.peak(p).collect()}["a"] == ("+50%", "Jan 9")


def snapshots(spark, scores):
    rows = [("t", T0 + timedelta(hours=i), s, 1.0 * i, 2.0 * i, 0.0, 100.0 * i, 0.1, 1, 5 - i if i < 4 else 1, "viral") for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "trend string, captured_at timestamp, score double, velocity double, acceleration double, burst double, engagement double, virality double, platforms int, rank int, tier string")


def test_forecast_rate_and_peak(spark):
    r = ranking.forecast(snapshots(spark, [58.0, 71.0, 82.0])).first()
    assert ranking.hourly_rate(snapshots(spark, [58.0, 71.0, 82.0])).first()["rate"] == 12.0
    assert r["hours_to_peak"] == 2.0 and r["confidence"] == "low" and r["h24"] == 100.0
    alone = ranking.forecast(snapshots(spark, [58.0])).first()
    assert alone["h6"] is None and alone["confidence"] == "insufficient_data" and alone["direction"] == "stable"


def test_graph_fixture_by_hand(spark):
    links = spark.createDataFrame(
        [("x", "300", "100", "follows", T0, "1"), ("x", "200", "x:100", "follow", T0, "2"), ("x", "200", "100", "like", T0, "3"), ("x", "300", "100", "likes", T0, "4"), ("x", "300", "200", "like", T0, "5"), ("x", "1", "1", "like", T0, "6"), ("x", "1", "2", "poke", T0, "7")],
        "platform string, source_user string, target_user string, type string, observed_at timestamp, post string",
    )
    edges = graph.aggregate_edges(graph.relationship_edges(links))
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == {("x:200", "x:100"): 2, ("x:300", "x:100"): 2, ("x:300", "x:200"): 1}
    nodes = spark.createDataFrame([("x:100",), ("x:200",), ("x:300",)], "id string")
    assert {r["degree_centrality"] for r in graph.degrees(nodes, edges).collect()} == {0.5}
    summary = graph.graph_summary(nodes.withColumn("observed", F.lit(True)), edges).first()
    assert (summary["edges"], summary["total_weight"], summary["density"]) == (3, 5, 0.5)
    assert {r["betweenness"] for r in graph.betweenness(edges.withColumn("g", F.lit(1)), "g").collect()} == {0.0}
    ranks = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, edges).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-4) and max(ranks, key=ranks.get) == "x:100"


def test_betweenness_of_a_path_and_coordination(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (2, "a", "b")], "g int, src string, dst string")
    got = {(r["g"], r["id"]): r["betweenness"] for r in graph.betweenness(edges, "g").collect()}
    assert got[1, "b"] == got[1, "c"] == pytest.approx(2 / 6, abs=1e-6) and got[2, "a"] == 0.0
    flags = spark.createDataFrame([(0.8, 0.7, 3, 900.0, 20.0), (0.8, 0.7, 1, 900.0, 20.0)], "d double, b double, n int, m double, s double")
    assert [r[0] for r in flags.select(graph.coordinated(*map(F.col, "dbnms"))).collect()] == [True, False]


def test_merges_are_idempotent_and_follow_their_rules(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 3, None), ("b", 1, None, None)], "k string, at int, likes int, bio string")
    once = sinks.merge_latest(rows, ["k"], "at", ("likes",))
    assert sorted(map(tuple, once.select("k", "at", "likes", "bio").collect())) == [("a", 2, 3, "x"), ("b", 1, None, None)]
    again = sinks.merge_latest(once.select(*rows.columns).unionByName(rows), ["k"], "at", ("likes",))
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "r")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, c string"), path, "c")
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "v int, c string"), path, "c")
    assert sorted((r["v"], r["c"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_keccak_merkle_and_tampering(spark):
    assert integrity.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert integrity.keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    rows = spark.createDataFrame([(9901, 92.4, "mega_viral"), (9902, 71.0, "viral"), (9903, 45.2, "emerging")], "id long, score double, tier string")
    leaves = integrity.field_leaves(rows, "id", ["tier", "score"])
    assert leaves.where("id = 9902 and field = 'score'").first()["leaf"] == "0x" + hashlib.sha256(b"score:71").hexdigest()
    trees = integrity.verified(integrity.merkle_trees(leaves.withColumn("b", F.lit(1)), "b", ["id", "field"]))
    assert trees.where("ok").count() == 6
    broken = trees.drop("ok").withColumn("leaf", F.concat(F.lit("0x"), F.sha2("leaf", 256)))
    assert integrity.verified(broken).where("ok").count() == 0
    changed = rows.withColumns({"tier": F.when(F.col("id") == 9901, "dormant").otherwise(F.col("tier")), "score": F.when(F.col("id") == 9901, 5.0).otherwise(F.col("score"))})
    got = {r["id"]: (r["verdict"], r["tampered"]) for r in integrity.tampered(leaves, integrity.field_leaves(changed, "id", ["tier", "score"]), "id").collect()}
    assert got == {9901: ("TAMPER_DETECTED", "score,tier"), 9902: ("INTACT", ""), 9903: ("INTACT", "")}


def test_price_rules(spark):
    prices = spark.createDataFrame([(T0.date() + timedelta(days=i), "i", float(c)) for i, c in enumerate((1, 2, 3, 2, 1, 5))], "date date, instrument string, close double")
    given = spark.createDataFrame([("up", "i", "level", "above", 3.0, None, None), ("down", "i", "level", "below", 2.0, None, None), ("ma", "i", "ma_cross", "above", None, 1, 3)], "rule_id string, instrument string, type string, direction string, level double, short int, long int")
    days = lambda rows: sorted((r["rule_id"], (r["date"] - T0.date()).days) for r in rows.collect())
    assert days(rules.level_alerts(prices, given)) == [("down", 3), ("up", 2), ("up", 5)]
    assert days(rules.average_alerts(prices, given)) == [("ma", 5)]
    assert rules.duplicates(prices.union(prices.limit(1))).count() == 1


def test_segmentation(spark):
    tags = spark.createDataFrame([("#ClimateActionNow",), ("#greenenergy",), ("#COVID19_news",), (None,)], "tag string")
    got = {r["tag"]: (r["words"], r["layer"]) for r in segmentation.segment_tags(tags, "tag", ["green", "energy"]).collect()}
    assert got["#ClimateActionNow"] == (["Climate", "Action", "Now"], 1) and got["#greenenergy"] == (["green", "energy"], 2) and got["#COVID19_news"] == (["COVID", "19", "news"], 1)


def test_sentiment_batches_and_decisions(spark):
    rows = spark.createDataFrame([("r", f"e{i}", float(i), "love love win" if i > 5 else "hate") for i in range(40)] + [("s", "e", 1.0, None)], "trend string, event_id string, interactions double, text string")
    batch = {r["run_id"]: r for r in sentiment.batches(rows).collect()}
    assert batch["r"]["n"] == 30 and json.loads(batch["r"]["state"])[0]["event_id"] == "e39"
    got = {r["run_id"]: r["label"] for r in sentiment.score(sentiment.batches(rows)).collect()}
    assert got == {"r": "positive", "s": "neutral"}
    scored = spark.createDataFrame([("a", "n1", 0.9), ("b", "text", 0.4), ("c", "new", 0.9), ("d", None, 0.0), ("e", "new", 0.9)], "run_id string, narrative string, narrative_confidence double")
    pool = spark.createDataFrame([("a", "n1", "x", 1), ("b", "n2", "text", 1)] + [("e", f"n{i}", f"t{i}", i) for i in range(50)], "run_id string, narrative_id string, narrative_text string, created_at int")
    assert {r["run_id"]: r["decision"] for r in sentiment.decide(scored, pool).collect()} == {"a": "accepted", "b": "fallback_existing", "c": "fallback_new", "d": "none", "e": "pool_full"}
    more = sentiment.append_narratives(pool, spark.createDataFrame([("a", "n9", "y", 2), ("a", "n8", "x", 2), ("e", "n99", "z", 99)], pool.schema))
    assert {r["run_id"]: r["count"] for r in more.groupBy("run_id").count().collect()} == {"a": 2, "b": 1, "e": 50}


ENVELOPE = {
    "schemaVersion": "1.0.0", "collection": {"collectionId": "c1"}, "trend": {"label": "T"}, "platforms": {"x": {"status": "success", "pagination": {"primaryResultsReturned": 1, "relationshipRecordsCollected": 1, "recordsCollected": 2}}},
    "events": [
        {"eventId": "x:1", "platform": "x", "platformPostId": "1", "content": {"text": "a #B"}, "author": {"authorId": "u1"}, "time": {"publishedAt": "2026-01-01T00:00:00Z", "observedAt": "2026-01-01T02:00:00Z"}, "engagement": {"likes": 3, "replies": None}, "relationships": {"quoteOfId": "x:2"}},
        {"eventId": "t3_e", "platform": "reddit", "platformPostId": "t3_e", "content": {"text": "x", "title": "#Tag"}, "author": {"authorId": "bukzr9b4"}, "time": {"publishedAt": "2026-01-01T00:00:00", "observedAt": "2026-01-01T00:01:00Z", "editedAt": "1970-01-01T00:00:00Z"}, "engagement": {"replies": 4}},
    ],
    "authorProfiles": [{"authorId": "stranger"}], "communities": [], "quality": {"recordsCollected": 2, "warnings": ["w"], "errors": []},
}


def test_envelopes_are_parsed_validated_and_normalised(spark):
    bad = [{**ENVELOPE, "schemaVersion": "2"}, {**ENVELOPE, "collection": {}}, {**ENVELOPE, "quality": {"recordsCollected": 9}}, {**ENVELOPE, "events": [ENVELOPE["events"][0]] * 2}]
    lines = [json.dumps(ENVELOPE), "not json", "[1]", *map(json.dumps, bad)]
    good, quarantine = parse_envelopes(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert quarantine.count() == 2
    checked = validate.validated_envelopes(good).collect()
    assert checked[0]["all_errors"] == [] and checked[0]["all_warnings"] == ["w", "profile of an author who is not in the collection"]
    assert [r["all_errors"] for r in checked[1:]] == [["schemaVersion must be 1.0.0"], ["collectionId is required"], ["recordsCollected differs from the events"], ["duplicate eventId"]]
    assert good.select(validate.relationship_records(good)).first()[0] == 1
    events = events_of(parse_envelopes(spark.createDataFrame([(lines[0],)], "value string"))[0])
    errors = {r["eventId"]: r["errors"] for r in validate.validated_events(events).collect()}
    assert errors["x:1"] == [] and errors["t3_e"] == ["reddit authors are t2_", "time.publishedAt needs a timezone", "time.editedAt is an epoch fallback"]
    rows = {r["event_id"]: r for r in normalize(events).collect()}
    assert (rows["x:1"]["interactions"], rows["x:1"]["velocity_window"], rows["x:1"]["reach"]) == (3.0, 2.0, None)
    assert (rows["t3_e"]["interactions"], rows["t3_e"]["hashtags"]) == (4.0, ["#tag"])
    assert one_row(spark, validate.http_status(F.lit(429))) == ("rate_limited", True) and one_row(spark, validate.http_status(F.lit(404))) == ("error", False)


def one_row(spark, column):
    return tuple(spark.range(1).select(column.alias("x")).first()["x"])


def test_sources(spark):
    tree = comment_tree(spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 1), (1, 3, 1, 2), (1, 4, 2, 3)], "post int, id int, parent_id int, ord int"), 3)
    assert [r["id"] for r in tree.orderBy("place").collect()] == [1, 2, 4]
    assert spark.createDataFrame([(["a", "1", "b", "2"],)], "fields array<string>").select(pairs_to_map().alias("m")).first()["m"] == {"a": "1", "b": "2"}
    assert [(r["trend"], r["rank"]) for r in trends_with_rank(spark.createDataFrame([(["x", "y"],)], "trends array<string>")).collect()] == [("x", 1), ("y", 2)]


def test_pairs_shares_and_cuts(spark):
    rows = spark.createDataFrame([(["B", "a", "b"],), (["a", "b"],), ([],)], "t array<string>")
    assert [tuple(r) for r in distributions.tag_pairs(rows, "t").collect()] == [("a", "b", 2)]
    shares = distributions.shares(spark.createDataFrame([("a",), ("b",), ("c",)], "p string"), "p").collect()
    assert sum(r["share"] for r in shares) == 100
    assert distributions.kept_by_share(spark.range(10).withColumn("s", F.col("id")), "s", "id", 6, 0.2).count() == 6


def test_edges_list_all_their_events(spark):
    from pulsegrid.plans import graph_queries

    links = spark.range(300).select(F.lit("x:1").alias("src"), F.lit("x:2").alias("dst"), (F.col("id") % 250).cast("string").alias("event_id"))
    links = links.unionByName(spark.createDataFrame([("x:2", "x:1", None)], "src string, dst string, event_id string"))
    got = {r["src"]: r["event_ids"] for r in graph.edge_events(links).collect()}
    assert got == {"x:1": sorted(str(i) for i in range(250)), "x:2": []}
    assert "[1:100]" not in graph_queries.QUERIES["edge_agg"][1]
