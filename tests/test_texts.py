from __future__ import annotations

from pulsegrid.plans import graph_queries, trend_queries


def test_whole_texts_and_their_hashtags(spark, tmp_path):
    late = "#one #two https://example.org/a/long/address and then running text that is long enough"
    spark.createDataFrame([(1, late, "en"), (2, "#GreenEnergy Now Yes", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    assert {r["doc_id"]: r["reliable"] for r in graph_queries.relevance_labels(spark, d).collect()}[1]
    assert [tuple(r) for r in trend_queries.hashtag_cooccurrence(spark, d).collect()] == [("en", "#one", "#two", 1)]
    got = {r["tag"]: r["words"] for r in graph_queries.segmented_tags(spark, d).collect()}
    assert set(got) == {"#one", "#two", "#GreenEnergy"} and got["#GreenEnergy"] == ["Green", "Energy"]
