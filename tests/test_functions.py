from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from pulsegrid.functions import numbers, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rounding_goes_up_at_halves(spark):
    for value, digits, want in ((-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 2, 1.0), (float("nan"), 2, 0.0), (None, 1, 0.0)):
        assert one(spark, numbers.js_round(F.lit(value).cast("double"), digits)) == want


def test_null_sums_and_coercions(spark):
    rows = spark.createDataFrame([(None, None), (1, None), (2, 3)], "a int, b int")
    assert [r["s"] for r in rows.select(numbers.null_sum("a", "b").alias("s")).collect()] == [None, 1, 5]
    assert [one(spark, numbers.safe_count(F.lit(v))) for v in ("7.9", "-3", "x", None)] == [7, 0, 0, 0]
    assert [one(spark, numbers.non_negative(F.lit(v))) for v in ("7.5", "-3", "x")] == [7.5, 0.0, 0.0]


def test_human_numbers(spark):
    assert [one(spark, numbers.humanize(F.lit(float(v)))) for v in (999, 999_999, 1_250_000, 2e9, 0)] == ["999", "1000K", "1.3M", "2B", "0"]
    assert [one(spark, numbers.parse_suffixed(F.lit(v))) for v in ("2.4M", "+82%", "850K", "x")] == [2.4e6, 82.0, 850e3, None]


def test_tiers(spark):
    assert [one(spark, numbers.tier(F.lit(v))) for v in (0.2, 0.21, 0.6, 0.8, 0.81)] == ["dormant", "emerging", "trending", "viral", "mega_viral"]
    assert [one(spark, numbers.tier_order(F.lit(v))) for v in ("viral", "?", None)] == [3, -1, -1]


def test_tags_mentions_urls(spark):
    assert one(spark, text.hashtags(F.lit("#One x#two #ONE नमस्ते #नमस्ते"))) == ["#one", "#two", "#नमस"]
    assert one(spark, text.collected_hashtags(F.lit("#One x#two #ONE #1st ##a #b-c"))) == ["One", "b-c"]
    assert one(spark, text.mentions(F.lit("@a x@b @A, @c_d"))) == ["a", "c_d"]
    assert one(spark, text.urls(F.lit("[t](https://example.com) http://X.org/a). https://EXAMPLE.com"))) == ["https://example.com", "http://X.org/a"]
    assert one(spark, text.domain(F.lit("https://u:p@WWW.Example.com:80/x"))) == "www.example.com"
    key = one(spark, text.url_key(F.lit("http://www.Example.com:80/x?y#z")))
    assert (key["scheme"], key["host"], key["rest"]) == ("http", "example.com", "/x?y")


def test_slugs_ids_and_fingerprints(spark):
    assert [one(spark, text.slug(F.lit(v))) for v in ("  Hello,  World! -- x ", "", None)] == ["hello-world-x", "unknown-trend", "unknown-trend"]
    assert one(spark, text.node_id(F.lit("X"), F.lit("x:X:12"))) == "x:12" and one(spark, text.node_id(F.lit("x"), F.lit(" "))) == "x:unknown"
    assert one(spark, text.fingerprint(F.lit(" a \n b "))) == one(spark, text.fingerprint(F.lit("a b"))) != one(spark, text.fingerprint(F.lit("A b")))
    assert one(spark, text.fingerprint(F.lit("a &amp; b"), escaped=True)) == one(spark, text.fingerprint(F.lit("a & b")))
    assert one(spark, text.fingerprint(F.lit(" "))) is None
    assert one(spark, text.relation_type(F.lit("Shares"))) == "repost" and one(spark, text.relation_type(F.lit("poke"))) is None


def test_relevance_and_reliability(spark):
    assert [one(spark, text.relevance(F.lit(t), F.lit("big news"))) for t in ("Big News!", "news", "none")] == ["lexical", "partial_lexical", "unknown"]
    assert one(spark, text.has_word(F.lit("a c++ b"), F.lit("C"))) and not one(spark, text.has_word(F.lit("abc"), F.lit("b")))
    assert one(spark, text.reliable(F.lit("these words are enough"))) and not one(spark, text.reliable(F.lit("#a @b http://x.org few words")))
    assert one(spark, text.clean_post(F.lit("a &amp;amp; b​"))) == "a & b" and one(spark, text.clean_post(F.lit("[removed]"))) is None


def test_times(spark):
    want = datetime(2024, 1, 2, 3, 4, 5)
    for v in ("1704164645", "1704164645000", "1704164645000-3", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05"):
        assert one(spark, times.to_timestamp_lenient(F.lit(v))) == want, v
    assert one(spark, times.to_timestamp_lenient(F.lit("soon"))) is None
    assert one(spark, times.zoned_timestamp(F.lit("2024-01-02T03:04:05"))) is None and one(spark, times.zoned_timestamp(F.lit("2024-01-02T05:04:05+02:00"))) == want
    assert one(spark, times.collector_time(F.lit("Tue Jan 02 03:04:05 +0000 2024"))) == want
    assert one(spark, times.epoch_seconds(F.lit("0"))) is None
    early, late = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")
    assert one(spark, times.hours_between(early, late)) == 24.0 and one(spark, times.hours_between(late, early)) is None and one(spark, times.age_hours(late, early)) == 0.0
    assert one(spark, times.day_label(early)) == "Jan 1"


def test_many_mentions_of_one_text_are_told_apart_in_proportion(spark):
    from time import monotonic

    names = [f"{'Re' if i % 3 else 'rE'}{i % 9_000}" for i in range(20_000)]
    first: dict = {}
    for n in names:
        first.setdefault(n.lower(), n)
    rows = spark.createDataFrame([(1, " ".join("@" + n for n in names)), (2, None), (3, "")], "id int, t string")
    begun = monotonic()
    got = {r["id"]: r["m"] for r in rows.select("id", text.mentions(F.col("t")).alias("m")).collect()}
    assert got == {1: list(first.values()), 2: None, 3: []}
    assert monotonic() - begun < 20  # looking through all names for each took minutes
    assert one(spark, text.distinct_folded(F.array(F.lit("B"), F.lit(None).cast("string"), F.lit("a"), F.lit("b"), F.lit("A")))) == ["B", "a"]
    assert one(spark, text.mentions(F.lit("@@a b@c (@d) @é @_e"))) == ["d", "_e"] and one(spark, text.collected_hashtags(F.lit("##a b#c (#d) #1 #éa #É-b #ÉA"))) == ["d", "éa", "É-b"]
