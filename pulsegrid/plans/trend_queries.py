"""Trend, ranking, forecast and distribution queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import numbers as N
from pulsegrid.functions import text as X
from pulsegrid.operators import distributions as D
from pulsegrid.operators import ranking as R
from pulsegrid.operators import rollups as U
from pulsegrid.operators import trend as T
from pulsegrid.plans.views import NOW, POSTS, SNAPSHOTS, jr, now, posts, snapshots
from pulsegrid.session import table

S = SparkSession
TS = f"TIMESTAMP '{NOW}'"
AGE = f"(epoch_us({TS}) - epoch_us(published_at)) / 3.6e9"

DYNAMICS = f"""
WITH {POSTS},
w(span, hours, half_life, bucket_h) AS (VALUES ('24h', 24, 4, 1), ('7d', 168, 24, 6), ('30d', 720, 72, 24)),
r AS (SELECT p.*, w.*, {AGE} AS age_h FROM posts p JOIN w ON p.published_at <= {TS} AND {AGE} <= w.hours),
a AS (SELECT *, INFLUENCE AS f, exp(-ln(2) / half_life * age_h) * INFLUENCE AS wt, min(published_at) OVER (PARTITION BY trend, span) AS t0 FROM r),
b AS (SELECT trend, span, bucket_h, CAST(floor((epoch_us(published_at) - epoch_us(t0)) / 3.6e9 / bucket_h) AS BIGINT) AS b, sum(interactions * wt) AS s, sum(wt) AS w, count(*) AS n, sum(f) AS f,
  sum(RATE) AS e, count(RATE) AS en FROM a GROUP BY 1, 2, 3, 4),
t AS (SELECT trend, span, bucket_h, CAST(sum(n) AS BIGINT) AS n, sum(s) AS total, max(s) AS most, sum(w) AS w, min(b) AS b0, max(b) AS b1, regr_slope(s, b * bucket_h) AS slope,
  arg_min(b, (-s, b)) AS top, sum(f) AS f, sum(e) AS e, sum(en) AS en FROM b GROUP BY 1, 2, 3),
m AS (SELECT trend, span, n AS post_count, CASE WHEN n >= 2 THEN total / greatest((b1 - b0) * bucket_h, bucket_h) ELSE 0 END AS v, CASE WHEN n >= 2 THEN {jr("coalesce(CASE WHEN isnan(slope) THEN NULL ELSE slope END, 0)", 4)} ELSE 0.0 END AS acceleration,
  CASE WHEN n >= 2 AND total > 0 THEN {jr("most / total", 4)} ELSE 0.0 END AS burst_score, CASE WHEN n >= 2 THEN top * bucket_h ELSE 0 END AS peak_bucket_hour,
  CASE WHEN n >= 2 AND w > 0 THEN {jr("total / w", 4)} ELSE 0.0 END AS weighted_mean, {jr("f / n", 4)} AS avg_influence, CASE WHEN en > 0 THEN {jr("e / en", 4)} END AS avg_engagement FROM t),
s AS (SELECT *, CASE WHEN post_count >= 2 THEN {jr('''0.35 * CASE WHEN v > 0 THEN least(1, log10(1 + v) / log10(11)) ELSE 0 END + 0.2 * burst_score + 0.15 * CASE WHEN acceleration > 0 THEN least(1, acceleration / 10) ELSE 0 END
  + 0.15 * CASE WHEN avg_engagement > 0 THEN least(1, avg_engagement / 0.1) ELSE 0 END + 0.15 * CASE WHEN avg_influence > 1 THEN least(1, (avg_influence - 1) / 3) ELSE 0 END''', 4)} ELSE 0.0 END AS virality_score FROM m)
SELECT trend, span, post_count, {jr("v", 4)} AS velocity, acceleration, burst_score, CAST(peak_bucket_hour AS BIGINT) AS peak_bucket_hour, weighted_mean, avg_influence, avg_engagement, virality_score,
  CASE WHEN virality_score <= 0.2 THEN 'dormant' WHEN virality_score <= 0.4 THEN 'emerging' WHEN virality_score <= 0.6 THEN 'trending' WHEN virality_score <= 0.8 THEN 'viral' ELSE 'mega_viral' END AS virality_tier,
  {jr("least(1, virality_score) * 100")} AS trend_score FROM s
"""


def trend_virality(spark: S, d: str) -> DataFrame:
    p = posts(spark, d).withColumns({"influence": F.lit(1.0), "engagement_rate": F.lit(None).cast("double")})
    return T.dynamics(p, now()).where(F.col("span") == "30d").drop("span", "avg_influence", "avg_engagement", "weighted_mean").orderBy(F.desc("trend_score"), "trend")


def trend_windows(spark: S, d: str) -> DataFrame:
    return T.dynamics(posts(spark, d), now())


def trend_growth(spark: S, d: str) -> DataFrame:
    return T.growth(posts(spark, d))


def trend_peak(spark: S, d: str) -> DataFrame:
    return T.peak(posts(spark, d))


def lifecycle(spark: S, d: str) -> DataFrame:
    return T.lifecycle(posts(spark, d), now())


def platform_activity(spark: S, d: str) -> DataFrame:
    return T.platform_activity(posts(spark, d))


def fastest_platform(spark: S, d: str) -> DataFrame:
    return T.fastest_platform(posts(spark, d))


def approximate_reach(spark: S, d: str) -> DataFrame:
    return T.reach(posts(spark, d))


def top_posts(spark: S, d: str) -> DataFrame:
    return T.top_posts(posts(spark, d), now())


def snapshot_metrics(spark: S, d: str) -> DataFrame:
    return D.snapshot_metrics(posts(spark, d), "trend")


def leaderboard(spark: S, d: str) -> DataFrame:
    return R.leaderboard(snapshots(spark, d), 3)


def percentiles(spark: S, d: str) -> DataFrame:
    return R.percentiles(snapshots(spark, d))


def score_movement(spark: S, d: str) -> DataFrame:
    return R.movement(snapshots(spark, d))


def momentum(spark: S, d: str) -> DataFrame:
    found = R.momentum(snapshots(spark, d))
    return found.select("trend", "captured_at", *[N.js_round(F.col(c), 4).alias(c) for c in ("d_velocity", "d_acceleration", "d_engagement", "d_virality")], "d_rank", "spread")


def forecast(spark: S, d: str) -> DataFrame:
    fastest = T.fastest_platform(posts(spark, d)).select("trend", "fastest_platform")  # a row a trend
    return R.forecast(snapshots(spark, d).join(fastest, "trend", "left"))


def smoothed_scores(spark: S, d: str) -> DataFrame:
    return R.smoothed(snapshots(spark, d))


def backtest(spark: S, d: str) -> DataFrame:
    return R.backtest(snapshots(spark, d))


def phase_classification(spark: S, d: str) -> DataFrame:
    return R.phases(snapshots(spark, d)).select("trend", "captured_at", "score", "phase")


def densified_ranks(spark: S, d: str) -> DataFrame:
    return R.densified(snapshots(spark, d).where("rank <= 3"))


def language_distribution(spark: S, d: str) -> DataFrame:
    return D.counts(table(spark, d, "documents"), "lang")


def language_by_source(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").cube("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def platform_shares(spark: S, d: str) -> DataFrame:
    return D.shares(posts(spark, d), "platform")


def age_histogram(spark: S, d: str) -> DataFrame:
    return D.age_histogram(table(spark, d, "orders"), "o_orderdate", F.lit("2001-09-01").cast("timestamp"))


def hashtag_cooccurrence(spark: S, d: str) -> DataFrame:
    return D.tag_pairs(table(spark, d, "documents").select("lang", X.hashtags(F.col("text")).alias("tags")), "tags", "lang")


def nearest_rank_latency(spark: S, d: str) -> DataFrame:
    return D.nearest_rank(posts(spark, d), "interactions", {"p50": 0.5, "p95": 0.95}, "trend")


def confusion_matrix(spark: S, d: str) -> DataFrame:
    return D.confusion(table(spark, d, "labels"), "quality", "toxic")


def rollup_grains(spark: S, d: str) -> DataFrame:
    found = U.merged_rollups(posts(spark, d), ["trend"], "published_at", "author_id", {"engagement": F.col("interactions")}, {"peak": F.col("interactions")}, "authors")
    average = N.js_round(F.col("engagement") / F.col("mentions"), 8)
    return found.withColumnRenamed("rows_", "mentions").select("trend", "granularity", "bucket_start", "mentions", "authors", N.js_round(F.col("engagement"), 4).alias("engagement"), average.alias("average"), "peak")


def rollup_platform(spark: S, d: str) -> DataFrame:
    by = D.rollups(posts(spark, d), {"1d": "1 day"}, "platform")
    total = F.sum("mentions").over(Window.partitionBy("trend", "bucket_start"))
    return by.select("trend", "bucket_start", "platform", "mentions", N.js_round(100.0 * F.col("mentions") / total, 2).alias("share"))


def sliding_window(spark: S, d: str) -> DataFrame:
    by = posts(spark, d).groupBy(F.window("published_at", "2 days", "1 day").alias("w"), "trend").agg(F.count(F.lit(1)).alias("posts"))
    return by.select(F.col("w.start").alias("bucket_start"), "trend", "posts")


def sessions(spark: S, d: str) -> DataFrame:
    by = posts(spark, d).groupBy("user_id", F.session_window("published_at", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("posts"))
    return by.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("posts").alias("longest"))


def top_per_platform(spark: S, d: str) -> DataFrame:
    return D.top_per_group(posts(spark, d).select("platform", "event_id", "interactions"), ["platform"], [F.desc("interactions"), "event_id"], 15)


def interest_timeline(spark: S, d: str) -> DataFrame:
    return D.interest_timeline(posts(spark, d).withColumn("at", F.struct("published_at", "event_id")), "trend", "at", "interactions")


def trending_labels(spark: S, d: str) -> DataFrame:
    by = posts(spark, d).groupBy("trend").agg(F.sum("likes").alias("score"))
    return D.kept_by_share(by, "score", "trend", 2, 0.55)


def first_names(spark: S, d: str) -> DataFrame:
    return D.first_folded(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 10)


def dataset_profile(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), N.js_round(F.avg(F.length("text")), 2).alias("avg_chars"))


PHASE = f"""WITH {SNAPSHOTS}, f AS (SELECT *, count(*) OVER w AS n, first_value(score) OVER w AS a, last_value(score) OVER w AS z FROM snapshots
 WINDOW w AS (PARTITION BY trend ORDER BY captured_at ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT trend, captured_at, score, CASE WHEN n < 2 THEN 'new' WHEN z > a THEN 'rising' WHEN z < a THEN 'decaying' ELSE 'peaking' END AS phase FROM f"""

ORD = "CASE {} WHEN 'dormant' THEN 0 WHEN 'emerging' THEN 1 WHEN 'trending' THEN 2 WHEN 'viral' THEN 3 WHEN 'mega_viral' THEN 4 ELSE -1 END"
LAG = "lag({0}) OVER (PARTITION BY trend ORDER BY captured_at)"


def _delta(c: str) -> str:
    return f"coalesce({c} - {LAG.format(c)}, 0)"


MOMENTUM = f"""m AS (SELECT *, {_delta("velocity")} AS d_velocity, {_delta("acceleration")} AS d_acceleration, {_delta("engagement")} AS d_engagement, {_delta("virality")} AS d_virality,
  coalesce({LAG.format("rank")} - rank, 0) AS d_rank, platforms > coalesce({LAG.format("platforms")}, platforms) AS spread FROM snapshots)"""

FORECAST = f"""WITH {SNAPSHOTS}, {MOMENTUM},
c AS (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY captured_at DESC) AS rn, count(*) OVER (PARTITION BY trend) AS history FROM m),
h AS (SELECT trend, arg_max(score, captured_at) AS s0, arg_min(score, captured_at) AS s2, (epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 3.6e9 AS hrs, count(*) AS n FROM c WHERE rn <= 3 GROUP BY 1),
r AS (SELECT c.*, CASE WHEN h.n >= 2 AND hrs > 0 THEN (s0 - s2) / hrs ELSE 0.0 END AS rate FROM c JOIN h USING (trend) WHERE rn = 1),
s AS (SELECT *, {jr('''(0.25 * (greatest(-10, least(10, d_velocity)) + 10) / 20 + 0.2 * (greatest(-5, least(5, d_acceleration)) + 5) / 10 + 0.15 * greatest(0, least(100, burst)) / 100 + 0.15 * greatest(0, least(1000, d_engagement)) / 1000
  + 0.1 * greatest(0, least(1, d_virality)) + 0.1 * greatest(0, least(10, d_rank)) / 10 + 0.05 * CASE WHEN spread THEN 1 ELSE 0 END) * 100''')} AS fs FROM r),
b AS (SELECT *, greatest(0.0, least(100.0, 0.5 * fs + CASE WHEN d_acceleration > 0 THEN 20 ELSE 0 END + CASE WHEN d_acceleration > 2 THEN 10 ELSE 0 END + CASE WHEN d_velocity > 0 THEN 10 ELSE 0 END
  + CASE WHEN d_engagement > 100 THEN 10 ELSE 0 END + CASE WHEN spread THEN 10 ELSE 0 END)) AS chance FROM s),
z AS (SELECT *, {jr("chance")} AS breakout FROM b), f1 AS (SELECT trend, platform, {jr("avg(interactions / velocity_window)", 6)} AS v, min((published_at, event_id)) AS f FROM posts GROUP BY 1, 2),
f2 AS (SELECT trend, arg_min(platform, (-v, f)) AS fastest FROM f1 GROUP BY 1)
SELECT trend, score, fs AS forecast_score, breakout, CASE WHEN chance >= 80 AND d_acceleration > 0 THEN 'breakout' WHEN fs >= 70 AND d_velocity > 0 THEN 'strongly_rising' WHEN fs >= 50 AND d_velocity > 0 THEN 'rising'
  WHEN d_velocity < 0 AND d_acceleration < 0 AND score > 70 THEN 'weakening' WHEN d_velocity < 0 AND d_acceleration < 0 THEN 'declining' ELSE 'stable' END AS direction,
  {", ".join(f"CASE WHEN history >= 2 THEN {jr(f'greatest(0, least(100, score + rate * (fs / 50) * {h}))')} END AS h{h}" for h in (6, 12, 24))},
  CASE WHEN history >= 2 AND rate > 0 AND {jr("(100 - score) / nullif(rate, 0)")} <= 72 THEN {jr("(100 - score) / nullif(rate, 0)")} END AS hours_to_peak, {jr("breakout * 0.9")} AS growth_6h, {jr("breakout * 0.8")} AS growth_24h,
  100 - {jr("breakout * 0.9")} AS decline_6h, 100 - {jr("breakout * 0.8")} AS decline_24h, CASE WHEN spread AND platforms > 1 THEN CASE fastest WHEN 'x' THEN 'telegram' ELSE 'reddit' END END AS next_platform, CASE WHEN spread AND platforms > 1 THEN 45 END AS spread_minutes,
  CASE WHEN history < 2 THEN 'insufficient_data' WHEN history < 5 THEN 'low' WHEN history < 10 THEN 'medium' ELSE 'high' END AS confidence FROM z LEFT JOIN f2 USING (trend)"""

PLAIN = DYNAMICS.replace("INFLUENCE", "1.0").replace("RATE", "CAST(NULL AS DOUBLE)")
GRAIN = "make_timestamp(CAST(floor(epoch_us(published_at) / (h * 3.6e9)) * (h * 3600000000) AS BIGINT))"

QUERIES = {
    "trend_virality": (trend_virality, f"SELECT trend, post_count, velocity, acceleration, burst_score, peak_bucket_hour, virality_score, virality_tier, trend_score FROM ({PLAIN}) WHERE span = '30d'"),
    "trend_windows": (trend_windows, DYNAMICS.replace("INFLUENCE", "influence").replace("RATE", "engagement_rate")),
    "trend_growth": (trend_growth, f"""WITH {POSTS}, h AS (SELECT trend, interactions AS i, row_number() OVER (PARTITION BY trend ORDER BY published_at, event_id) <= count(*) OVER (PARTITION BY trend) // 2 AS f FROM posts),
      s AS (SELECT trend, count(*) AS n, sum(CASE WHEN f THEN i ELSE 0 END) AS a, sum(CASE WHEN f THEN 0 ELSE i END) AS b FROM h GROUP BY 1)
      SELECT trend, {jr("a", 4)} AS first_half, {jr("b", 4)} AS second_half, CASE WHEN n < 2 THEN '+0%' WHEN a = 0 AND b > 0 THEN '+∞%' WHEN a = 0 THEN '+0%'
      ELSE CASE WHEN floor((b - a) / a * 100 + 0.5) >= 0 THEN '+' ELSE '' END || CAST(floor((b - a) / a * 100 + 0.5) AS BIGINT) || '%' END AS growth FROM s"""),
    "trend_peak": (trend_peak, f"""WITH {POSTS}, r AS (SELECT *, min(published_at) OVER (PARTITION BY trend) AS t0 FROM posts),
      b AS (SELECT trend, t0, CAST(floor((epoch_us(published_at) - epoch_us(t0)) / 3.6e9 / 6) AS BIGINT) AS b, sum(interactions) AS s FROM r GROUP BY 1, 2, 3),
      m AS (SELECT trend, t0, arg_min(b, (-s, b)) AS b, max(s) AS s, avg(s) AS mean FROM b GROUP BY 1, 2)
      SELECT trend, strftime(t0 + to_hours(b * 6), '%b %-d') AS peak_date, '+' || CAST(floor((s - mean) / mean * 100 + 0.5) AS BIGINT) || '%' AS peak_growth FROM m"""),
    "lifecycle": (lifecycle, f"""WITH {POSTS}, w(span, hours, bh) AS (VALUES ('24h', 24, 1), ('7d', 168, 6), ('30d', 720, 24)),
      r AS (SELECT trend, span, hours, bh, interactions, CAST(least(hours / bh - 1, greatest(0, floor((epoch_us(published_at) - (epoch_us({TS}) - hours * 3600000000)) / 3.6e9 / bh))) AS BIGINT) AS bucket
        FROM posts JOIN w ON published_at <= {TS} AND {AGE} <= hours),
      s AS (SELECT trend, span, hours, bh, bucket, count(*) AS posts, sum(interactions) AS i FROM r GROUP BY 1, 2, 3, 4, 5),
      g AS (SELECT trend, span, hours, bh, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM s GROUP BY 1, 2, 3, 4)
      SELECT g.trend, g.span, g.bucket, {TS} - to_hours(g.hours) + to_hours(CAST(g.bucket * g.bh AS INTEGER)) AS bucket_start, coalesce(posts, 0) AS posts, {jr("coalesce(i, 0)", 4)} AS interactions
      FROM g LEFT JOIN s USING (trend, span, bucket)"""),
    "platform_activity": (platform_activity, f"WITH {POSTS} SELECT platform, count(*) AS posts, {jr('sum(interactions)', 4)} AS interactions, {jr('avg(engagement_rate)', 4)} AS avg_engagement_rate FROM posts GROUP BY 1"),
    "fastest_platform": (fastest_platform, f"""WITH {POSTS}, b AS (SELECT trend, platform, {jr("avg(interactions / velocity_window)", 6)} AS v, min((published_at, event_id)) AS f FROM posts GROUP BY 1, 2)
      SELECT trend, arg_min(platform, (-v, f)) AS fastest_platform, max(v) AS speed FROM b GROUP BY 1"""),
    "approximate_reach": (approximate_reach, f"""WITH {POSTS}, t AS (SELECT trend, sum(reach) AS x FROM posts GROUP BY 1), u AS (SELECT trend, CASE WHEN x >= 1e9 THEN 'B' WHEN x >= 1e6 THEN 'M' WHEN x >= 1e3 THEN 'K' ELSE '' END AS m,
      CASE WHEN x >= 1e9 THEN floor(x / 1e9 * 10 + 0.5) / 10 WHEN x >= 1e6 THEN floor(x / 1e6 * 10 + 0.5) / 10 WHEN x >= 1e3 THEN floor(x / 1e3 * 10 + 0.5) / 10 ELSE floor(x + 0.5) END AS v FROM t)
      SELECT trend, CASE WHEN v = 0 THEN 'Unknown' ELSE regexp_replace(CAST(v AS VARCHAR), '\\.0$', '') || m END AS approximate_reach FROM u"""),
    "top_posts": (top_posts, f"""WITH {POSTS}, w(span, hours) AS (VALUES ('24h', 24), ('7d', 168), ('30d', 720)), r AS (SELECT span, event_id, user_id, influence, row_number() OVER (PARTITION BY span ORDER BY influence DESC, event_id) AS place
      FROM posts JOIN w ON published_at <= {TS} AND {AGE} <= hours) SELECT span, place, event_id, user_id, influence FROM r WHERE place <= 5"""),
    "snapshot_metrics": (snapshot_metrics, f"""WITH {POSTS} SELECT trend, count(*) AS posts, count(DISTINCT platform || ':' || author_id) AS authors, CAST(sum(CASE WHEN platform = 'reddit' THEN coalesce(likes, score) ELSE likes END) AS BIGINT) AS likes,
      CAST(sum(replies) AS BIGINT) AS replies, CAST(sum(reposts) AS BIGINT) AS reposts, CAST(coalesce(sum(quotes), 0) AS BIGINT) AS quotes, CAST(sum(views) AS BIGINT) AS views, max(published_at) AS newest FROM posts GROUP BY 1"""),
    "leaderboard": (leaderboard, f"""WITH {SNAPSHOTS}, n AS (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY captured_at DESC) AS rn FROM snapshots)
      SELECT trend, score, row_number() OVER (ORDER BY score DESC, trend DESC) AS position FROM n WHERE rn = 1 QUALIFY position <= 3"""),
    "percentiles": (percentiles, f"""WITH {SNAPSHOTS}, n AS (SELECT trend, score, row_number() OVER (PARTITION BY trend ORDER BY captured_at DESC) AS rn FROM snapshots), r AS (SELECT trend, score, row_number() OVER (ORDER BY score, trend) - 1 AS rank, count(*) OVER () AS t FROM n WHERE rn = 1)
      SELECT trend, score, rank, t - rank AS position, {jr("rank / t * 100")} AS percentile FROM r"""),
    "score_movement": (score_movement, f"""WITH {SNAPSHOTS}, m AS (SELECT *, {LAG.format("score")} AS ps, {LAG.format("tier")} AS pt FROM snapshots) SELECT trend, captured_at, score, tier, score - ps AS score_delta,
      CASE WHEN pt IS NULL OR pt = tier THEN 'stable' WHEN {ORD.format("tier")} > {ORD.format("pt")} THEN 'rising' ELSE 'falling' END AS tier_movement FROM m"""),
    "momentum": (momentum, f"WITH {SNAPSHOTS}, {MOMENTUM} SELECT trend, captured_at, {", ".join(f"{jr(c, 4)} AS {c}" for c in ("d_velocity", "d_acceleration", "d_engagement", "d_virality"))}, d_rank, spread FROM m"),
    "forecast": (forecast, FORECAST),
    "smoothed_scores": (smoothed_scores, f"""WITH {SNAPSHOTS}, c AS (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY captured_at DESC) AS rn FROM snapshots), l AS (SELECT trend, list(score ORDER BY captured_at) AS s FROM c WHERE rn <= 20 GROUP BY 1)
      SELECT trend, {jr("list_reduce(s, lambda a, x: a * 0.7 + x * 0.3)", 4)} AS ema FROM l"""),
    "backtest": (backtest, f"""WITH {SNAPSHOTS}, b AS (SELECT trend, score > lag(score, 24) OVER (PARTITION BY trend ORDER BY captured_at) AS rose FROM snapshots)
      SELECT trend, count(*) AS compared, count(*) FILTER (WHERE rose) AS rising, {jr("avg(CASE WHEN rose THEN 1.0 ELSE 0.0 END)", 4)} AS share FROM b WHERE rose IS NOT NULL GROUP BY 1"""),
    "phase_classification": (phase_classification, PHASE),
    "densified_ranks": (densified_ranks, f"""WITH {SNAPSHOTS}, b AS (SELECT * FROM snapshots WHERE rank <= 3), s AS (SELECT * FROM (SELECT DISTINCT trend FROM b), (SELECT DISTINCT captured_at FROM b))
      SELECT trend, captured_at, rank, CASE WHEN coalesce(rank, 0) = 0 THEN 0.0 ELSE {jr("(16 - rank) * 6.67")} END AS chart_score FROM s LEFT JOIN b USING (trend, captured_at)"""),
    "language_distribution": (language_distribution, "SELECT lang, count(*) AS n FROM documents GROUP BY 1"),
    "language_by_source": (language_by_source, "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY CUBE (source, lang)"),
    "platform_shares": (platform_shares, f"""WITH {POSTS}, n AS (SELECT platform, count(*) AS n FROM posts GROUP BY 1), p AS (SELECT *, CAST({jr("100.0 * n / sum(n) OVER ()")} AS BIGINT) AS s, row_number() OVER (ORDER BY n DESC, platform) AS r FROM n)
      SELECT platform, n, CAST(CASE WHEN r = 1 THEN s + 100 - sum(s) OVER () ELSE s END AS BIGINT) AS share FROM p"""),
    "age_histogram": (age_histogram, """WITH y AS (SELECT (epoch_us(TIMESTAMP '2001-09-01') - epoch_us(o_orderdate)) / (365.25 * 86400000000) AS y FROM orders WHERE o_orderdate IS NOT NULL),
      c AS (SELECT CASE WHEN y < 0.5 THEN '<6m' WHEN y < 1 THEN '6m-1y' WHEN y < 3 THEN '1-3y' WHEN y < 5 THEN '3-5y' ELSE '5y+' END AS age, count(*) AS n FROM y GROUP BY 1),
      s(ord, age) AS (VALUES (0, '<6m'), (1, '6m-1y'), (2, '1-3y'), (3, '3-5y'), (4, '5y+')) SELECT CAST(ord AS INTEGER) AS ord, age, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (age)"""),
    "hashtag_cooccurrence": (hashtag_cooccurrence, """WITH t AS (SELECT doc_id, lang, unnest(list_distinct(list_transform(regexp_extract_all(text, '#[\\p{L}\\p{N}_]+'), lambda x: lower(x)))) AS t FROM documents)
      SELECT a.lang, a.t AS tag_a, b.t AS tag_b, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.t < b.t GROUP BY 1, 2, 3"""),
    "nearest_rank_latency": (nearest_rank_latency, f"""WITH {POSTS}, r AS (SELECT trend, interactions AS x, row_number() OVER (PARTITION BY trend ORDER BY interactions) - 1 AS r, count(*) OVER (PARTITION BY trend) AS n FROM posts)
      SELECT trend, count(*) AS n, {jr("avg(x)", 4)} AS mean, min(x) AS min, max(x) AS max, max(CASE WHEN r = least(floor(n * 0.5), n - 1) THEN x END) AS p50, max(CASE WHEN r = least(floor(n * 0.95), n - 1) THEN x END) AS p95 FROM r GROUP BY 1"""),
    "confusion_matrix": (confusion_matrix, "SELECT quality AS expected, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2"),
    "rollup_grains": (rollup_grains, f"""WITH {POSTS}, g(granularity, h) AS (VALUES ('6h', 6), ('1d', 24), ('7d', 168), ('30d', 720)) SELECT trend, granularity, {GRAIN} AS bucket_start, count(*) AS mentions, count(DISTINCT author_id) AS authors,
      {jr("sum(interactions)", 4)} AS engagement, {jr("avg(interactions)", 8)} AS average, max(interactions) AS peak FROM posts, g GROUP BY 1, 2, 3"""),
    "rollup_platform": (rollup_platform, f"""WITH {POSTS}, b AS (SELECT trend, date_trunc('day', published_at) AS bucket_start, platform, count(*) AS mentions FROM posts GROUP BY 1, 2, 3)
      SELECT *, {jr("100.0 * mentions / sum(mentions) OVER (PARTITION BY trend, bucket_start)", 2)} AS share FROM b"""),
    "sliding_window": (sliding_window, f"""WITH {POSTS}, b AS (SELECT trend, date_trunc('day', published_at) AS d FROM posts), x AS (SELECT trend, d AS bucket_start FROM b UNION ALL SELECT trend, d - INTERVAL 1 DAY FROM b)
      SELECT bucket_start, trend, count(*) AS posts FROM x GROUP BY 1, 2"""),
    "sessions": (sessions, f"""WITH {POSTS}, g AS (SELECT user_id, published_at, event_id, CASE WHEN published_at - lag(published_at) OVER (PARTITION BY user_id ORDER BY published_at, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM posts),
      n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY published_at, event_id) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM n GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1"""),
    "top_per_platform": (top_per_platform, f"WITH {POSTS} SELECT platform, event_id, interactions, row_number() OVER (PARTITION BY platform ORDER BY interactions DESC, event_id) AS place FROM posts QUALIFY place <= 15"),
    "interest_timeline": (interest_timeline, f"WITH {POSTS} SELECT trend, {jr('avg(interactions)', 2)} AS average, arg_max(interactions, (published_at, event_id)) AS latest, max(interactions) AS highest, min(interactions) AS lowest FROM posts GROUP BY 1"),
    "trending_labels": (trending_labels, f"WITH {POSTS}, s AS (SELECT trend, CAST(sum(likes) AS BIGINT) AS score FROM posts GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, trend) AS r, count(*) OVER () AS n FROM s) SELECT trend, score FROM n WHERE r <= greatest(2, floor(n * 0.55 + 0.5))"),
    "first_names": (first_names, "WITH f AS (SELECT arg_min(p_brand, p_partkey) AS p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY lower(trim(p_brand))) SELECT * FROM f ORDER BY p_partkey LIMIT 10"),
    "dataset_profile": (dataset_profile, f"SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, {jr('avg(length(text))', 2)} AS avg_chars FROM conversations GROUP BY 1"),
}
