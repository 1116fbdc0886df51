"""An incremental registry of scores with order statistics.

Scores are kept in a log of observations and in counts by score bucket, both under atomic commits. A batch of
observations changes the counts of the buckets that its members leave and enter, nothing else. A member's place is the
number of scores in lower buckets, read from sums over a tree of buckets whose nodes have 65,536 children at most, plus its place
among the members of its own bucket; so only the asked buckets' rows are looked at, and no window runs over all members.
A bucket that very many share (a score of 0) is not sorted in one task: places within it are offsets of range partitions.

Order: by score, then by name, ascending; a null or NaN score takes no part. An observation that is older than the
member's last one is kept as history but moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import js_round, tier_order
from pulsegrid.operators.commits import commit, compact, read
from pulsegrid.session import checkpoint_folder

#: Buckets of one unit of score; bits of a level of the bucket tree; observations kept of a member.
BUCKETS, BITS, HISTORY = 100, 16, 100
OBSERVED = "member string, score double, tier string, captured_at timestamp"
COUNTS = "bucket long, n long"


def bucket_of(score: Column) -> Column:
    """Rises with the score."""
    return F.floor(score * BUCKETS).cast("long")


def row_numbers(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's place from 1 within its group by ascending order, without sorting a group in one task: rows are
    sorted in range partitions, and a partition's places start behind the rows of its group in those before it."""
    checkpoint_folder(rows.sparkSession)
    keys = [*by, *order]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = sorted_.withColumns({"p_": F.spark_partition_id(), "i_": F.monotonically_increasing_id()}).checkpoint()
    groups = numbered.groupBy(*by, "p_").agg(F.min("i_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = groups.select(*[F.col(c).alias(f"g_{c}") for c in by], F.col("p_").alias("g_p"), "first_", before.alias("before_"))
    same = F.col("p_") == F.col("g_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    placed = numbered.join(offsets, same).withColumn(name, F.col("i_") - F.col("first_") + F.col("before_") + 1)
    return placed.select(*rows.columns, name)


def latest(observed: DataFrame) -> DataFrame:
    """(member, score, tier, captured_at) of each member's last observation; of equal times the larger."""
    last = observed.groupBy("member").agg(F.max(F.struct("captured_at", "score", "tier")).alias("o"))
    return last.select("member", "o.score", "o.tier", "o.captured_at")


def scored(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("member").isNotNull() & F.col("captured_at").isNotNull())


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket, n): what members that went from one table (member, score) to the other change in the counts."""
    moved = before.select(bucket_of(F.col("score")).alias("bucket"), F.lit(-1).alias("d")).unionByName(after.select(bucket_of(F.col("score")).alias("bucket"), F.lit(1).alias("d")))
    return moved.groupBy("bucket").agg(F.sum("d").cast("long").alias("n")).where("n <> 0")


def record(spark: SparkSession, root: str, batch_id: str, batch: DataFrame) -> bool:
    """Add a batch of observations (member, score, tier, captured_at); a batch id that is there already changes nothing."""
    new = scored(batch).select("member", F.col("score").cast("double"), "tier", "captured_at")
    log = read(spark, root, "observed", OBSERVED).drop("sequence")
    before = latest(log.join(new.select("member").distinct(), "member", "left_semi"))
    after = latest(before.unionByName(new))
    return commit(spark, root, batch_id, {"observed": new, "counts": changes(before, after)})


def counts(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, n) of the members' last scores."""
    return read(spark, root, "counts", COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 0")


def below(by: DataFrame, asked: DataFrame) -> DataFrame:
    """(bucket, below) of the asked buckets: how many lie in lower ones. Level by level of the tree, a node's lower
    siblings are summed: at most 65,536 rows under one parent."""
    nodes, sums = asked.select("bucket").distinct(), None
    for shift in range(0, 64, BITS):
        parent = F.shiftright("node", BITS) if shift + BITS < 64 else F.lit(0)
        level = by.groupBy(F.shiftright("bucket", shift).alias("node")).agg(F.sum("n").alias("n"))
        lower = F.sum("n").over(Window.partitionBy(parent).orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
        found = level.select("node", F.coalesce(lower, F.lit(0)).alias("lower"))
        own = nodes.withColumn("node", F.shiftright("bucket", shift)).join(found, "node").select("bucket", "lower")
        sums = own if sums is None else sums.unionByName(own)
    return sums.groupBy("bucket").agg(F.sum("lower").alias("below"))


def standings(members: DataFrame, by: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(member, score, rank: from 0, lowest first; position: from 1, highest first; percentile) of the asked members.

    members: (member, score) of all; by: (bucket, n), their counts. Only members of the asked ones' buckets are ordered."""
    placed = members.select("member", "score", bucket_of(F.col("score")).alias("bucket"))
    wanted = None if asked is None else asked.select("member").distinct()
    own = placed if wanted is None else placed.join(placed.join(wanted, "member", "left_semi").select("bucket").distinct(), "bucket", "left_semi")
    within = row_numbers(own, ["bucket"], ["score", "member"], "place")
    if wanted is not None:
        within = within.join(wanted, "member", "left_semi")
    total = by.agg(F.sum("n").alias("total"))
    ranked = within.join(below(by, within), "bucket").withColumn("rank", F.col("below") + F.col("place") - 1).crossJoin(F.broadcast(total))  # one row
    return ranked.select("member", "score", "rank", (F.col("total") - F.col("rank")).alias("position"), js_round(F.col("rank") / F.col("total") * 100).alias("percentile"), "total")


def movements(observed: DataFrame) -> DataFrame:
    """(member, score_delta, tier_movement) of each member's last observation against the one before: the delta is null
    and the movement stable where there is none; a change between tiers is rising or falling, unknown ones below all."""
    newest = Window.partitionBy("member").orderBy(F.desc("captured_at"), F.desc("score"), F.desc("tier"))
    last = observed.withColumn("place_", F.row_number().over(newest)).where("place_ <= 2")  # the shuffle gets two rows a member and task
    two = last.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("captured_at", "score", "tier")), False).alias("o"))
    now, then = F.get("o", 0), F.get("o", 1)
    moved = F.when(then.isNull() | now["tier"].eqNullSafe(then["tier"]), "stable").when(tier_order(now["tier"]) > tier_order(then["tier"]), "rising").otherwise("falling")
    return two.select("member", (now["score"] - then["score"]).alias("score_delta"), moved.alias("tier_movement"))


def enrich(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """The asked members' standings with score_delta and tier_movement, as the registry stands."""
    log = read(spark, root, "observed", OBSERVED).drop("sequence")
    found = standings(latest(log), counts(spark, root), asked)
    own = log.join(asked.select("member").distinct(), "member", "left_semi")
    return found.join(movements(own), "member")


def history(spark: SparkSession, root: str, asked: DataFrame, most: int = 10) -> DataFrame:
    """(member, place from 1, score, tier, captured_at): the asked members' newest observations, newest first."""
    own = read(spark, root, "observed", OBSERVED).drop("sequence").join(asked.select("member").distinct(), "member", "left_semi")
    newest = Window.partitionBy("member").orderBy(F.desc("captured_at"), F.desc("score"), F.desc("tier"))
    return own.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most).select("member", "place", "score", "tier", "captured_at")


def trim(spark: SparkSession, root: str, batch_id: str, most: int = HISTORY) -> None:
    """Rewrite the log with the newest observations of each member, and the counts with a row a bucket. Ranks stay."""
    newest = Window.partitionBy("member").orderBy(F.desc("captured_at"), F.desc("score"), F.desc("tier"))
    compact(spark, root, f"{batch_id}-observed", "observed", OBSERVED, lambda rows: rows.withColumn("place_", F.row_number().over(newest)).where(F.col("place_") <= most).drop("place_"))
    compact(spark, root, f"{batch_id}-counts", "counts", COUNTS, lambda rows: rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("sequence").alias("sequence")).where("n <> 0"))
