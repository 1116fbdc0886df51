"""All-or-nothing commits of a collection over several tables, without a transactional format.

Each table of a collection is staged below its own folder, under the commit's id; then one manifest row, a single file
that becomes visible by one rename, makes all of them visible together. Readers take only stages that the manifest
names, so stages of failed or running collections stay invisible, whatever of them was written. A retry of an
unfinished id replaces its stages; a retry of a committed one changes nothing.

The manifest has a row a commit. A commit may hold some tables whole, as a compaction does: readers of such a table
start with it. Stages are partitions of the tables, so what the manifest leaves out is never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.sinks import merge_latest

MANIFEST = "_commits"
SCHEMA = "commit_id string, sequence long, tables array<string>, whole array<string>"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(commit_id, sequence, tables, whole) of the visible commits, one row each."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{root}/{MANIFEST}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def stage(root: str, commit_id: str, table: str, rows: DataFrame) -> None:
    """Write one table of a collection; invisible until the commit."""
    rows.write.mode("overwrite").parquet(f"{root}/{table}/commit_id={commit_id}")


def publish(spark: SparkSession, root: str, commit_id: str, tables: list[str], whole: list[str] | None = None) -> None:
    """Make the stages of these tables visible together. One writer commits at a time; the sequence tells the order."""
    last = manifest(spark, root).agg(F.max("sequence").alias("s")).first()["s"]
    row = spark.createDataFrame([(commit_id, 0 if last is None else last + 1, sorted(tables), sorted(whole or []))], SCHEMA)
    row.coalesce(1).write.mode("error").parquet(f"{root}/{MANIFEST}/{commit_id}")


def commit(spark: SparkSession, root: str, commit_id: str, tables: dict[str, DataFrame], whole: list[str] | None = None) -> bool:
    """Stage all tables and publish them; False where this id is visible already."""
    if manifest(spark, root).where(F.col("commit_id") == commit_id).limit(1).count():
        return False
    for table, rows in tables.items():
        stage(root, commit_id, table, rows)
    publish(spark, root, commit_id, list(tables), whole)
    return True


def read(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """The visible rows of a table with the sequence of their commit."""
    seen = manifest(spark, root).where(F.array_contains("tables", table))
    start = seen.agg(F.max(F.when(F.array_contains("whole", table), F.col("sequence"))).alias("s")).first()["s"]
    visible = seen.where(F.col("sequence") >= (start or 0)).select("commit_id", "sequence")
    if not visible.limit(1).count():
        return spark.createDataFrame([], f"{schema}, sequence long")
    rows = spark.read.schema(f"{schema}, commit_id string").option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    return rows.join(F.broadcast(visible), "commit_id").drop("commit_id")  # a row a commit since the last compaction


def compact(spark: SparkSession, root: str, commit_id: str, table: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> bool:
    """Replace all stages of a table, for readers, by one that merge makes of them."""
    return commit(spark, root, commit_id, {table: merge(read(spark, root, table, schema)).drop("sequence")}, [table])


def upsert_events(rows: DataFrame) -> DataFrame:
    """One row for each (platform, event_id) of rows (…, observed_at): counters from the newest observation, even where
    it is smaller or null; text and metadata the newest known value. Equal times: the larger row decides."""
    keys = ["platform", "event_id"]
    plain = [c for c in rows.columns if c not in {*keys, "observed_at"}]
    return merge_latest(rows.withColumn("tie", F.struct(*plain)), keys, "observed_at", ("likes", "replies", "reposts", "quotes", "views"), "tie").drop("tie")


def latest_snapshots(rows: DataFrame, order: str = "sequence") -> DataFrame:
    """One row for each (trend, captured_at), the latest whole row by order; of equal ones the larger."""
    keys = ["trend", "captured_at"]
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
