"""Session factory and table access."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", app: str = "pulsegrid", **conf: str) -> SparkSession:
    """A session with the engine's settings; on a cluster pass the cluster's master and own conf."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder of checkpoints to the cluster's shared one, spark.checkpoint.dir. Only a local session without
    it gets a temporary folder."""
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pulsegrid-")
    spark.sparkContext.setCheckpointDir(shared)


def stored(rows: DataFrame) -> DataFrame:
    """The rows written once under the folder of checkpoints and read again, for loops. A checkpoint keeps the estimated
    size of its plan, and joins multiply sizes: in a loop the estimate's digits double each round, and planning with them."""
    spark = rows.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, any path that Spark can read; times without a zone are UTC."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"}
    return rows.withColumns(naive) if naive else rows
