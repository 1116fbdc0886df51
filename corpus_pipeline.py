"""Corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents.

Nulls: a null text is empty (it is never toxic for being so, a duplicate of nothing, and never mixed in); a null id, source
or language is kept as it is. Repeated rows and ties: of rows alike in id and text one stays, of near-duplicates the one with
the smallest id; equal rows share a decision of the mix. Very long texts are read whole by every stage. Empty tables give
empty tables of the same columns; without labels of both kinds no document is toxic unless all labelled ones are. Further
columns, whatever their names, are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, neardup, packing, secrets, toxicity
from pulsegrid.llm.shared import WORD, documents, materialize, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples nearest to them do not mark as toxic."""
    model = toxicity.fit(docs.select("doc_id", "text"), documents(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxic_predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id: five-word shingles, 0.8 or more. Rows are
    told apart by id and text, so an unlike text under the same id stays; of rows alike in both, one stays. Texts
    without words are no duplicates of anything."""
    found = neardup.near_duplicates(docs.select("doc_id", "text"), 5, (8, 10))
    gone = found.where("not leader").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    text = text_or_empty()
    rows = docs.select(*COLUMNS, F.sha2(text, 256).alias("text_key"))
    left = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left_anti")
    alone = F.when(text.rlike(WORD), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    # the join has dealt the rows by id and text already
    return left.withColumn("alone", alone).dropDuplicates(["doc_id", "text_key", "alone"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets found in their texts are replaced by a mark, and n_chars follows."""
    found, _ = secrets.scan_versions(docs.select(*COLUMNS))
    text = secrets.redact(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document that is taken several times comes as often."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packing.pack_documents(docs.select("doc_id", "text"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained scores, sketches and seeded choices are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
