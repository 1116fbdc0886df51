"""Token-id files with bit-plane shuffling.

Documents are range-partitioned and sorted by id; each task encodes its texts and writes frames. A frame holds the
ids of whole documents, cut into blocks of a fixed number of ids; each block is transposed into byte or bit planes
(plane k has byte k, or bit k, of every id), each plane is compressed with zstandard, and the frame's chunk index
stores every block's first id, number of ids and plane sizes, so that a reader can open any block alone. Frames are
rows of Parquet files that Spark commits, so a lost executor's attempt leaves nothing behind.

Nulls: a null text is empty (its document has the end id alone); null ids come first. Rows that repeat an id keep
their own entries, in the order of a hash of their texts (so ranges may part them). Very long texts make a frame of their own, in as many blocks as they need. An
empty table writes no frame. Other columns of the input are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import arrow_rows, documents, new_path, release, text_or_empty
from pulsegrid.llm.wordcode import encoder

TOKENIZER, END = "byte_bpe_50k.json", 0
BLOCK, FRAME = 65_536, 262_144
#: Words kept by a task, about.
WORDS = 800_000
FRAME_SCHEMA = "part int, frame int, base long, n_ids long, doc_ids array<long>, doc_lengths array<long>, planes string, first array<long>, n array<int>, sizes array<int>, payload binary"
ENTRY_SCHEMA = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def shuffle_planes(block: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def join_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    if planes == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_frame(ids: np.ndarray, planes: str, block: int, level: int = 3) -> dict:
    pack = zstandard.ZstdCompressor(level=level)
    first = list(range(0, len(ids), block))
    chunks = [[pack.compress(p) for p in shuffle_planes(ids[at : at + block], planes)] for at in first]
    return {
        "planes": planes, "first": first, "n": [min(block, len(ids) - at) for at in first],
        "sizes": [len(p) for c in chunks for p in c], "payload": b"".join(p for c in chunks for p in c),
    }


def unpack_frame(planes: str, n: list[int], sizes: list[int], payload: bytes) -> np.ndarray:
    """All ids of a frame, block after block as its chunk index says."""
    unpack, width, at, out = zstandard.ZstdDecompressor(), 4 if planes == "byte" else 32, 0, []
    for k, count in enumerate(n):
        parts = []
        for size in sizes[k * width : (k + 1) * width]:
            parts.append(unpack.decompress(payload[at : at + size]))
            at += size
        out.append(join_planes(parts, count, planes))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, planes: str = "byte", block: int = BLOCK, frame: int = FRAME) -> None:
    """Write (doc_id, text) rows as token files, in ascending doc_id order over parts, frames and documents."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, tail, part = encoder(tokenizer, WORDS), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        base = number = held = 0
        doc_ids, lengths, ids = [], [], []

        def flush() -> pd.DataFrame:
            whole = np.frombuffer(b"".join(ids), "<u4")
            return pd.DataFrame([{"part": part, "frame": number, "base": base, "n_ids": len(whole), "doc_ids": list(doc_ids), "doc_lengths": list(lengths)} | pack_frame(whole, planes, block)])

        for doc_id, own in code.rows(batches):
            own += tail
            doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
            lengths.append(len(own) // 4)
            ids.append(own)
            held += len(own) // 4
            if held >= frame:
                yield flush()
                base, number, held = base + held, number + 1, 0
                doc_ids, lengths, ids = [], [], []
        if ids:
            yield flush()
        ids = []
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    with arrow_rows(docs.sparkSession):
        ordered.mapInPandas(encode, FRAME_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples():
                ids, at, rows = unpack_frame(f.planes, list(f.n), list(f.sizes), f.payload).tobytes(), 0, []
                for doc_id, length in zip(f.doc_ids, f.doc_lengths, strict=True):
                    rows.append((f.part, doc_id, f.base + at // 4, length, zlib.crc32(ids[at : at + 4 * length])))
                    at += 4 * length
                found = pd.DataFrame(rows, columns=["part", "doc_id", "start", "n_tokens", "ids_crc32"])
                yield found.astype({"doc_id": "Int64"})

    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)
    entries = frames.mapInPandas(decode, ENTRY_SCHEMA)
    # one row for each write task: where its ids start among all
    sizes = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts[r["part"]], at = at, at + r["n"]
    bases = spark.createDataFrame(list(starts.items()), "part int, part_base long")
    return entries.join(F.broadcast(bases), "part").select("doc_id", (F.col("part_base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir).select("doc_id", "text"), path)
    return read_token_files(spark, path)
