"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk where its lowest bits are all ones; the number of bits asked
for, the block size's logarithm, is the least that leaves at most 64 chunks. A fingerprint is
``block size:signature:signature at twice the block size``, one base-64 digit of the hash of every chunk's bytes. Two
fingerprints compare by edit distance where their block sizes are equal or differ by a factor of two; other pairs
have likeness 0.

Ranges of (descending id, hash of the text) are cut at a bounded sample of these keys, so rows that share an id, or
have none, lie in many ranges; only rows alike in both lie in one.

Nulls: a null text is empty (fingerprint ``1::``); null ids come last in descending order. Rows that repeat an id
follow one another in the order of a hash of their texts. Equal texts have equal fingerprints and likeness 1. A single document is its own next
document. Very long texts are read whole; their ranges hold fewer of them. An empty table gives an empty result. Columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import documents, shuffle_parts, text_or_empty

DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
VALUE = np.zeros(256, np.int64)
VALUE[DIGITS] = np.arange(64)
MOST, LEVELS = 64, 40
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Pairs compared at once; keys sampled for each range.
TOGETHER, SAMPLED = 512, 50
#: Bytes of text of a range, where the session's shuffle partitions would make them larger; powers kept in a worker.
RANGE_BYTES, HELD = 32_000_000, 1 << 18
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * A
    x ^= x >> np.uint64(32)
    x *= B
    x ^= x >> np.uint64(29)
    return x


_HELD: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse; those up to HELD are kept."""
    if n > HELD:
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, c, np.uint64)])) for c in (int(B), pow(int(B), -1, 1 << 64)))
    if not _HELD:
        _HELD[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(HELD - 1, c, np.uint64)])) for c in (int(B), pow(int(B), -1, 1 << 64))]
    return _HELD[0][:n], _HELD[1][:n]


def fingerprint(data: bytes) -> str:
    n = len(data)
    if not n:
        return "1::"
    # the seven bytes up to each position, as a number
    last = np.ndarray((n,), "<u8", bytes(7) + data, strides=(1,)) >> np.uint64(8)
    rolled = _mix(last)
    ones = ~rolled & (rolled + np.uint64(1))  # the lowest zero bit: 2 to the number of ones below it
    level = 0
    while level < LEVELS and np.count_nonzero(ones >= np.uint64(1 << level)) > MOST:
        level += 1
    up, down = _powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(np.frombuffer(data, np.uint8) * up, dtype=np.uint64)])
    out = [str(1 << level)]
    for k in (level, level + 1):
        ends = np.flatnonzero(ones >= np.uint64(1 << k))
        if not len(ends) or ends[-1] != n - 1:
            ends = np.append(ends, n - 1)
        if len(ends) > MOST:
            ends = np.append(ends[: MOST - 1], n - 1)
        begins = np.concatenate([[0], ends[:-1] + 1])
        chunks = _mix((sums[ends + 1] - sums[begins]) * down[begins])  # of the chunk's own bytes, wherever it begins
        out.append(DIGITS[(chunks >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return ":".join(out)


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of pairs of signatures of at most 64 digits, by bit-parallel columns over all pairs at once."""
    n = len(left)
    m, t = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    digits = lambda xs: VALUE[np.frombuffer("".join(x.ljust(MOST, "A") for x in xs).encode(), np.uint8)].reshape(n, MOST)
    pattern, text, rows, one = digits(left), digits(right), np.arange(n), np.uint64(1)
    equal = np.zeros((n, 64), np.uint64)
    for i in range(int(m.max(initial=0))):
        on = rows[i < m]
        equal[on, pattern[on, i]] |= one << np.uint64(i)
    up, down, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), m.copy()
    top = np.maximum(m - 1, 0).astype(np.uint64)
    for j in range(int(t.max(initial=0))):
        e = equal[rows, text[:, j]]
        v = e | down
        h = (((e & up) + up) ^ up) | e
        plus, minus = down | ~(h | up), up & h
        change = ((plus >> top) & one).astype(np.int64) - ((minus >> top) & one).astype(np.int64)
        plus, minus = (plus << one) | one, minus << one
        up, down = minus | ~(v | plus), plus & v
        score += np.where(j < t, change, 0)
    return np.where(m == 0, t, score)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for every pair of fingerprints."""
    left, right, equal, none = [], [], [], []
    for a, b in pairs:
        x, y = a.split(":"), b.split(":")
        p, q = int(x[0]), int(y[0])
        equal.append(a == b)
        none.append(not (p == q or p == 2 * q or q == 2 * p))
        left.append(x[2] if q == 2 * p else x[1])
        right.append(y[2] if p == 2 * q else y[1])
    longest = np.array([max(len(a), len(b), 1) for a, b in zip(left, right, strict=True)])
    found = np.where(none, 0.0, 1.0 - distances(left, right) / longest)
    return np.where(equal, 1.0, found)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare(rows: list[tuple]) -> pd.DataFrame:
    """rows: (doc_id, text, its fingerprint, the next text, the next fingerprint)."""
    changed = [edited(r[1], r[3]) for r in rows]
    raw = [c.encode("utf-8", "surrogatepass") for c in changed]
    prints = [fingerprint(x) for x in raw]
    near = likeness([(r[2], p) for r, p in zip(rows, prints, strict=True)] + [(r[2], r[4]) for r in rows])
    return pd.DataFrame({
        "doc_id": pd.array([r[0] for r in rows], "Int64"), "n_chars": [len(r[1]) for r in rows], "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
        "fingerprint": [r[2] for r in rows], "edited_fingerprint": prints, "near_edited": near[: len(rows)], "near_next": near[len(rows) :],
    })


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, ahead, doc_id, text), each range one task's run of descending ids; a copy of the next range's
    first row, ahead = 1, ends each range (the very first row ends the last). A sample of keys, SAMPLED for each
    range, and the ranges' first keys are all that passes through the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # rises as ids fall, nulls last; then a hash of the text
    keyed = rows.withColumns({"none": F.col("doc_id").isNull().cast("int"), "down": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "th": F.xxhash64("text")})
    key = ["none", "down", "th"]
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    parts = max(shuffle_parts(spark), -(-(size["bytes"] or 0) // RANGE_BYTES))
    share = min(1.0, SAMPLED * parts / size["n"]) if size["n"] and parts > 1 else 0.0
    drawn = keyed.where(F.pmod(F.xxhash64("doc_id", "th", F.lit(3)), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select(*key).distinct()
    found = sorted(map(tuple, drawn.collect())) if share else []
    cuts = sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(none: pd.Series, down: pd.Series, th: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([bisect_right(own, x) for x in zip(none, down, th, strict=True)], dtype="int32")

    ranged = keyed.withColumn("range", range_of(*key))
    heads = ranged.groupBy("range").agg(F.min(F.struct(*key)).alias("head")).orderBy("range").collect()  # one row a range
    before = [(r["range"], *r["head"], heads[i - 1]["range"]) for i, r in enumerate(heads)]
    known = spark.createDataFrame(before, "range int, h_none int, h_down long, h_th long, before int")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead"))
    copied = F.struct(F.col("before").alias("range"), F.lit(1).alias("ahead"))
    leads = (F.col("none") == F.col("h_none")) & (F.col("down") == F.col("h_down")) & (F.col("th") == F.col("h_th"))
    at = F.explode(F.when(leads, F.array(own, copied)).otherwise(F.array(own)))
    placed = ranged.join(F.broadcast(known), "range").select(at.alias("at"), *key, "doc_id", "text").select("at.*", *key, "doc_id", "text")  # a row a range
    dealt = placed.repartitionById(parts, F.col("range"))
    return dealt.sortWithinPartitions("range", "ahead", *key, "text").select("range", "ahead", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness to it and to the next document's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out = None, []
        for batch in batches:
            for run_id, ahead, doc_id, text in zip(*(batch[c] for c in ("range", "ahead", "doc_id", "text")), strict=True):
                if held is not None and held[0] != run_id:
                    held = None
                if held is None and ahead:  # further copies of a repeated first row
                    continue
                own = fingerprint(text.encode("utf-8", "surrogatepass"))
                if held is not None:
                    out.append((held[1], held[2], held[3], text, own))
                held = None if ahead else (run_id, None if pd.isna(doc_id) else int(doc_id), text, own)
                if len(out) >= TOGETHER:
                    yield _compare(out)
                    out = []
        if out:
            yield _compare(out)

    return with_next(docs).mapInPandas(run, SCHEMA)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
