"""Integrity of snapshots: field leaves, Merkle roots and proofs, tamper differences, audit, registry."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leaf(key: Column, value: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(F.concat_ws(":", key, F.coalesce(value, F.lit("null"))), 256))


def as_text(value: Column, kind: str) -> Column:
    """Numbers without a trailing .0, as they are hashed."""
    text = value.cast("string")
    return F.regexp_replace(text, r"\.0$", "") if kind in ("double", "float") else text


def field_leaves(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, leaf) of every field, fields in order of name."""
    kinds = dict(rows.dtypes)
    parts = F.array(*[F.struct(F.lit(f).alias("field"), leaf(F.lit(f), as_text(F.col(f), kinds[f])).alias("leaf")) for f in sorted(fields)])
    return rows.select(key, F.explode(parts).alias("p")).select(key, "p.*")


_ROTATION = [[0, 36, 3, 41, 18], [1, 44, 10, 45, 2], [62, 6, 43, 15, 61], [28, 55, 25, 21, 56], [27, 20, 39, 8, 14]]


def _round_constants() -> list[int]:
    """From the linear feedback shift register of the Keccak specification."""
    out, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(c)
    return out


_CONSTANTS, _MASK = _round_constants(), (1 << 64) - 1


def keccak256(data: bytes) -> bytes:
    """Keccak-256 with the original padding."""
    rate = 136
    padded = bytearray(data) + bytearray(rate - len(data) % rate)
    padded[len(data)] ^= 1
    padded[-1] ^= 0x80
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & _MASK if n else x
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        for constant in _CONSTANTS:
            c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            d = [c[x - 1] ^ turn(c[(x + 1) % 5], 1) for x in range(5)]
            b = [[0] * 5 for _ in range(5)]
            for x in range(5):
                for y in range(5):
                    b[y][(2 * x + 3 * y) % 5] = turn(a[x][y] ^ d[x], _ROTATION[x][y])
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & _MASK & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            a[0][0] ^= constant
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _join(a: bytes, b: bytes, digest: Callable[[bytes], bytes]) -> bytes:
    return digest(min(a, b) + max(a, b))


def merkle(leaves: list[str], digest: Callable[[bytes], bytes]) -> tuple[str, list[list[str]]]:
    """(root, proof of each leaf): pairs are sorted before hashing; an odd node moves up."""
    level = [bytes.fromhex(x[2:]) for x in leaves]
    proofs: list[list[str]] = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for i, k in enumerate(at):
            if k ^ 1 < len(level):
                proofs[i].append("0x" + level[k ^ 1].hex())
        level = [_join(level[k], level[k + 1], digest) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return "0x" + level[0].hex(), proofs


def verify(leaf_hash: str, proof: list[str], root: str, digest: Callable[[bytes], bytes]) -> bool:
    x = bytes.fromhex(leaf_hash[2:])
    for p in proof:
        x = _join(x, bytes.fromhex(p[2:]), digest)
    return "0x" + x.hex() == root


def merkle_trees(leaves: DataFrame, group: str, order: list[str], digest: Callable[[bytes], bytes] = keccak256) -> DataFrame:
    """(group, ord, leaf, root, proof) for each group of a bounded number of leaves (fields of a snapshot, a batch)."""
    kind = dict(leaves.dtypes)[group]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        root, proofs = merkle(rows["leaf"].tolist(), digest)
        return pd.DataFrame({group: rows[group], "ord": range(len(rows)), "leaf": rows["leaf"], "root": root, "proof": proofs})

    return leaves.groupBy(group).applyInPandas(build, f"{group} {kind}, ord int, leaf string, root string, proof array<string>")


def verified(trees: DataFrame, digest: Callable[[bytes], bytes] = keccak256) -> DataFrame:
    """Adds ok: the proof leads from the leaf to the root."""

    @F.pandas_udf("boolean")
    def check(leaf_: pd.Series, proof: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([verify(a, list(b), c, digest) for a, b, c in zip(leaf_, proof, root, strict=True)], dtype=bool)

    return trees.withColumn("ok", check("leaf", "proof", "root"))


def tampered(anchored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, verdict, tampered, intact) from leaves (key, field, leaf) anchored before and computed now."""
    both = anchored.join(current.withColumnRenamed("leaf", "now"), [key, "field"], "left")
    same = F.coalesce(F.col("leaf") == F.col("now"), F.lit(False))
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("field")))), ",")
    by = both.groupBy(key).agg(names(~same).alias("tampered"), names(same).alias("intact"))
    return by.select(key, F.when(F.col("tampered") == "", "INTACT").otherwise("TAMPER_DETECTED").alias("verdict"), "tampered", "intact")


def audit_join(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Anchors with their rows by id, else the first by label: two equi joins instead of one on either."""
    by_id = rows.groupBy("snapshot_id").agg(F.min("score").alias("id_score"))
    by_label = rows.groupBy("label").agg(F.min_by("score", "snapshot_id").alias("label_score"))
    return anchors.join(by_id, "snapshot_id", "left").join(by_label, "label", "left").withColumn("found", F.coalesce("id_score", "label_score"))


def registry(events: DataFrame) -> DataFrame:
    """First write of each key wins, by time and event id; later ones only count. Combined before the shuffle."""
    first = F.min(F.struct("at", "event_id", "value")).alias("first")
    return events.groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).select("key", "first.value", "first.at", (F.col("n") - 1).alias("matches"))


def audit_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("verdict") == "INTACT").alias("intact"), F.count_if(F.col("verdict") != "INTACT").alias("tampered"))


#: Fields of a snapshot's payload, in order of name.
PAYLOAD = ("captured_at", "centrality_score", "config_hash", "sentiment_result", "sentiment_score", "snapshot_id", "trend_label", "virality_score", "virality_tier")
BATCH = 100


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a compact JSON object of the fields in order of name; nulls are written, numbers without .0."""
    text = lambda c: F.coalesce(F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6), F.lit("null"))
    value = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(text(c), r"^(-?[0-9]+)\.0$", "$1"))
    parts = [F.concat(F.lit(f'"{k}":'), value(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256))


def payload(snapshots: DataFrame, **columns: Column) -> DataFrame:
    """The nine payload fields of each snapshot; those not given are null."""
    return snapshots.select(*[columns.get(k, F.lit(None).cast("string")).alias(k) for k in PAYLOAD])


def batches(leaves: DataFrame, order: list[str], most: int = BATCH) -> DataFrame:
    """Adds batch and leaf_index: at most so many leaves of one stream in a batch, in order. Numbers of leaves before each
    day are summed over days, so no stream is numbered as a whole. leaves: stream, day, and the columns of order."""
    days = leaves.groupBy("stream", "day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("stream").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offset = days.select("stream", "day", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("stream", "day").orderBy(*order)) - 1
    numbered = leaves.withColumn("own", own).join(offset, ["stream", "day"]).withColumn("place", F.col("offset") + F.col("own"))
    return numbered.select(*leaves.columns, F.concat_ws("#", "stream", F.floor(F.col("place") / most).cast("string")).alias("batch"), (F.col("place") % most).cast("int").alias("leaf_index"))


def ladder(proof_ok: Column, direct: Column, legacy: Column, tampered_fields: Column) -> Column:
    """(status, method) of a check: by proof where there is one, else a root anchored by itself, else a legacy hash, else
    tampered. proof_ok: null without a proof; tampered_fields: how many differ."""
    clean = tampered_fields == 0
    status = lambda ok, how: F.struct(F.when(ok, "INTACT").otherwise("TAMPER_DETECTED").alias("status"), F.lit(how).alias("method"))
    return (
        F.when(proof_ok.isNotNull(), status(proof_ok & clean, "field_merkle_tree")).when(direct, status(clean, "direct"))
        .when(legacy, status(F.lit(True), "direct_legacy")).otherwise(status(F.lit(False), "unknown"))
    )


def audit_latest(anchors: DataFrame, verdicts: DataFrame, most: int = 10) -> DataFrame:
    """The newest anchors with their verdict; an anchor whose snapshot is gone is missing."""
    newest = anchors.orderBy(F.desc("anchored_at"), "snapshot_id").limit(most)
    return newest.join(verdicts.select("snapshot_id", "verdict"), "snapshot_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("MISSING")))
