"""Quality classifier: a convolutional network over the bytes of a text, in numpy, trained and applied in Spark tasks.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP, to its end, so every byte is seen. A
byte is a learned vector, another one where it ends four bytes that its chunk holds up to LAGS bytes before (filters
alone don't see that a text repeats itself); FILTERS learned filters of WIDTH bytes go over each chunk in strides of half a filter. A
chunk's largest and mean activations pass HIDDEN units; their maximum over all chunks of the text gives the probability
by a logistic unit. A text of any length is read a bounded number of chunks at a time.

Training takes at most EXAMPLES labelled documents (half of the bound for each label, by a hash of the id; each counts as
the labelled documents of its label that it stands for) and of each at most FIT_CHUNKS of its chunks, spread evenly. They
lie in SHARDS shards, written once. In each of ROUNDS rounds every shard is a task that goes on from the common weights
by Adam over its own examples, and the weights of the shards are averaged, by their numbers of examples. A shard's steps
depend on its rows in a fixed order and on the number of the round, so a task that is run again gives the same weights.

Nulls: a null text is empty (one chunk of padding); labels with a null id or label teach nothing; a null id is held out.
Several labels of a document: the largest. Repeated rows are scored alike. Very long texts are read whole. Without labels
of both kinds every score is the rate of label 1 (0 without any labels). Other columns are kept; columns quality_score and
quality_predicted of the input are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pulsegrid.llm.shared import arrow_rows, documents, materialize, release, text_or_empty

#: Bytes of a chunk, shared with the next, and of a filter; numbers of a byte's vector; filters; hidden units.
CHUNK, OVERLAP, WIDTH, VECTOR, FILTERS, HIDDEN = 512, 64, 8, 8, 32, 24
STRIDE, PAD, LAGS = WIDTH // 2, 256, 32
#: Labelled documents to learn from and chunks of each; shards; rounds; documents of a step; least steps of a round; step size; the cut.
EXAMPLES, FIT_CHUNKS, SHARDS, ROUNDS, BATCH, STEPS, RATE, CUT = 3_000, 12, 8, 10, 12, 40, 4e-3, 0.5
#: Chunks that the filters go over at once.
CHUNKS = 64
SHAPES = {"vectors": (2 * (PAD + 1), VECTOR), "filters": (STRIDE * VECTOR, 2 * FILTERS), "shift": (FILTERS,), "hidden": (2 * FILTERS, HIDDEN), "hidden_shift": (HIDDEN,), "out": (HIDDEN,), "out_shift": (1,)}
Weights = dict[str, np.ndarray]


def new_weights(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    made = {k: rng.normal(0, 1 / np.sqrt(shape[0]) if len(shape) > 1 else 0.3, shape) for k, shape in SHAPES.items()}
    made["vectors"] = rng.normal(0, 0.5, SHAPES["vectors"])
    for k in SHAPES:
        if k.endswith("shift"):
            made[k] = np.zeros(SHAPES[k])
    return {k: v.astype(np.float32) for k, v in made.items()}


def chunks_of(text: bytes) -> np.ndarray:
    """All chunks of a text, (number, CHUNK); the last one is filled up with PAD; one chunk at least."""
    step = CHUNK - OVERLAP
    n = 1 + max(0, -(-(len(text) - CHUNK) // step))
    whole = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    whole[: len(text)] = np.frombuffer(text, np.uint8)
    chunks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::step])
    return chunks + (PAD + 1) * repeated(chunks).astype(np.int16)


def repeated(chunks: np.ndarray) -> np.ndarray:
    """Whether a byte ends four bytes that are also found up to LAGS bytes before in its chunk."""
    low = chunks.astype(np.uint8).astype(np.uint32)
    four = low[:, 3:] | low[:, 2:-1] << 8 | low[:, 1:-2] << 16 | low[:, :-3] << 24
    found = np.zeros(four.shape, bool)
    for lag in range(1, LAGS + 1):
        found[:, lag:] |= four[:, lag:] == four[:, :-lag]
    found &= chunks[:, 3:] != PAD
    return np.pad(found, ((0, 0), (3, 0)))


class Pass:
    """One pass over chunks; keeps what the way back needs."""

    def __init__(self, w: Weights, chunks: np.ndarray):
        self.w, self.chunks = w, np.ascontiguousarray(chunks)
        n = len(chunks)
        self.seen = w["vectors"].take(self.chunks, axis=0).reshape(n * CHUNK // STRIDE, STRIDE * VECTOR)
        halves = (self.seen @ w["filters"]).reshape(n, CHUNK // STRIDE, 2 * FILTERS)
        self.active = halves[:, :-1, :FILTERS] + halves[:, 1:, FILTERS:]
        self.active += w["shift"]
        np.maximum(self.active, 0, out=self.active)
        self.most = self.active.max(axis=1)
        self.pooled = np.concatenate([self.most, self.active.mean(axis=1)], axis=1)
        self.units = np.maximum(self.pooled @ w["hidden"] + w["hidden_shift"], 0)

    def back(self, units: np.ndarray) -> Weights:
        """Gradients of the weights below, from those of the units."""
        w, n = self.w, len(self.chunks)
        units = units * (self.units > 0)
        pooled = units @ w["hidden"].T
        where = self.active.argmax(axis=1)
        active = np.repeat(pooled[:, None, FILTERS:] / self.active.shape[1], self.active.shape[1], axis=1)
        np.put_along_axis(active, where[:, None], np.take_along_axis(active, where[:, None], 1) + pooled[:, None, :FILTERS], 1)
        active *= self.active > 0
        halves = np.zeros((n, CHUNK // STRIDE, 2 * FILTERS), np.float32)
        halves[:, :-1, :FILTERS] = active
        halves[:, 1:, FILTERS:] = active
        halves = halves.reshape(-1, 2 * FILTERS)
        seen = (halves @ w["filters"].T).reshape(-1, VECTOR)
        bytes_ = self.chunks.ravel()
        return {
            "vectors": np.stack([np.bincount(bytes_, seen[:, i], len(w["vectors"])) for i in range(VECTOR)], axis=1).astype(np.float32), "filters": self.seen.T @ halves, "shift": active.sum(axis=(0, 1)),
            "hidden": self.pooled.T @ units, "hidden_shift": units.sum(axis=0),
        }


def largest_units(w: Weights, texts: list[bytes]) -> np.ndarray:
    """For each text the maximum of each unit over all its chunks; a bounded number of chunks is held at once."""
    out = np.zeros((len(texts), HIDDEN), np.float32)  # units are never below 0
    held: list[np.ndarray] = []
    owner: list[int] = []

    def close() -> None:
        nonlocal held, owner
        if held:
            units = Pass(w, np.concatenate(held)).units
            np.maximum.at(out, np.array(owner), units)
        held, owner = [], []

    step = (CHUNK - OVERLAP) * CHUNKS
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - OVERLAP), step):
            part = chunks_of(text[at : at + step + OVERLAP])
            if len(owner) + len(part) > CHUNKS:
                close()
            held.append(part)
            owner += [i] * len(part)
    close()
    return out


def chances(w: Weights, units: np.ndarray) -> np.ndarray:
    z = units.astype(np.float64) @ w["out"] + w["out_shift"][0]
    return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))


def gradients(w: Weights, chunks: np.ndarray, starts: np.ndarray, good: np.ndarray, weight: np.ndarray) -> Weights:
    """Of the weighted log loss of documents, whose chunks begin at starts."""
    seen = Pass(w, chunks)
    best = np.maximum.reduceat(seen.units, starts, axis=0)
    wrong = ((chances(w, best) - good) * weight).astype(np.float32)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(chunks))))
    first = seen.units == best[owner]
    ties = np.add.reduceat(first.astype(np.float32), starts, axis=0)
    units = first / ties[owner] * (wrong[:, None] * w["out"])[owner]
    return seen.back(units.astype(np.float32)) | {"out": best.T @ wrong, "out_shift": wrong.sum(keepdims=True)}


def trained(w: Weights, examples: list[tuple[np.ndarray, float, float]], number: int) -> Weights:
    """Weights after one round over the examples (chunks, good, weight)."""
    rng, w = np.random.default_rng(number), {k: v.copy() for k, v in w.items()}
    mean, spread = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    size = min(BATCH, len(examples))
    steps = max(STEPS, -(-len(examples) // size))
    order = np.concatenate([rng.permutation(len(examples)) for _ in range(-(-steps * size // len(examples)))])
    rate = RATE * (1 - number / ROUNDS) ** 0.5
    for t in range(1, steps + 1):
        own = [examples[i] for i in order[(t - 1) * size : t * size]]
        starts = np.cumsum([0, *(len(c) for c, _, _ in own)])[:-1]
        found = gradients(w, np.concatenate([c for c, _, _ in own]), starts, np.array([g for _, g, _ in own]), np.array([x for _, _, x in own]) / size)
        for k, g in found.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            w[k] = w[k] - (rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(spread[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return w


def _bounded_labels(labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, good) to learn from, at most about most / 2 of each label by a hash of the id; the numbers of all by label."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("good")).where(~held_out())
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}  # two rows at most
    place, share = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000_000)), F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("good") == label, int(min(1.0, most / 2 / n) * 1_000_000_000)).otherwise(share)
    return known.where(place < share), counts


def held_out(key: str = "doc_id") -> Column:
    """The test fold of the contract: crc32 of the id as text, modulo 3, is 1; a null id is in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(True))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Examples with chunks of their texts in place of the texts."""
    for batch in batches:
        packed = []
        for text in batch["text"]:
            own = chunks_of(text.encode("utf-8", "surrogatepass"))
            packed.append((own if len(own) <= FIT_CHUNKS else own[np.linspace(0, len(own) - 1, FIT_CHUNKS).astype(int)]).tobytes())
        yield batch[["shard", "place", "good"]].assign(chunks=packed)


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, rounds: int = ROUNDS) -> Weights | float:
    """Weights learned from labels (doc_id, quality) outside the test fold; without labels of both kinds the rate of label 1."""
    spark = docs.sparkSession
    chosen, counts = _bounded_labels(labels, most)
    chosen = materialize(chosen, "quality-labels")
    place = F.xxhash64("doc_id", "text")
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select(F.pmod(place, F.lit(SHARDS)).cast("int").alias("shard"), place.alias("place"), "good", "text")  # at most `most` labels
    with arrow_rows(spark):
        examples = materialize(texts.mapInPandas(_packed, "shard int, place long, good int, chunks binary").repartitionById(SHARDS, F.col("shard")), "quality-examples")
    tally = {r["good"]: r["count"] for r in examples.groupBy("good").count().collect()}  # two rows at most
    n, good = sum(tally.values()), tally.get(1, 0)
    if not good or good == n:
        return good / n if n else 0.0
    stands = {y: counts[y] / tally[y] for y in tally}
    scale = n / sum(counts.values())
    weights = new_weights()

    def round_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"place": [], "good": [], "chunks": []}), *batches])
        if len(rows):
            rows = rows.sort_values(["place", "good"], kind="stable")
            own = [(np.frombuffer(c, np.int16).reshape(-1, CHUNK), float(y), stands[int(y)] * scale) for c, y in zip(rows["chunks"], rows["good"], strict=True)]
            found = trained(weights, own, number)
            yield pd.DataFrame({"n": [len(own)], "weights": [np.concatenate([found[k].ravel() for k in SHAPES]).tobytes()]})

    for number in range(rounds):  # a round's weights are SHARDS rows of a few kilobytes
        rows = examples.repartitionById(SHARDS, F.col("shard")).mapInPandas(round_of, "n long, weights binary").orderBy("n", "weights").collect()
        mean = np.average([np.frombuffer(r["weights"], np.float32) for r in rows], axis=0, weights=[r["n"] for r in rows]).astype(np.float32)
        cuts = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])
        weights = {k: mean[a:b].reshape(s) for (k, s), a, b in zip(SHAPES.items(), cuts[:-1], cuts[1:], strict=True)}
    return weights


def score(docs: DataFrame, model: Weights | float, cut: float = CUT) -> DataFrame:
    """Adds quality_score and quality_predicted to the rows of docs, in one pass without a shuffle."""
    docs = docs.drop("quality_score", "quality_predicted")
    out = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            found = np.full(len(texts), model) if isinstance(model, float) else chances(model, largest_units(model, texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "quality_score"])
        release()

    return docs.mapInArrow(run, out).withColumn("quality_predicted", F.when(F.col("quality_score") >= cut, 1).otherwise(0))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = score(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
