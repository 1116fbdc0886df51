"""The byte network: gradients, whole texts, repeatable training, held-out accuracy."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from pulsegrid.llm import bytecnn
from pulsegrid.llm.bytecnn import CHUNK, OVERLAP, PAD, Pass, chances, chunks_of, fit, gradients, largest_units, new_weights, score

SF = "/root/testdata/sf0.01"


def test_chunks_cover_every_byte():
    for n in (0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 2 * CHUNK - OVERLAP, 5_000):
        text = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        chunks = chunks_of(text) % (PAD + 1)
        step, back = CHUNK - OVERLAP, bytearray()
        for k, c in enumerate(chunks):
            assert not k or k * step + OVERLAP < n  # no chunk lies within the one before
            back += bytes(x for x in c[len(back) - k * step :] if x != PAD)
        assert bytes(back) == text


def test_repeats_are_seen_as_by_a_plain_search():
    rng = np.random.default_rng(1)
    text = b"word word word " + rng.integers(97, 100, 300).astype(np.uint8).tobytes() + b"far" * 3
    (chunk,) = chunks_of(text)
    four = [bytes(text[max(0, i - 3) : i + 1]) for i in range(len(text))]
    want = [i >= 3 and any(four[i] == four[j] for j in range(max(3, i - bytecnn.LAGS), i)) for i in range(len(text))]
    assert (chunk[: len(text)] > PAD).tolist() == want and not (chunk[len(text) :] > PAD).any()


def test_forward_against_loops():
    w, text = new_weights(3), bytes(range(256)) * 3
    chunks = chunks_of(text)
    units = []
    for chunk in chunks:
        x = w["vectors"][chunk]
        seen = []
        for at in range(0, CHUNK - bytecnn.WIDTH + 1, bytecnn.STRIDE):
            first, second = x[at : at + 4].ravel(), x[at + 4 : at + 8].ravel()
            seen.append(np.maximum(first @ w["filters"][:, : bytecnn.FILTERS] + second @ w["filters"][:, bytecnn.FILTERS :] + w["shift"], 0))
        units.append(np.maximum(np.concatenate([np.max(seen, axis=0), np.mean(seen, axis=0)]) @ w["hidden"] + w["hidden_shift"], 0))
    assert np.allclose(Pass(w, chunks).units, units, atol=1e-4)
    assert np.allclose(largest_units(w, [text])[0], np.max(units, axis=0), atol=1e-4)


def test_gradients_against_differences():
    w = {k: v.astype(np.float64) for k, v in new_weights(4).items()}
    rng = np.random.default_rng(2)
    texts = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (40, 900, 600)]
    parts = [chunks_of(t) for t in texts]
    chunks, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]
    good, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])

    def loss(v):
        p = chances(v, np.maximum.reduceat(Pass(v, chunks).units, starts, axis=0))
        return -(weight * (good * np.log(p) + (1 - good) * np.log(1 - p))).sum()

    found = gradients(w, chunks, starts, good, weight)
    for k, g in found.items():
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert np.isclose((loss(up) - loss(down)) / 2e-5, g[at], rtol=0.02, atol=1e-4), k


def test_long_texts_are_read_to_their_end(monkeypatch):
    w = new_weights(5)
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 70_000).astype(np.uint8).tobytes() + b"!!%%&&" * 30
    whole = Pass(w, chunks_of(text)).units.max(axis=0)
    monkeypatch.setattr(bytecnn, "CHUNKS", 8)
    assert np.allclose(largest_units(w, [b"", text, text[:10]])[1], whole, atol=1e-4)
    assert np.allclose(largest_units(w, [b""])[0], Pass(w, chunks_of(b"")).units[0], atol=1e-5)


def made(spark, n=160):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    rows, labels = [], []
    for i in range(n):
        text = " ".join(word() for _ in range(120))
        if i % 4 == 0:
            text = text[:200] + " ".join(w.upper() + "!!" for w in text.split()[:60])
        rows.append((i, text))
        labels.append((i, int(i % 4 != 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learns_and_repeats_itself(spark):
    docs, labels = made(spark)
    first, again = fit(docs, labels, rounds=6), fit(docs.repartition(7), labels.repartition(3), rounds=6)
    assert all(np.array_equal(first[k], again[k]) for k in first)
    more = docs.withColumn("quality_score", docs["text"]).withColumn("good", docs["doc_id"]).withColumn("shard", docs["text"])
    got = {r["doc_id"]: r for r in score(more, first).collect()}
    assert len(got) == 160 and sum(r["quality_predicted"] == int(i % 4 != 0) for i, r in got.items()) >= 156
    assert got[3]["good"] == 3 and 0 <= got[3]["quality_score"] <= 1


def test_nulls_repeats_and_empty_tables(spark):
    docs, labels = made(spark, 40)
    odd = docs.unionByName(spark.createDataFrame([(None, None), (None, "x"), (3, ""), (3, None), (500, "a" * 300_000)], "doc_id long, text string"))
    marks = labels.unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 7), (4, 1)], "doc_id long, quality int"))
    model = fit(odd, marks, rounds=2)
    got = [(r["doc_id"], r["text"], r["quality_score"]) for r in score(odd, model).collect()]
    assert len(got) == 45 and all(0 <= s <= 1 for *_, s in got) and len({s for _, t, s in got if not t}) == 1
    none = docs.limit(0)
    assert score(none, model).collect() == [] and fit(none, labels) == 0.0 and fit(docs, labels.where("quality = 1")) == 1.0
    assert {r["quality_score"] for r in score(docs, 1.0).collect()} == {1.0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_registered_query_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in bytecnn.op13_quality_classifier(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    fold = [(labels[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in labels]
    assert sum(p == 1 for y, p in fold if y == 1) >= 0.98 * sum(y == 1 for y, _ in fold)
    assert sum(y == p for y, p in fold) >= 0.95 * len(fold)
