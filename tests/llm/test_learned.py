from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import neighbours, toxicity


def brute_neighbours(rows, most):
    out = {}
    for q, v in rows:
        if q % 20:
            continue
        scores = sorted((-math.fsum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out[q] = [i for _, i in scores[:most]]
    return out


def test_neighbours_reach_the_recall_and_order_ties(spark):
    dice = np.random.default_rng(8)
    x = dice.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[0]  # a third of all rows is one vector
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [(None, rows[0][1]), (2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15 + [None]), (2080, [1.0] * 3), (2100, [float("inf")] * 16)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad + rows[:2]], "vec_id long, embedding array<float>, cid string")
    got: dict = {}
    for r in neighbours.nearest_neighbours(table, F.col("id") % 20 == 0, "vec_id", "embedding", size=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    want = brute_neighbours(rows, 20)
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rs in got.items():
        assert [r["rank"] for r in rs] == list(range(1, 21)) and len({r["vec_id"] for r in rs}) == 20 and q not in {r["vec_id"] for r in rs}
        keys = [(-r["score"], r["vec_id"]) for r in rs]
        assert keys == sorted(keys)
        for r in rs:
            assert abs(r["score"] - float(np.dot(x[q].astype(float), x[r["vec_id"]].astype(float)))) < 1e-12


def measured(spark, x, lists_of=64, monkeypatch=None):
    """(index, rows for each vector, share of postings that a query scores, recall) against brute force."""
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.materialize(neighbours.classes(neighbours.valid(table, "vec_id", "embedding"), 21), "test-classes")
    index = neighbours.fit(found, lists_of)
    posted = neighbours.assign(found, index).groupBy("list").count().collect()
    sizes = np.bincount([r["list"] for r in posted], [r["count"] for r in posted], index.lists)
    asked = neighbours.probe(found.where("cid % 20 = 0"), index, sizes, 84).groupBy("qid").agg(F.collect_list("list").alias("l")).collect()
    share = np.mean([sizes[r["l"]].sum() for r in asked]) / len(x)
    got: dict = {}
    for r in neighbours.nearest_neighbours(table, F.col("id") % 20 == 0, "vec_id", "embedding", size=lists_of).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = [len(got[q] & set(np.argsort(-score[q], kind="stable")[:20].tolist())) / 20 for q in range(0, len(x), 20)]
    return index, sizes.sum() / len(x), share, np.mean(hits)


def test_boundary_replicas_and_pruning_of_clustered_vectors(spark, monkeypatch):
    dice = np.random.default_rng(5)
    x = dice.normal(size=(60, 24))[dice.integers(0, 60, 4000)] + 0.5 * dice.normal(size=(4000, 24))
    index, rows, share, recall = measured(spark, x)
    assert index.lists > 30 and 1.0 < rows < 2 and share < 0.25 and recall >= 0.9
    # a small sample on the driver: tasks cluster the lists once more
    monkeypatch.setattr(neighbours, "SAMPLE", 256)
    second, rows, share, recall = measured(spark, x)
    assert second.lists > 32 and rows > 1.0 and share < 0.3 and recall >= 0.9


def test_a_search_measures_few_of_very_many_centroids(spark):
    dice = np.random.default_rng(7)
    c = dice.normal(size=(256, 24))[dice.integers(0, 256, 8_192)] + 0.4 * dice.normal(size=(8_192, 24))
    x = c[dice.integers(0, 8_192, 200)] + 0.1 * dice.normal(size=(200, 24))
    links = neighbours.links_of(spark, c)
    assert links.shape == (8_192, 30) and np.array_equal(links[1_024:2_048], neighbours.linked(c, 1_024, 2_048))
    for width in (2 * neighbours.COPIES, neighbours.PROBED):
        graph = neighbours.CentroidGraph(c, links)
        near, far = graph.search(x, width)
        assert graph.measured < 200 * 8_192 / 10
        best, least = graph.scan(x, width)
        assert np.mean(near[:, 0] == best[:, 0]) > 0.95 and (np.diff(far, axis=1) >= 0).all()
        assert np.mean([len(set(a) & set(b)) / width for a, b in zip(near, best)]) > 0.9
    wide, far = neighbours.CentroidGraph(c, links).search(x[:3], 4_000)
    assert wide.shape == (3, 4_000) and np.isfinite(far).all()


def test_vectors_without_structure_reach_the_recall_by_more_lists(spark):
    x = np.random.default_rng(6).normal(size=(3000, 24))
    _, rows, share, recall = measured(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    assert rows > 1.0 and recall >= 0.9 and share < 1.2


def test_few_candidates_are_all_returned(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(table, F.col("id") % 20 == 0, "vec_id", "embedding").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert neighbours.nearest_neighbours(table.limit(0), F.col("id") % 20 == 0, "vec_id", "embedding").count() == 0


def test_graph_search_finds_the_nearest_centroid():
    dice = np.random.default_rng(1)
    c, x = dice.normal(size=(500, 12)), dice.normal(size=(300, 12))
    near, _ = neighbours.CentroidGraph(c, neighbours.linked(c, 0, len(c))).search(x, 16)
    assert (near[:, 0] == neighbours.squared(x, c).argmin(1)).mean() > 0.97


def toxic_corpus():
    dice = random.Random(6)
    words = ["".join(dice.choice("abcdefgh") for _ in range(dice.randint(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(1200):
        t = [dice.choice(words) for _ in range(60)]
        bad = i % 8 == 0
        for _ in range(3 if bad else 0):
            t[dice.randrange(60)] = dice.choice(["zorgo", "zorgix!", "Zorgat,", "quibble"])
        docs.append((i, " ".join(t), "x"))
        if i % 2 == 0:
            labels.append((i, 0, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = toxic_corpus()
    extra = [(None, "zorgo zorgix", "x"), (5000, None, "x"), (5001, "", "x"), (0, docs[0][1], "x")]
    table = spark.createDataFrame(docs + extra, "doc_id long, text string, toxic string")
    known = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None), labels[0]], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known)
    got = toxicity.score(table, model).withColumn("held", toxicity.held_out()).collect()
    assert len(got) == len(table.collect())
    wrong = 0
    for r in got:
        assert 0 <= r["toxic_score"] <= 1 and r["toxic_predicted"] == (r["toxic_score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            if r["doc_id"] < 5000 and r["held"]:
                wrong += r["toxic_predicted"] != (r["doc_id"] % 8 == 0)
    assert wrong <= 0.02 * len(got)
    for r in got:
        for e in r["toxic_evidence"] or []:
            assert zlib.crc32(str(e).encode()) % 3 != 1  # never from the test fold


def test_nearest_examples_are_exact():
    dice = random.Random(9)
    model = toxicity.Model([], np.arange(40), np.array([1.0 + i / 40 for i in range(40)]))

    def vector():
        w = {t: dice.random() for t in sorted(dice.sample(range(40), 5))}
        n = math.sqrt(sum(x * x for x in w.values()))
        return np.array(list(w)), np.array([x / n for x in w.values()])

    vectors = [vector() for _ in range(700)]
    model.build(vectors, [i % 2 for i in range(700)], list(range(700)))
    queries = [vector() for _ in range(50)]
    but = [dice.randrange(700) for _ in range(50)]
    for left_out in (None, but):
        for k, (at, near) in enumerate(model.nearest(queries, left_out)):
            dense = np.zeros(40)
            dense[queries[k][0]] = queries[k][1]
            scores = sorted((-float(dense[t] @ w), i) for i, (t, w) in enumerate(vectors) if left_out is None or model.ids[but[k]] != i)
            assert np.allclose(near, [-s for s, _ in scores[:15]]) and set(model.ids[at].tolist()) == {i for _, i in scores[:15]}


def test_vectors_hold_all_words_and_marks():
    """Against TF-IDF by hand: frequencies of words, both parts of length 1, marks weighing MARKED."""
    reader = toxicity.Reader(["zorg*", "zorg*2", "plum"])
    _, (terms, counts), _ = reader.many(["the plum", "Plum zorgo, zorgix zorgo the The the ... other", ""])
    slot = lambda w: zlib.crc32(w.encode()) % toxicity.SLOTS
    want = {slot("plum"): 1, slot("zorgo"): 2, slot("zorgix"): 1, slot("the"): 3, slot("other"): 1, toxicity.SLOTS: 2, toxicity.SLOTS + 1: 2, toxicity.SLOTS + 2: 1}
    assert dict(zip(terms.tolist(), counts.tolist())) == want
    known = np.array(sorted(t for t in want if t != slot("other")))
    idf = np.arange(1.0, len(known) + 1)
    at, weight = toxicity.Model(["zorg*", "zorg*2", "plum"], known, idf).vector(terms, counts)
    raw = {t: (1 + math.log(n)) * idf[list(known).index(t)] for t, n in want.items() if t != slot("other")}
    for marks, share in ((True, toxicity.MARKED), (False, 1 - toxicity.MARKED)):
        part = {t: w for t, w in raw.items() if (t >= toxicity.SLOTS) == marks}
        length = math.sqrt(sum(w * w for w in part.values()))
        for t, w in part.items():
            assert abs(weight[list(known[at]).index(t)] - math.sqrt(share) * w / length) < 1e-12


def test_documents_without_marks_have_neighbours(spark):
    docs, labels = toxic_corpus()
    table = spark.createDataFrame([*docs, (9000, " ".join(d[1] for d in docs[:300]), "x")], "doc_id long, text string, x string")  # the last is very long
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(table, model).collect()
    assert sum(bool(r["toxic_evidence"]) for r in got) >= 0.95 * len(got)


def test_without_labels_or_documents(spark):
    docs, _ = toxic_corpus()
    table = spark.createDataFrame(docs[:10], "doc_id long, text string, x string")
    for labels, want in (([], 0.0), ([(0, 0, 1), (2, 0, 1)], 1.0)):
        model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert {r["toxic_score"] for r in toxicity.score(table, model).collect()} == {want}
    assert toxicity.score(table.limit(0), model).count() == 0


def test_lists_without_queries_or_with_them_alone(spark):
    dice = np.random.default_rng(2)
    x = dice.normal(size=(8, 6))[np.arange(400) % 8] * 5 + 0.01 * dice.normal(size=(400, 6))
    x[0], x[20] = x[1], x[9]  # queries in two of eight clusters
    keep = [i for i in range(400) if i % 20 or i in (0, 20)]
    table = spark.createDataFrame([(i, x[i].tolist()) for i in keep], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(table, F.col("id") % 20 == 0, "vec_id", "embedding", nearest=5, size=20).collect()
    assert len(got) == 10
