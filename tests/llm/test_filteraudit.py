"""The audit of filters against plain Python, row by row and order by order."""

from __future__ import annotations

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import filteraudit
from pulsegrid.llm.filteraudit import ORDERS, audit_filters, first_failures, removals

SF = "/root/testdata/sf0.001"


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rank = lambda i: (i is None, i or 0)
    first: dict = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", (True, 1)), rank(i))
    fails = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": first[t] < rank(i)}
        fails.append((lang or "", {k for k, v in own.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        own = [(f, g, x) for p, f, g, x in fails if p == part]
        for order in ORDERS:
            left = own
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                left = [r for r in left if c not in r[0]]
                shapley[part, c] += len(gone)
                redundant = sum(c in f for f, _, _ in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(f == {c} for f, _, _ in own), sum(g for _, g, _ in gone), sum(x for _, _, x in gone)]
    return Counter((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_table_holds_first_failures():
    table = first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b10001, ORDERS.index("BEACD")] == 1 and table[0b00001, ORDERS.index("BCDEA")] == 4


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "x " * 300, "A" * 40 + " b", "a # b", " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)), "w " * 250 + "|", " ".join(f"v{k}" for k in range(205)) + " $\x0b\x0ctail", "é " * 210, "lang " * 40_000]
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 60)), texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)]) for _ in range(300)]
    labels = [(i, int(rng.integers(0, 2)), [None, 0, 1][rng.integers(3)]) for i in range(0, 60, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0), (999, 1, 1)]
    docs, marks = frames(spark, rows, labels)
    for extra in ("part", "mask", "n", "words", "step", "removed", "text_key", "rank", "quality"):
        docs = docs.withColumn(extra, docs["lang"])
    got = Counter(map(tuple, audit_filters(docs, marks).collect()))
    assert got == brute(rows, labels)


def test_many_parts_are_handed_on(spark, monkeypatch):
    rows = [(i, "a # b" if i % 3 else "A B", f"p{i % 97}") for i in range(500)]
    docs, marks = frames(spark, rows, [(1, 1, 1)])
    monkeypatch.setattr(filteraudit, "PARTS", 8)
    monkeypatch.setattr(filteraudit, "TOGETHER", 3)
    assert Counter(map(tuple, audit_filters(docs, marks).collect())) == brute(rows, [(1, 1, 1)])


def test_a_common_text_is_counted_before_it_is_dealt(spark):
    rows = [(i % 7, "same text", "en") for i in range(2_000)]
    docs, _ = frames(spark, rows, [(1, 1, 1)])
    seen = filteraudit.facts(docs)
    assert seen.count() == 7 and seen.agg({"n": "sum"}).first()[0] == 2_000


def test_empty_tables(spark):
    docs, marks = frames(spark, [], [])
    found = audit_filters(docs, marks)
    assert found.collect() == [] and dict(found.dtypes)["step"] == "int" and {t for c, t in found.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    docs, _ = frames(spark, [(1, None, None)], [])
    assert audit_filters(docs, marks).count() == 600
    assert removals(spark.createDataFrame([], "part string, mask int, n long, good boolean, toxic boolean")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_registered_query_against_sql_and_brute_force(spark):
    found = filteraudit.op12_filter_audit(spark, SF)
    got = Counter(map(tuple, found.collect()))
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in marks.select("doc_id", "quality", "toxic").collect()])
    assert got == want
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    answer = duck.execute(filteraudit.ORACLE_SQL)
    assert [d[0] for d in answer.description] == found.columns and Counter(answer.fetchall()) == want
