"""Phrase growth against counting every phrase in plain Python, and the registered query against SQL."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import collocations
from pulsegrid.llm.collocations import cut, mine

SF = "/root/testdata/sf0.001"


def pieces_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top):
    """rows: (text, lang)."""
    f: dict = defaultdict(Counter)
    for text, lang in rows:
        own = f["und" if lang is None else lang]
        for words in pieces_of(text):
            for m in range(1, 5):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        frequent = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        longest: Counter = Counter()
        for p, c in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], c)
        scored = []
        for p, a in frequent.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -score) for k, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(n=260, seed=2):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "The", "État", "a", "b", "c", "x-1", "zz", "été"] + [f"w{k}" for k in range(25)]
    rate = 1 / np.arange(1, len(words) + 1) ** 1.2
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\x0b", "! ", " "]
    rows = []
    for i in range(n):
        own = rng.choice(words, rng.integers(0, 40), p=rate / rate.sum())
        rows.append(("".join(w + ends[min(rng.integers(0, 30), 8)] for w in own), [None, "en", "en", "", "de"][i % 5]))
    return rows + [("of the same phrase again " * 30, "en"), ("a" * 50_000, "en"), (None, "en"), ("", None), (" . ,", "de")] + [("copy of the text, of the text", "fr")] * 40


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def answers(found):
    return sorted(map(tuple, found.collect()))


def test_cut_at_every_separator():
    texts = ["A b.C\td", "", "e", "f\x0bg h", "...", "é\x00É"]
    code, words, piece = cut(pa.array(["x y", *texts], pa.large_string())[1:])
    got = [[words[c].decode() for c in code[piece == p]] for p in sorted(set(piece))]
    assert got == [w for t in texts for w in pieces_of(t) if w]


def test_against_brute_force(spark):
    rows = made()
    docs = frame(spark, rows)
    for extra in ("n", "word", "h", "rank", "phrase"):
        docs = docs.withColumn(extra, docs["text"])
    for top in (2_000, 7):
        assert answers(mine(docs.repartition(5), 5, top)) == brute(rows, 5, top)


def test_split_prefixes_are_whole(spark, monkeypatch):
    """Tasks so small that prefixes of one, two and three words are dealt by longer ones."""
    rows = made(400, 3)
    monkeypatch.setattr(collocations, "POINTERS", 250)
    held = []
    kept = collocations.split_prefixes
    monkeypatch.setattr(collocations, "split_prefixes", lambda *a: held.append((len(a[1]), kept(*a))) or held[-1][1])
    docs = frame(spark, rows).repartition(3)
    monkeypatch.setattr(collocations, "ROWS", 100)
    assert answers(mine(docs, 2, 500)) == brute(rows, 2, 500)
    assert len(held[0][1]) > held[0][0] > 3


def test_pointers_of_a_hot_prefix_go_to_many_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [("of the " + " ".join(f"v{k}" for k in rng.integers(0, 60, 2)), "en") for _ in range(4_000)]
    texts = frame(spark, rows).select("lang", "text")
    words = collocations.word_counts(texts, 0)
    pieces = collocations.encoded(texts, collocations.bit_map(words), 0)
    hot = words.where("word in ('of', 'the')").select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    split = collocations.split_prefixes(pieces, hot, 20, 100)
    dealt: Counter = Counter()
    for r in collocations.projected(pieces, split, 20).collect():
        dealt[r["part"]] += len(collocations._unpack(bytes(r["block"]))[2])
    assert max(dealt.values()) < 4 * sum(dealt.values()) / 20


def test_blocks_come_back_as_packed():
    rng = np.random.default_rng(6)
    for words in (3, 200, 70_000):
        h = np.unique(rng.integers(0, 1 << 63, words).astype(np.uint64) * np.uint64(2))
        pointers, n = rng.integers(0, len(h), (500, 4)), rng.integers(1, 9, 500)
        got = collocations._unpack(collocations._pack(h, pointers, n))
        assert all(np.array_equal(a, b) for a, b in zip(got, (h, pointers, n), strict=True))


def test_numbers_that_clash_are_noticed(spark):
    rows = [("en", "a", 5), ("en", "b", 6)]
    make = lambda r: spark.createDataFrame(r, "lang string, word string, h long")
    assert not collocations.clashes(make(rows)) and collocations.clashes(make([*rows, ("de", "a", 5)])) and collocations.clashes(make([*rows, ("de", "a", 0)]))


def test_scores_beyond_64_bits(spark):
    a = 9_000_000_000_000_000
    phrases = spark.createDataFrame([(1, 2, 0, 0, 2, a)], "h1 long, h2 long, h3 long, h4 long, words int, a long")
    words = spark.createDataFrame([("en", "x", 1, a + 1), ("en", "y", 2, a + 2)], "lang string, word string, h long, n long")
    (row,) = collocations.scored(phrases, words, words.where("h = 1")).collect()
    assert (row["phrase"], row["l"], row["r"], row["score"]) == ("x y", a + 1, a + 2, 2_000_000 * a // (2 * a + 3))


def test_empty_tables(spark):
    found = mine(frame(spark, []))
    assert found.collect() == [] and found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert mine(frame(spark, [(None, None), ("one word only. each", "en")])).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_registered_query_against_sql_and_brute_force(spark):
    found = collocations.op11_collocations(spark, SF)
    got = answers(found)
    want = brute([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()], 30, 2_000)
    assert got == want and len(got) > 20
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    answer = duck.execute(collocations.ORACLE_SQL)
    assert [d[0] for d in answer.description] == found.columns and sorted(answer.fetchall()) == want
