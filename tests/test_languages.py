"""Language profiles and detection against a plain count of trigrams, and held-out accuracy."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import pytest

from pulsegrid.operators import languages as L
from pulsegrid.plans import kept_queries

SF = "/root/testdata/sf0.01"


def grams(text):
    return [f" {w} "[i : i + 3] for w in re.findall(r"[^\W\d_]+", text.lower()) for i in range(len(w))]


def plain(train, texts, size=L.PROFILE):
    kept = {}
    for lang in sorted({x for x, _ in train}):
        n = Counter(g for x, t in train if x == lang for g in grams(t))
        kept[lang] = dict(sorted(n.items(), key=lambda r: (-r[1], r[0]))[:size])
    known = {g for own in kept.values() for g in own}
    out = []
    for text in texts:
        own = [g for g in grams(text or "") if g in known]
        if not own:
            out.append(("unknown", 0.0))
            continue
        score = {x: sum(math.log((c.get(g, 0) + L.HALF) / (sum(c.values()) + L.HALF * len(known))) for g in own) / max(1, len(own) / L.EVIDENCE) for x, c in kept.items()}
        best = max(score, key=score.get)
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


def test_against_a_plain_count(spark, monkeypatch):
    train = [("en", "the cat and the dog are there, The END"), ("de", "die Katze und der Hund sind da übrigens"), ("fr", "le chat et le chien sont là été"), ("en", ""), ("de", "Straße 12")]
    texts = ["the dog", "der Hund", "chien été", "", None, "   \n", "12 34 !", "qqq zzz xxx", "the Hund", "Là-bas_là", "und " * 3_000, "İstanbul 😀 the", "x"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, detected string")
    known = L.profiles(spark.createDataFrame([*train, (None, "lost words"), ("en", None)], "lang string, text string"))
    monkeypatch.setattr(L, "CHARACTERS", 40)
    got = {r["doc_id"]: (r["detected"], r["confidence"]) for r in L.detect(docs, known).collect()}
    for i, (name, sure) in enumerate(plain(train, texts)):
        assert got[i][0] == name and abs(got[i][1] - sure) <= 0.00501 and got[i][1] == round(got[i][1], 2), texts[i]


def test_profiles_keep_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(L, "PROFILE", 3)
    known = L.profiles(spark.createDataFrame([("en", "aaaa bb aaaa"), ("de", "cc dd")], "lang string, text string"))
    assert known.names == ["de", "en"] and len(known.keys) == 6
    assert [r["detected"] for r in L.detect(spark.createDataFrame([("aaaa",), ("cc",)], "text string"), known).collect()] == ["en", "de"]


def test_nothing_known_and_nothing_asked(spark):
    none = L.profiles(spark.createDataFrame([], "lang string, text string"))
    assert none.names == [] and L.detect(spark.createDataFrame([("the",)], "text string"), none).first()["detected"] == "unknown"
    assert L.detect(spark.createDataFrame([], "text string"), none).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_registered_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = kept_queries.language_detection(spark, SF).collect()
    assert len(got) == len(docs)
    fold = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in docs}
    some = sorted(docs)[::23]
    train = [(docs[i]["lang"], docs[i]["text"]) for i in docs if not fold[i]]
    want = dict(zip(some, plain(train, [docs[i]["text"] for i in some]), strict=True))
    for r in got:
        assert r["held_out"] == fold[r["doc_id"]]
        if r["doc_id"] in want:
            assert r["detected"] == want[r["doc_id"]][0] and abs(r["confidence"] - want[r["doc_id"]][1]) <= 0.00501
    held = [r for r in got if r["held_out"]]
    assert sum(r["detected"] == r["lang"] for r in held) >= 0.97 * len(held)
