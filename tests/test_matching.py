"""Dictionary matching against a loop over the list."""

from __future__ import annotations

import re

import numpy as np

from pulsegrid.operators import matching as A


def test_first_contained_and_nearly_the_same(spark):
    dice = np.random.default_rng(4)
    word = lambda: "".join(dice.choice(list("abcd"), dice.integers(1, 6)))
    names = [(w, int(o)) for o, w in enumerate({word().upper() if k % 3 else word() + "-" + word() for k in range(200)})] + [(None, 900), ("", 901), ("ab", None), ("Été", 500), ("aB", -1), ("--", 902)]
    texts = [None, "", "xyz", "ÉTÉ", "a-b", "A B", "z" * 50_000 + "abcabd"] + [" ".join(word() for _ in range(dice.integers(1, 4))) for _ in range(120)]
    rows = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "id long, t string, in_name string, low_ long").repartition(3)
    listed = spark.createDataFrame(names, "name string, ord long")
    known = sorted(((o, n) for n, o in names if n and o is not None), key=lambda x: (x[0], x[1].lower()))
    bare = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    for most in (A.MOST, 30):
        found = {r["id"]: r["found"] for r in A.first_contained(rows.drop("in_name", "low_"), "t", listed, most=most).collect()}
        got = {r["id"]: r["matched"] for r in A.matched(rows.select("id", "t"), "t", listed, most=most).collect()}
        for i, t in enumerate(texts):
            want = next((n for _, n in known if t and n.lower() in t.lower()), None)
            assert (found[i] or "").lower() == (want or "").lower(), t
            b = bare(t or "")
            same = next((n for _, n in known if b and bare(n) == b), None)
            near = next((n for _, n in known if b and bare(n) and (bare(n) in b or b in bare(n))), None)
            assert bare(got[i] or "") == bare(same or near or ""), t


def test_very_many_names(spark):
    listed = spark.range(100_000).selectExpr("concat('name', id, 'x') as name", "id as ord")
    rows = spark.createDataFrame([("name7x and name99999x",), ("NAME500X",), ("name",)], "t string")
    assert [r["found"] for r in A.first_contained(rows, "t", listed).collect()] == ["name7x", "name500x", None]
    assert A.first_contained(rows.limit(0), "t", listed.limit(0)).collect() == [] and A.matched(rows, "t", listed.limit(0)).count() == 3
