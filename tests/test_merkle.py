"""Merkle levels, proofs and differences against plain Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from pulsegrid.operators import merkle as L


def above(a, b):
    x, y = sorted((a, b))
    return "0x" + hashlib.sha256(bytes.fromhex(x[2:]) + bytes.fromhex(y[2:])).hexdigest()


def plain(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        level = out[-1]
        out.append([above(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])
    return out


def leaf(i):
    return "0x" + hashlib.sha256(str(i).encode()).hexdigest()


def test_levels_proofs_and_differences(spark):
    trees = {f"t{n}": [leaf((n, i)) for i in range(n)] for n in (1, 2, 3, 7, 8, 100, 133)} | {"same": [leaf(1)] * 5}
    rows = [(t, i, x) for t, own in trees.items() for i, x in enumerate(own)]
    frame = spark.createDataFrame(rows, "tree string, at long, leaf string").repartition(5)
    placed = L.placed(frame, "tree", ["at"])
    assert placed.where("at <> place").count() == 0
    table = L.levels(placed, "tree").checkpoint()
    want = {(t, k, i): x for t, own in trees.items() for k, level in enumerate(plain(own)) for i, x in enumerate(level)}
    got = {(r["tree"], r["level"], r["place"]): r["node"] for r in table.collect()}
    assert {k: got[k] for k in want} == want  # small trees' roots go on upwards with the others
    assert {r["tree"]: (r["root"], r["leaves"]) for r in L.roots(table).collect()} == {t: (plain(own)[-1][0], len(own)) for t, own in trees.items()}
    checked = L.proofs(table, placed.select("tree", "place")).join(placed, ["tree", "place"]).join(L.roots(table), "tree")
    ok, forged = L.leads_to(F.col("leaf"), F.col("proof"), F.col("root")), L.leads_to(F.lit(leaf("forged")), F.col("proof"), F.col("root"))
    assert checked.where(ok).count() == len(rows) and checked.where(forged).count() == 0
    changed = {("t3", 2), ("t100", 0), ("t100", 99), ("t133", 132), ("t1", 0)}
    now = placed.withColumn("leaf", F.when(F.concat_ws(":", "tree", "place").isin(*[f"{t}:{i}" for t, i in changed]), F.lit(leaf("new"))).otherwise(F.col("leaf"))).where("not (tree = 't8' and place >= 6)")
    wrong = {(r["tree"], r["place"]) for r in L.differing(table, L.levels(now, "tree")).collect()}
    assert wrong == changed | {("t8", 6), ("t8", 7)}


def test_nothing_to_build(spark):
    none = spark.createDataFrame([], "tree string, place long, leaf string")
    table = L.levels(none, "tree")
    assert table.collect() == [] and L.roots(table).collect() == [] and L.differing(table, table).collect() == []
