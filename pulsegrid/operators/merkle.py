"""Merkle trees as a table of levels: (tree, level, place, node), built and checked by native joins.

Level 0 are the leaves in order; a parent is the SHA-256 of its two children, the smaller first; a node without a
neighbour moves up as it is. A tree may have any number of leaves: places come from range partitions, and a level is a
grouping by half the place. Proofs are read from the levels, and differences between two trees of the same shape are
found from their roots down, looking only at children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.scoreboard import row_numbers
from pulsegrid.session import checkpoint_folder


def joined(a: Column, b: Column) -> Column:
    """The node above two nodes (0x and hexadecimal digits), whatever their order."""
    raw = lambda x: F.unhex(F.substring(x, 3, 64))
    return F.concat(F.lit("0x"), F.sha2(F.concat(raw(F.least(a, b)), raw(F.greatest(a, b))), 256))


def placed(leaves: DataFrame, tree: str, order: list[str], leaf: str = "leaf") -> DataFrame:
    """Adds place, from 0, of each leaf within its tree; order must tell the leaves of a tree apart."""
    return row_numbers(leaves, [tree], order, "place").withColumn("place", F.col("place") - 1)


def levels(leaves: DataFrame, tree: str, leaf: str = "leaf") -> DataFrame:
    """(tree, level, place, node) of all levels of leaves (tree, place, leaf), up to the roots."""
    checkpoint_folder(leaves.sparkSession)
    level = leaves.select(F.col(tree).alias("tree"), F.lit(0).alias("level"), F.col("place").cast("long").alias("place"), F.col(leaf).alias("node")).checkpoint()
    found, k = level, 0
    while level.where("place > 0").limit(1).count():
        k += 1
        pairs = level.groupBy("tree", F.shiftright("place", 1).alias("place")).agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n"))
        level = pairs.select("tree", F.lit(k).alias("level"), "place", F.when(F.col("n") == 2, joined(F.col("a"), F.col("b"))).otherwise(F.col("a")).alias("node")).checkpoint()
        found = found.unionByName(level)
    return found


def roots(table: DataFrame) -> DataFrame:
    """(tree, root, leaves): the node at place 0 of the first level that has no other, and the number of leaves."""
    size = table.groupBy("tree", "level").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("root"))
    top = size.where("n = 1").groupBy("tree").agg(F.min_by("root", "level").alias("root"))
    return top.join(size.where("level = 0").select("tree", F.col("n").alias("leaves")), "tree")


def proofs(table: DataFrame, asked: DataFrame) -> DataFrame:
    """(tree, place, proof) of the asked leaves (tree, place): the neighbours from the bottom up, where there are any."""
    top = table.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]  # about log2 of the largest tree
    steps = asked.select("tree", "place", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")).withColumn("beside", F.expr("shiftright(place, level)").bitwiseXOR(F.lit(1)))
    near = table.select("tree", "level", F.col("place").alias("beside"), "node")
    met = steps.join(near, ["tree", "level", "beside"], "left").groupBy("tree", "place").agg(F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("level", "node")))).alias("p"))
    return met.select("tree", "place", F.transform("p", lambda x: x["node"]).alias("proof"))


def leads_to(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether the proof leads from the leaf to the root."""
    return F.aggregate(proof, leaf, lambda a, p: joined(a, p)) == root


def differing(anchored: DataFrame, current: DataFrame) -> DataFrame:
    """(tree, place) of the anchored leaves that the current levels don't have alike; from the roots down, level by level,
    only below nodes that differ. Trees whose current shape has fewer leaves differ where they lack them."""
    checkpoint_folder(anchored.sparkSession)
    now = current.select("tree", "level", "place", F.col("node").alias("now"))
    top = anchored.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
    height = anchored.groupBy("tree").agg(F.max("level").alias("level"))
    suspects = height.select("tree", "level", F.lit(0).cast("long").alias("place"))
    for k in range(top, -1, -1):
        own = suspects.where(F.col("level") == k)
        wrong = anchored.where(F.col("level") == k).join(own, ["tree", "level", "place"], "left_semi").join(now.where(F.col("level") == k), ["tree", "level", "place"], "left")
        wrong = wrong.where(~F.col("node").eqNullSafe(F.col("now"))).select("tree", "place").checkpoint()
        if k:
            below = wrong.select("tree", F.lit(k - 1).alias("level"), F.explode(F.array(F.col("place") * 2, F.col("place") * 2 + 1)).alias("place"))
            suspects = suspects.where(F.col("level") < k).unionByName(below)
    return wrong


def audit(anchors: DataFrame, anchored: DataFrame, leaves: DataFrame, most: int = 10) -> DataFrame:
    """(tree, anchored_at, verdict, tampered: number of leaves) of the newest anchors (tree, anchored_at): leaves
    (tree, place, leaf) of the present rows are hashed anew for these alone and held against the anchored levels."""
    newest = anchors.orderBy(F.desc("anchored_at"), "tree").limit(most)
    keep = lambda rows: rows.join(F.broadcast(newest.select("tree")), "tree", "left_semi")  # noqa: E731  most rows
    own = keep(leaves)
    wrong = differing(keep(anchored), levels(own, "tree")).groupBy("tree").agg(F.count(F.lit(1)).alias("tampered"))
    there = own.select("tree", F.lit(True).alias("there")).distinct()
    found = newest.join(there, "tree", "left").join(wrong, "tree", "left")
    verdict = F.when(F.col("there").isNull(), "MISSING").when(F.coalesce("tampered", F.lit(0)) > 0, "TAMPER_DETECTED").otherwise("INTACT")
    return found.select("tree", "anchored_at", verdict.alias("verdict"), F.when(F.col("there").isNotNull(), F.coalesce("tampered", F.lit(0))).cast("long").alias("tampered"))


def field_places(leaves: DataFrame, key: str) -> DataFrame:
    """(tree, place, leaf) of the fields (key, field, leaf) of each row: places in order of the fields' names."""
    w = Window.partitionBy(key).orderBy("field")  # a row's fields
    return leaves.select(F.col(key).alias("tree"), (F.row_number().over(w) - 1).cast("long").alias("place"), "leaf")
