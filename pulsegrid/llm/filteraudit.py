"""Filter interaction audit: what each of five document filters removes, in every order in which they can be applied.

Every row gets a mask of the filters that it fails. For each of the 32 masks and 120 orders a table, built once, holds
the step at which such a row goes. Tasks count rows by part and mask, look the steps up and add removals by part, order
and step; these partial arrays are summed by Spark. Work and memory of a task don't depend on how large a part is.

Duplicates are judged table-wide: a row fails E if a row with a smaller id has the same text (told by its SHA-256). Rows
that are alike are counted before they are dealt out, and the first id of a text meets its rows by text and id together,
so a text with millions of copies is nobody's single key.

Nulls: a null text is empty, a null part the empty string; a null id comes after all others and has no labels. Labels with a
null id count for nothing; of several labels of a document the largest counts. Repeated rows (same id, same text) are no
duplicates of each other: each is counted, none has a smaller id. Very long texts are read whole, by native expressions.
Other columns are not read, whatever their names. An empty table gives an empty result; every part that occurs has all
600 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.shared import WORD, documents, materialize, text_or_empty

#: Bounds of the filters: words; percent of distinct words; percent of capitals; the characters asked for by D.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 3, "[#$%&*|]"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Parts that a task holds counts of before it hands them on; parts expanded at once.
PARTS, TOGETHER = 4_096, 64
#: Ranks null ids behind all others.
LAST = (1 << 63) - 1
COUNTS = ("removed", "good_lost", "toxic_lost", "failing", "unique_fails", "total")


def first_failures() -> np.ndarray:
    """(mask, order) -> number of the step, from 0, of the first filter that the mask fails; STEPS where it fails none."""
    fails = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1  # mask by filter
    places = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    in_order = fails[:, places] > 0  # mask by order by step
    return np.where(in_order.any(axis=2), in_order.argmax(axis=2), STEPS)


def conditions(text: Column, words: Column) -> list[Column]:
    """The failures of A to D; E is seen only table-wide."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT * n, 100 * capitals > CAPITALS * F.length(text), text.rlike(SYMBOLS)]


def facts(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, rank, text_key, part, mask, n): the rows by what the audit asks of them; the mask lacks E."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
    cut = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("text"), F.col("words")))), F.lit(0))
    seen = cut.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("rank"), F.unhex(F.sha2("text", 256)).alias("text_key"), "part", mask.alias("mask"))
    return seen.groupBy("doc_id", "rank", "text_key", "part", "mask").agg(F.count("*").alias("n"))


def with_duplicates(found: DataFrame) -> DataFrame:
    """The facts with E in their masks."""
    first = found.groupBy(F.col("text_key").alias("first_key")).agg(F.min("rank").alias("first_rank"))
    joined = found.join(first, (F.col("text_key") == F.col("first_key")) & (F.col("rank") == F.col("first_rank")), "left")
    again = F.when(F.col("first_key").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return joined.withColumn("mask", F.col("mask") + again).drop("first_key", "first_rank")


def with_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The facts with good and toxic; rows without an id are spread over all tasks."""
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id"), F.lit(0).cast("long").alias("label_spread")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text_key").bitwiseOR(F.lit(1))).otherwise(F.lit(0))
    keyed = found.withColumn("spread", spread)
    joined = keyed.join(own, (F.coalesce("doc_id", F.lit(0)) == F.col("label_id")) & (F.col("spread") == F.col("label_spread")), "left")
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return joined.select("part", "mask", "n", is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def _expanded(parts: list[str], held: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, filter_order, step, counts) of held: (part, all/good/toxic, mask) counts."""
    masks, orders = table.shape
    bits = np.arange(masks)
    places = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])  # order by step
    for k in range(0, len(parts), TOGETHER):
        own = held[k : k + TOGETHER]
        p = len(own)
        at = (np.arange(p)[:, None, None] * orders + np.arange(orders)) * (STEPS + 1) + table  # part by mask by order
        removed = [np.bincount(at.ravel(), np.repeat(own[:, kind].ravel(), orders), p * orders * (STEPS + 1)).reshape(p, orders, STEPS + 1)[:, :, :STEPS] for kind in range(3)]
        failing = np.stack([own[:, 0, (bits >> f) & 1 == 1].sum(axis=1) for f in range(STEPS)], axis=1)[:, places]
        unique = own[:, 0, 1 << np.arange(STEPS)][:, places]
        total = np.broadcast_to(own[:, 0].sum(axis=1)[:, None, None], unique.shape)
        numbers = [pa.array(x.astype(np.int64).ravel()) for x in (*removed, failing, unique, total)]
        names = pa.array(np.repeat(np.array(parts[k : k + TOGETHER], object), orders * STEPS), pa.string())
        order = pa.array(np.tile(np.repeat(np.array(ORDERS, object), STEPS), p), pa.string())
        step = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), p * orders))
        yield pa.RecordBatch.from_arrays([names, order, step, *numbers], names=["part", "filter_order", "step", *COUNTS])


def removals(found: DataFrame) -> DataFrame:
    """Partial counts (part, filter_order, step, …) of each task; found: (part, mask, n, good, toxic)."""
    table = first_failures()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        held = np.zeros((64, 3, 1 << STEPS))
        for batch in batches:
            part, mask, n, good, toxic = (batch.column(i) for i in range(5))
            coded = part.dictionary_encode()
            mine = np.array([number.setdefault(p, len(number)) for p in coded.dictionary.to_pylist()], np.int64)
            if len(number) > len(held):
                held = np.concatenate([held, np.zeros((max(len(held), len(number)), 3, 1 << STEPS))])
            cell = mine[coded.indices.to_numpy()] * (1 << STEPS) + mask.to_numpy() if len(mine) else np.zeros(0, np.int64)
            weight = n.to_numpy()
            for kind, on in enumerate((np.ones(len(weight), bool), good.to_numpy(zero_copy_only=False), toxic.to_numpy(zero_copy_only=False))):
                held[:, kind] += np.bincount(cell[on], weight[on], len(held) << STEPS).reshape(-1, 1 << STEPS)
            if len(number) >= PARTS:
                yield from _expanded(list(number), held[: len(number)], table)
                number, held = {}, np.zeros((64, 3, 1 << STEPS))
        yield from _expanded(list(number), held[: len(number)], table)

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return found.select("part", "mask", "n", "good", "toxic").mapInArrow(run, f"part string, filter_order string, step int, {kinds}")


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    seen = materialize(facts(docs, part), "filter-facts")
    partial = removals(with_labels(with_duplicates(seen), labels))
    summed = partial.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")  # five rows
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # a row an order
    return summed.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(same).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, coalesce(doc_id, {LAST}) AS place, min(coalesce(doc_id, {LAST})) OVER (PARTITION BY t) AS first_place FROM d),
m AS (SELECT doc_id, part, [len(words) < {WORDS}, 100 * len(list_distinct(words)) < {DISTINCT} * len(words), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {CAPITALS} * length(t), regexp_matches(t, '{SYMBOLS}'), place > first_place] AS fails FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT m.part, m.fails, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS i, unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS ids FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT filter_order, ids, unnest(range(1, 6)) AS step FROM o),
x AS (SELECT part, filter_order, step, n, good, bad, fails[ids[step]] AS failing, len(list_filter(ids[1:step], lambda i: fails[i])) AS upto, len(list_filter(ids, lambda i: fails[i])) AS ever FROM r, s),
y AS (SELECT part, filter_order, step, filter_order[step] AS letter, coalesce(sum(n) FILTER (upto = 0), 0) AS kept, coalesce(sum(n) FILTER (failing AND upto = 1), 0) AS removed, coalesce(sum(n) FILTER (failing AND upto > 1), 0) AS redundant,
  coalesce(sum(n) FILTER (failing AND ever = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (failing AND upto = 1), 0) AS good_lost, coalesce(sum(bad) FILTER (failing AND upto = 1), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y
"""
