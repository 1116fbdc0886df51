"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources; its set of sources is its membership pattern. Documents are aggregated by
pattern; a min-cost flow routes the patterns' tokens to the sources' quotas, where each further repetition of a
pattern costs more than the one before (convex costs), so repetitions spread as evenly as quotas allow. A pattern
whose flow is c whole passes and a rest takes every document c times and, in the order of a seeded hash, documents
worth the rest once more (of those that are not larger than the rest; all of them again where they don't suffice).

Patterns and sources that no overlap connects are routed apart: the flow of each connected part is solved in a task, by
the same successive shortest paths whether it has one pattern or many. The driver sees one row for each pattern and
source, never documents, and refuses more than PATTERNS of them. The seeded choice needs no global order: the hashes
of each pattern's documents are cut into at most BUCKETS ranges; whole ranges are taken until one would exceed the
rest. Where that one holds more than BUCKET documents, it is cut again; the documents of the last are looked at one
by one.

Nulls: a null source is a source of its own, the last; a null text has size 0. Rows that are wholly alike share a
decision. Empty texts are never taken. Very long texts are read whole, once, by the word count. Other columns are kept as
they are, whatever their names. An empty table gives an empty result. Sizes and targets are words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import documents, few, materialize, text_or_empty, word_count

WEIGHTS, MOST_REPEATS, SEED, BUCKET, BUCKETS = (1, 2, 3), 3, 20_240_229, 512, 65_536
#: Most patterns that the driver connects.
PATTERNS = 2_000_000
#: Documents looked at for an exchange; hashes of documents lie below SPAN.
EXCHANGED = 1_024
SPAN = (1 << 63) - 1


class Source(NamedTuple):
    source: str | None
    size: int
    target: float


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = MOST_REPEATS) -> list[Source]:
    """Targets by weight, repeating over the sources in code point order (null last); none exceeds most times its
    source's size, and what it can't take is shared anew by weight among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest, by = total - sum(capped.values()), sum(weight[s] for s in free)
        found = {s: rest * weight[s] / by for s in free}
        above = [s for s in free if found[s] > most * sizes[s]]
        if not above:
            return [Source(s, sizes[s], float(capped.get(s, found.get(s, 0.0)))) for s in order]
        capped |= {s: most * sizes[s] for s in above}


def connected(patterns: Iterable[tuple], sources: Iterable) -> dict[tuple, int]:
    """The number of each pattern's part: patterns that share sources, directly or over others, have one."""
    root = {s: s for s in sources}

    def find(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for name in patterns:
        for s in name[1:]:
            root[find(s)] = find(name[0])
    number: dict = {}
    return {name: number.setdefault(find(name[0]) if name else None, len(number)) for name in patterns}


def flow(patterns: dict[tuple, int], quotas: dict, most: int = MOST_REPEATS) -> dict[tuple, dict]:
    """Tokens that each pattern gives to each of its sources: a maximum flow of least repetition cost.

    patterns: tokens by tuple of sources; quotas: whole tokens by source. The k-th pass over a pattern costs 2k - 1 a
    token. Patterns that share sources, directly or over others, are solved together, all others apart.
    """
    out = {}
    part = connected(patterns, quotas)
    for k in dict.fromkeys(part.values()):
        names = [name for name in patterns if part[name] == k]
        out |= _joint_flow({name: patterns[name] for name in names}, {s: quotas[s] for name in names for s in name}, most)
    return out


def routed(spark: SparkSession, patterns: list[tuple[str, tuple, int]], quotas: dict, most: int) -> DataFrame:
    """(mix_pattern, mix_passes, mix_limit): whole passes and the rest that the flow takes of (text of the pattern,
    sources, tokens). Each connected part is a group, whose flow is solved in a task."""
    part = connected([name for _, name, _ in patterns], quotas)
    rows = [(part[name], text, list(name), size, [quotas[s] for s in name]) for text, name, size in patterns]
    table = spark.createDataFrame(rows, "part int, mix_pattern string, sources array<string>, size long, quotas array<long>")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("mix_pattern")
        names = [tuple(s) for s in group["sources"]]
        own = {s: int(q) for name, of in zip(names, group["quotas"], strict=True) for s, q in zip(name, of, strict=True)}
        found = _joint_flow(dict(zip(names, map(int, group["size"]), strict=True)), own, most)
        taken = [divmod(sum(found[n].values()), int(size)) if size else (0, 0) for n, size in zip(names, group["size"], strict=True)]
        return pd.DataFrame({"mix_pattern": group["mix_pattern"], "mix_passes": [w for w, _ in taken], "mix_limit": [r for _, r in taken]})

    return table.groupBy("part").applyInPandas(solve, "mix_pattern string, mix_passes int, mix_limit long")


def _joint_flow(patterns: dict[tuple, int], quotas: dict, most: int) -> dict[tuple, dict]:
    """Successive shortest paths with potentials."""
    names = list(patterns)
    at = {("p", i): i + 1 for i in range(len(names))} | {("s", s): len(names) + 1 + j for j, s in enumerate(quotas)}
    sink = len(at) + 1
    graph: list[list[int]] = [[] for _ in range(sink + 1)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)
        return len(to) - 2

    links = {}
    for i, name in enumerate(names):
        for k in range(1, most + 1):
            edge(0, at["p", i], patterns[name], 2 * k - 1)
        for s in name:
            links[i, s] = edge(at["p", i], at["s", s], most * patterns[name], 0)
    for s, quota in quotas.items():
        edge(at["s", s], sink, quota, 0)
    potential = [0] * (sink + 1)
    while True:
        far, via = [None] * (sink + 1), [-1] * (sink + 1)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] > 0:
                    n = d + cost[e] + potential[x] - potential[to[e]]
                    if far[to[e]] is None or n < far[to[e]]:
                        far[to[e]], via[to[e]] = n, e
                        heapq.heappush(heap, (n, to[e]))
        if far[sink] is None:
            break
        longest = max(d for d in far if d is not None)
        potential = [p + (longest if d is None else d) for p, d in zip(potential, far, strict=True)]
        path, x = [], sink
        while x:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return {name: {s: room[links[i, s] ^ 1] for s in name} for i, name in enumerate(names)}


def sized(docs: DataFrame, sources: Column | None = None, seed: int = SEED) -> DataFrame:
    """(…, size, sources: sorted distinct array, pattern: its text, chance: a seeded 64-bit hash of the row)."""
    own = F.array(F.col("source")) if sources is None else F.array_sort(F.array_distinct(sources))
    return docs.withColumns({
        "mix_size": word_count(), "mix_sources": own.cast("array<string>"),
        "mix_chance": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), text_or_empty()), 1),
    }).withColumn("mix_pattern", F.to_json(F.struct("mix_sources")))


class Mix(NamedTuple):
    """sources: their targets; plan: (mix_pattern, mix_passes, mix_limit, mix_extra, mix_low, mix_high), one row a
    pattern: of the documents up to size mix_limit all are taken mix_extra times more, and those whose hash is below
    mix_low once more; chosen: (mix_pattern, mix_chance, mix_size, mix_more) of those from mix_low to below mix_high."""

    sources: list[Source]
    plan: DataFrame
    chosen: DataFrame


def _eligible() -> Column:
    return (F.col("mix_size") > 0) & (F.col("mix_size") <= F.col("mix_limit"))


def _narrowed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with the range that each pattern's rest ends in, of about BUCKET documents. A range that hardly shrinks
    holds equal rows, which are looked at as one."""
    wider = F.col("mix_n") > 2 * BUCKET
    while True:
        wide = plan.where(wider)
        if not wide.limit(1).count():
            return plan
        ranges = F.greatest(F.lit(1), F.least(F.lit(BUCKETS), 2 * F.ceil(F.col("mix_n") / BUCKET), F.col("mix_high") - F.col("mix_low")))
        # rounded up, so that every hash lies in one of the ranges
        step = F.expr("(mix_high - mix_low) div ranges + CASE WHEN (mix_high - mix_low) % ranges > 0 THEN 1 ELSE 0 END")
        wide = wide.withColumn("ranges", ranges.cast("long")).withColumn("step", step)
        inside = rows.join(few(wide), "mix_pattern").where(_eligible() & (F.col("mix_chance") >= F.col("mix_low")) & (F.col("mix_chance") < F.col("mix_high")))
        by = inside.groupBy("mix_pattern", F.expr("(mix_chance - mix_low) div step").alias("b")).agg(F.sum("mix_size").alias("s"), F.count(F.lit(1)).alias("n"))
        # at most BUCKETS rows of a pattern
        upto = by.selectExpr("*", "sum(s) OVER (PARTITION BY mix_pattern ORDER BY b) AS upto").join(few(wide), "mix_pattern").where("upto > mix_gap")
        first = upto.groupBy("mix_pattern").agg(F.min(F.struct("b", "upto", "s", "n")).alias("e"))
        at = F.col("mix_low") + F.col("e.b") * F.col("step")
        cut = wide.join(first, "mix_pattern", "left").select(
            "mix_pattern", "mix_passes", "mix_limit", "mix_extra", F.when(F.col("e").isNull(), F.lit(0)).otherwise(F.col("mix_gap") - F.col("e.upto") + F.col("e.s")).cast("long").alias("mix_gap"),
            F.coalesce(at, F.col("mix_high")).cast("long").alias("mix_low"), F.coalesce(F.least(F.col("mix_high") - F.col("step"), at) + F.col("step"), F.col("mix_high")).cast("long").alias("mix_high"),
            F.when(F.col("e.n") * 10 <= F.col("mix_n") * 9, F.col("e.n")).otherwise(0).alias("mix_n"),
        )
        plan = materialize(plan.where(~wider).unionByName(cut), "mix-plan")


def plan_mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST_REPEATS) -> Mix:
    """Decide the mix of sized() rows (no text needed)."""
    spark = rows.sparkSession
    found = rows.groupBy("mix_pattern").agg(F.first("mix_sources").alias("s"), F.sum("mix_size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("mix_pattern").limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns: give fewer sources")
    sizes: dict = {}
    for r in found:
        for s in r["s"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    aims = targets(sizes, weights, share, most) if sizes else []
    quotas = {a.source: round(a.target) for a in aims}
    small = materialize(routed(spark, [(r["mix_pattern"], tuple(r["s"]), r["size"]) for r in found], quotas, most), "mix-passes")
    by = rows.join(few(small), "mix_pattern").where(_eligible()).groupBy("mix_pattern").agg(F.sum("mix_size").alias("e"), F.count(F.lit(1)).alias("n"))
    extra = F.coalesce(F.least(F.expr("mix_limit div e"), F.lit(most) - F.col("mix_passes")), F.lit(0)).cast("int")
    gap = F.when(F.col("mix_passes") + F.col("mix_extra") < most, F.col("mix_limit") - F.col("mix_extra") * F.col("e")).otherwise(0)
    plan = small.join(by, "mix_pattern", "left").withColumn("mix_extra", extra).withColumn("mix_gap", F.coalesce(gap, F.lit(0)).cast("long"))
    some = F.col("mix_gap") > 0  # else nobody is taken once more
    plan = plan.select(
        "mix_pattern", "mix_passes", "mix_limit", "mix_extra", "mix_gap", F.lit(0).cast("long").alias("mix_low"),
        F.when(some, F.lit(SPAN)).otherwise(0).cast("long").alias("mix_high"), F.when(some, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("mix_n"),
    )
    edge = _narrowed(rows, materialize(plan, "mix-plan"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        """Documents in seeded order as long as they fit the gap, again from the start while repeats are left and the
        gap is; then a few exchanges, each the one that brings the sum nearest: a document in, one out, or both."""
        group = group.sort_values(["mix_chance", "mix_size"]).reset_index(drop=True)
        gap, units = int(group["mix_gap"].iloc[0]), group["units"].to_numpy(np.int64)
        room, more = most - int(group["mix_passes"].iloc[0]) - int(group["mix_extra"].iloc[0]), np.zeros(len(group), np.int64)
        for _ in range(room):
            for i, n in enumerate(units.tolist()):
                if 0 < n <= gap:
                    more[i] += 1
                    gap -= n
        for _ in range(4):
            into, out = np.flatnonzero((more < room) & (units > 0))[:EXCHANGED], np.flatnonzero(more)[:EXCHANGED]
            change = np.concatenate([units[into], [0]])[:, None] - np.concatenate([units[out], [0]])[None]
            k = int(np.abs(gap - change).argmin())
            if gap == 0 or abs(gap - change.flat[k]) >= abs(gap):
                break
            i, j = divmod(k, change.shape[1])
            gap -= int(change.flat[k])
            if i < len(into):
                more[into[i]] += 1
            if j < len(out):
                more[out[j]] -= 1
        return group[["mix_pattern", "mix_chance", "mix_size"]].assign(mix_more=more.astype("int32"))

    at_edge = rows.join(few(edge), "mix_pattern").where((F.col("mix_chance") >= F.col("mix_low")) & (F.col("mix_chance") < F.col("mix_high")) & (F.col("mix_gap") > 0) & _eligible())
    alike = at_edge.groupBy("mix_pattern", "mix_chance", "mix_size", "mix_gap", "mix_passes", "mix_extra").agg(F.sum("mix_size").alias("units"))
    chosen = alike.groupBy("mix_pattern").applyInPandas(fill, "mix_pattern string, mix_chance long, mix_size long, mix_more int")
    return Mix(aims, edge.select("mix_pattern", "mix_passes", "mix_limit", "mix_extra", "mix_low", "mix_high"), materialize(chosen.where("mix_more > 0"), "mix-chosen"))


def with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds mix_copies, how often the mix takes a sized() row."""
    placed = rows.join(few(mix.plan), "mix_pattern").join(few(mix.chosen), ["mix_pattern", "mix_chance", "mix_size"], "left")
    once = F.when(F.col("mix_chance") < F.col("mix_low"), 1).otherwise(F.coalesce("mix_more", F.lit(0)))
    more = F.when(_eligible(), F.col("mix_extra") + once).otherwise(0)
    return placed.withColumn("mix_copies", F.when(F.col("mix_size") > 0, F.col("mix_passes") + more).otherwise(0))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST_REPEATS, sources: Column | None = None, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it; the columns of docs."""
    kept = "mix_row"
    while kept in docs.columns:
        kept += "_"
    rows = sized(docs.withColumn(kept, F.struct(*docs.columns)), sources, seed)
    mix = plan_mix(materialize(rows.select("mix_pattern", "mix_sources", "mix_size", "mix_chance"), "mix-sizes"), weights, share, most)
    taken = with_copies(rows, mix).where("mix_copies > 0")
    return taken.withColumn("mix_n", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(f"{kept}.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(sized(documents(spark, sf_dir).select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    mix = plan_mix(rows)
    aims = spark.createDataFrame(mix.sources, "source string, source_size long, target double")
    found = with_copies(rows, mix).withColumnRenamed("source", "own").join(few(aims), F.col("own").eqNullSafe(F.col("source")))
    return found.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"))
