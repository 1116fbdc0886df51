"""Approximate nearest neighbours with balanced posting lists.

Equal vectors are one class (its smallest ids stand for it), so a vector that very many rows share is indexed and
searched once. A bounded sample of classes is clustered into balanced lists: k-means whose large clusters are split
again; where more lists are asked for than the driver's sample can carry, tasks cluster each list's own sample once
more. Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2), M the largest norm, 0 for queries.
Every class goes to its nearest centroid's list and, where it lies at the boundary to others, to theirs as well: at
most EDGE of the way from the bisecting plane to its own centroid. A query finds centroids by best-first search in a
neighbour graph over the centroids (its links are found once, in tasks, and broadcast with them), and searches the lists whose distance is at most a ratio times the nearest's, and
more of them in order of distance until they hold enough classes. The ratio is fitted: the least at which vectors of
the sample find RECALL of their true neighbours within the sample. On clustered vectors it stays near 1; on vectors
without any structure, distances to all centroids are alike and it selects many lists. Lists are searched in blocks of
bounded size on both sides; scores are inner products of the original components in double precision.

Fitted on a sample: centroids and the ratio (at most SAMPLE vectors on the driver, SECOND for each list in tasks).
Indexed and searched: every row. Recall, against brute force, is tested to be at least 0.9. Beyond MOST_LISTS lists
of LIST classes, lists grow with the data.

Nulls: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id
or vectors of another length than most. Rows that repeat an id and vector count once; a query never finds its own
id. Ties go to the smaller id. Fewer candidates than asked for: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import documents, materialize

#: Neighbours; classes meant for a list; most lists; most vectors and bytes of the driver's sample; sampled vectors for each list, on the driver and in tasks.
NEAREST, LIST, MOST_LISTS, SAMPLE, SAMPLE_BYTES, PER_LIST, SECOND = 20, 256, 65_536, 65_536, 32_000_000, 16, 32
#: Share of true neighbours that the fitted ratio finds within the sample; its queries; the ratio where nothing can be fitted; lists a class goes to; its place between the bisecting plane (0) and its own centroid (1).
RECALL, ASKED, RATIO, COPIES, EDGE = 0.95, 256, 1.2, 4, 0.05
#: Classes and queries of one block; links of a centroid; rows handled at once; distances held at once.
BLOCK, QUERY_BLOCK, DEGREE, TOGETHER, HELD, SEED = 4_096, 2_048, 24, 512, 4_000_000, 11
#: Centroids linked at once; width that a query begins with; times the width of a search from which on all centroids are looked at.
LINKED, PROBED, SCANNED = 1_024, 16, 4
#: Times the root of the number of centroids: where searches look first.
ENTRIES = 2


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v: array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    kept = kept.where(~F.coalesce(bad, F.lit(True))).where(F.exists("v", lambda x: x != 0))
    sizes = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """(v, cid: smallest id, ids: the most smallest ids) of every distinct vector."""
    ranked = rows.dropDuplicates(["id", "v"]).selectExpr("v", "id", "row_number() OVER (PARTITION BY v ORDER BY id) AS rank")
    return ranked.where(F.col("rank") <= most).groupBy("v").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """k-means; clusters of over twice the mean size are split again, those under an eighth of it dissolved."""
    random = np.random.default_rng(seed)

    def means(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        c = x[random.permutation(len(x))[:k]]
        for _ in range(rounds):
            own = np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=len(c))
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return c, own

    if lists <= 1:
        return x.mean(0, keepdims=True)
    mean, out = len(x) / lists, []
    todo = [(x, lists)]
    while todo:
        part, k = todo.pop()
        c, own = means(part, min(k, len(part)))
        for j in range(len(c)):
            inside = part[own == j]
            if len(inside) > 2 * mean and len(inside) < len(part) and len(np.unique(inside[:64], axis=0)) > 1:
                todo.append((inside, max(2, round(len(inside) / mean))))
            elif len(inside) >= mean / 8:
                out.append(c[j])
    return np.array(out) if out else x.mean(0, keepdims=True)


class CentroidGraph:
    """Centroids with links to their neighbours and to a few others; best-first search for many points at once. What a
    search holds and measures of a point depends on its width and the links, not on the number of centroids."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray):
        self.c, self.links = centroids, links
        self.norms = (centroids * centroids).sum(1)
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, min(len(centroids), max(16, int(ENTRIES * len(centroids) ** 0.5)))).astype(int))
        self.measured = 0

    def away(self, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of pairs (row of x, centroid)."""
        self.measured += len(row)
        return np.maximum((x * x).sum(1)[row] - 2 * np.einsum("pd,pd->p", self.c[at], x[row]) + self.norms[at], 0)

    def scan(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        self.measured += len(x) * len(self.c)
        d = squared(x, self.c)
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        return order, np.sqrt(np.take_along_axis(d, order, 1))

    def search(self, x: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances), nearest first, of the width best that best-first search meets; inf (and 0) where none.
        A search about as wide as there are centroids looks at all of them."""
        n, k = len(x), len(self.c)
        width = min(width, k)
        if not n or SCANNED * width >= k:
            return self.scan(x, width)
        most = max(1, HELD // (at_once * self.links.shape[1] * width))
        if n > most:
            parts = [self.search(x[i : i + most], width, at_once) for i in range(0, n, most)]
            return np.concatenate([a for a, _ in parts]), np.concatenate([d for _, d in parts])
        ids, far, done = np.full((n, width), -1), np.full((n, width), np.inf), np.zeros((n, width), bool)
        start = squared(x, self.c[self.entries])
        self.measured += start.size
        first = np.argsort(start, axis=1, kind="stable")[:, :width]
        ids[:, : first.shape[1]], far[:, : first.shape[1]] = self.entries[first], np.take_along_axis(start, first, 1)
        at_once = min(at_once, width)
        while True:
            open_ = np.where(done, np.inf, far)
            best = np.argpartition(open_, at_once - 1, axis=1)[:, :at_once]
            live = np.isfinite(np.take_along_axis(open_, best, 1))
            active = np.flatnonzero(live.any(1))
            if not len(active):
                break
            own, live = best[active], live[active]
            np.put_along_axis(done, best, np.take_along_axis(done, best, 1) | np.isfinite(np.take_along_axis(open_, best, 1)), 1)
            met = np.where(live[:, :, None], self.links[np.take_along_axis(ids[active], own, 1)], -1).reshape(len(active), -1)
            met = np.sort(met, axis=1)
            new = met >= 0
            new[:, 1:] &= met[:, 1:] != met[:, :-1]
            new &= ~(met[:, :, None] == ids[active][:, None, :]).any(2)
            d = np.full(met.shape, np.inf)
            row, col = np.nonzero(new)
            d[row, col] = self.away(x, active[row], met[row, col])
            every_id, every = np.concatenate([ids[active], np.where(new, met, -1)], axis=1), np.concatenate([far[active], d], axis=1)
            keep = np.argpartition(every, width - 1, axis=1)[:, :width]
            ids[active], far[active] = np.take_along_axis(every_id, keep, 1), np.take_along_axis(every, keep, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(met.shape, bool)], axis=1), keep, 1)
        order = np.lexsort((ids, far))
        far = np.take_along_axis(far, order, 1)
        return np.where(np.isfinite(far), np.take_along_axis(ids, order, 1), 0), np.sqrt(far)


def linked(centroids: np.ndarray, start: int, stop: int, degree: int = DEGREE, seed: int = SEED) -> np.ndarray:
    """Links of the centroids from start to stop: half to their nearest ones, half to ones at ever farther places in the
    order of distance, so that a search can leave a crowd, and a few to any."""
    n = len(centroids)
    places = np.unique(np.concatenate([np.arange(1, degree // 2 + 1), np.geomspace(degree // 2 + 1, max(n - 1, degree), degree - degree // 2).astype(int)]))
    order = np.argsort(squared(centroids[start:stop], centroids), axis=1)
    near = order[:, np.minimum(places, n - 1)]
    other = np.random.default_rng((seed, start)).integers(0, n, (stop - start, max(4, degree + 6 - len(places))))
    return np.concatenate([near, other], axis=1).astype(np.int32)


def links_of(spark: SparkSession, centroids: np.ndarray) -> np.ndarray:
    """The links of all centroids, found once, a block of them in a task; about 120 bytes a centroid come back."""
    n, shared = len(centroids), spark.sparkContext.broadcast(centroids)
    starts = spark.createDataFrame([(i,) for i in range(0, n, LINKED)], "start int").repartition(max(1, -(-n // LINKED)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["start"].tolist():
                yield pd.DataFrame({"start": [i], "links": [linked(shared.value, i, min(n, i + LINKED)).tobytes()]})

    rows = starts.mapInPandas(run, "start int, links binary").collect()
    return np.concatenate([np.frombuffer(r["links"], np.int32).reshape(min(n, r["start"] + LINKED) - r["start"], -1) for r in sorted(rows, key=lambda r: r["start"])])


@cache
def _graph(centroids: bytes, links: bytes, width: int) -> CentroidGraph:
    """One for each Python worker and index."""
    c = np.frombuffer(centroids).reshape(-1, width)
    return CentroidGraph(c, np.frombuffer(links, np.int32).reshape(len(c), -1))


class Index:
    """Broadcast: the centroids and their links, of bounded size. norm: the largest norm; ratio: of distances, for pruning."""

    def __init__(self, spark: SparkSession, centroids: np.ndarray, norm: float, ratio: float = RATIO):
        self.width, self.norm, self.lists, self.ratio = centroids.shape[1], norm, len(centroids), ratio
        self.raw = spark.sparkContext.broadcast((centroids.tobytes(), links_of(spark, centroids).tobytes()))

    def graph(self) -> CentroidGraph:
        return _graph(*self.raw.value, self.width)

    def together(self) -> int:
        """Rows to search the graph for at once; a scan holds a distance to each list."""
        return max(16, min(TOGETHER, HELD // min(self.lists, 2_048)))


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """The further coordinate of indexed vectors."""
    return np.concatenate([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))[:, None]], axis=1)


def asking(x: np.ndarray) -> np.ndarray:
    """The further coordinate of queries."""
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def homes(graph: CentroidGraph, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists, whether a vector goes there): the nearest, and those to which it is at the boundary."""
    near, far = graph.search(lifted, 2 * COPIES)
    gap = ((graph.c[near] - graph.c[near[:, :1]]) ** 2).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        place = (far**2 - far[:, :1] ** 2) / gap  # 0 on the bisecting plane, 1 at the own centroid
    keep = np.isfinite(far) & (gap > 0) & (place <= EDGE)
    keep[:, 0] = True
    return near, keep & (np.cumsum(keep, axis=1) <= COPIES)


def fitted_ratio(x: np.ndarray, graph: CentroidGraph, norm: float, nearest: int) -> float:
    """The least ratio of distances at which vectors of the sample find RECALL of their nearest in the sample."""
    if len(x) <= nearest + 1 or len(graph.c) < 2:
        return RATIO
    asked = np.unique(np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int))
    needed = []
    for i in range(0, len(asked), 32):
        own = asked[i : i + 32]
        score = x[own] @ x.T
        score[np.arange(len(own)), own] = -np.inf
        best = np.argpartition(-score, nearest, axis=1)[:, :nearest]
        away = np.sqrt(squared(asking(x[own]), graph.c))
        ratio = away / np.maximum(away.min(1, keepdims=True), 1e-300)
        near, keep = homes(graph, lift(x[best.reshape(-1)], norm))
        there = np.where(keep, ratio[np.repeat(np.arange(len(own)), nearest)[:, None], near], np.inf)
        needed.append(there.min(1))
    return float(np.quantile(np.concatenate(needed), RECALL)) + 1e-9


def _second_level(found: DataFrame, first: Index, lists: int, n: int) -> np.ndarray:
    """Centroids of the first level's lists clustered once more, each in a task, from about SECOND vectors a list."""
    share = min(1.0, SECOND * lists / n)
    sample = found.where(F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(1_000_000_000)) < int(share * 1_000_000_000) + 1)
    drawn = materialize(assign(sample, first, copies=False), "second-sample")
    norm = first.norm

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")
        x = np.frombuffer(b"".join(group["v"])).reshape(len(group), -1)
        c = balanced_centroids(lift(x, norm), max(1, round(len(x) / SECOND)))
        return pd.DataFrame({"list": group["list"].iloc[0], "c": [v.tobytes() for v in c]})

    rows = drawn.groupBy("list").applyInPandas(split, "list int, c binary").orderBy("list", "c").collect()  # about MOST_LISTS at most
    return np.frombuffer(b"".join(bytes(r["c"]) for r in rows)).reshape(len(rows), -1)


def fit(found: DataFrame, size: int = LIST, nearest: int = NEAREST) -> Index:
    spark = found.sparkSession
    stats = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), F.max(F.size("v")).alias("d")).first()
    n, d = stats["n"], stats["d"] or 1
    most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    share = min(1.0, most / max(n, 1))
    sample = found.where(F.pmod(F.xxhash64("cid"), F.lit(1_000_000_000)) < int(share * 1_000_000_000) + 1).orderBy(F.xxhash64("cid")).limit(most)
    x = np.array([r["v"] for r in sample.select("v").collect()]).reshape(-1, d)  # bounded by SAMPLE and SAMPLE_BYTES
    norm = float(np.sqrt(stats["norm"] or 0.0))
    if not len(x):
        return Index(spark, np.zeros((1, d + 1)), norm)
    lists = max(1, min(MOST_LISTS, -(-n // size)))
    index = Index(spark, balanced_centroids(lift(x, norm), min(lists, max(1, len(x) // PER_LIST))), norm)
    if lists > 2 * index.lists:
        index = Index(spark, _second_level(found, index, lists, n), norm)
    # the nearest among all are so many of the sample, as likely
    index.ratio = fitted_ratio(x, index.graph(), norm, max(2, -(-nearest * len(x) // n)))
    return index


def assign(found: DataFrame, index: Index, copies: bool = True) -> DataFrame:
    """(list, cid, v as bytes) rows of the posting lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, step = index.graph(), index.together()
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.iloc[i : i + step]
                x = np.stack(part["v"].to_numpy()).astype(float)
                near, keep = homes(graph, lift(x, index.norm))
                row, col = np.nonzero(keep) if copies else (np.arange(len(x)), np.zeros(len(x), int))
                raw = [r.tobytes() for r in x]
                yield pd.DataFrame({"list": near[row, col], "cid": part["cid"].to_numpy()[row], "v": [raw[r] for r in row]})

    return found.select("cid", "v").mapInPandas(run, "list int, cid long, v binary")


def probe(queries: DataFrame, index: Index, sizes: np.ndarray, enough: int, ratio: float | None = None) -> DataFrame:
    """(list, qid, v) rows: the lists that each query searches."""
    ratio = index.ratio if ratio is None else ratio

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, step = index.graph(), index.together()
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.iloc[i : i + step]
                x = np.stack(part["v"].to_numpy()).astype(float)
                lifted, width = asking(x), PROBED
                while True:  # wide enough when the farthest that was met is beyond what is asked for
                    near, far = graph.search(lifted, width)
                    held = np.where(np.isfinite(far), sizes[near], 0).cumsum(1)
                    want = (far <= ratio * far[:, :1]) | (held - sizes[near] < enough)
                    want &= np.isfinite(far)
                    if near.shape[1] >= len(graph.c) or not want[:, -1].any():
                        break
                    width *= 2
                row, col = np.nonzero(want)
                raw = [r.tobytes() for r in x]
                yield pd.DataFrame({"list": near[row, col], "qid": part["cid"].to_numpy()[row], "v": [raw[r] for r in row]})

    return queries.select("cid", "v").mapInPandas(run, "list int, qid long, v binary")


def _blocks(rows: DataFrame, key: str, size: int) -> dict[int, int]:
    """Blocks of each list; one row a list is collected."""
    return {r["list"]: -(-r["count"] // size) for r in rows.groupBy("list").count().collect()}


def search(found: DataFrame, queries: DataFrame, nearest: int, index: Index, ratio: float | None = None) -> DataFrame:
    """(qid, hits: array<struct<loss: -score, cid>>): for each query class its nearest + 1 best classes met."""
    posted = materialize(assign(found, index), "posting-lists")
    first = found.sparkSession.createDataFrame
    own = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
    sizes = np.array([own.get(i, 0) for i in range(index.lists)])
    # copies count at most COPIES times, so lists with so many rows hold enough classes
    asked = materialize(probe(queries, index, sizes, COPIES * (nearest + 1), ratio), "probes")
    c_blocks, q_blocks = {i: -(-n // BLOCK) for i, n in own.items()}, _blocks(asked, "qid", QUERY_BLOCK)
    table = first([(i, max(1, c_blocks.get(i, 1)), max(1, q_blocks.get(i, 1))) for i in range(index.lists)], "list int, cn int, qn int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = posted.join(F.broadcast(table), "list").select("list", F.pmod(F.xxhash64("cid"), F.col("cn")).cast("int").alias("cb"), every("qn").alias("qb"), "cid", "v")
    right = asked.join(F.broadcast(table), "list").select("list", every("cn").alias("cb"), F.pmod(F.xxhash64("qid"), F.col("qn")).cast("int").alias("qb"), "qid", "v")

    def score(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "losses": pd.Series(dtype=object), "cids": pd.Series(dtype=object)})
        c = c.sort_values("cid")
        x, ids = np.frombuffer(b"".join(c["v"])).reshape(len(c), -1), c["cid"].to_numpy()
        out = []
        for i in range(0, len(q), TOGETHER):
            part = q.iloc[i : i + TOGETHER]
            y = np.frombuffer(b"".join(part["v"])).reshape(len(part), -1)
            loss = -np.einsum("qd,cd->qc", y, x)
            best = np.argsort(loss, axis=1, kind="stable")[:, : nearest + 1]  # ids rise, so ties are in order
            out.append(pd.DataFrame({"qid": part["qid"].to_numpy(), "losses": list(np.take_along_axis(loss, best, 1)), "cids": list(ids[best])}))
        return pd.concat(out)

    keys = ["list", "cb", "qb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "qid long, losses array<double>, cids array<long>")
    zipped = F.arrays_zip(F.col("losses").alias("loss"), F.col("cids").alias("cid"))
    whole = met.groupBy("qid").agg(F.flatten(F.collect_list(zipped)).alias("h"))
    ordered = F.slice(F.array_sort("h"), 1, COPIES * (nearest + 1))
    names = F.transform("h", lambda h: h["cid"])
    once = F.filter("h", lambda h, i: F.array_position(names, h["cid"]) == i + 1)
    return whole.withColumn("h", ordered).select("qid", F.slice(once, 1, nearest + 1).alias("hits"))


def nearest_neighbours(rows: DataFrame, is_query: Column, key: str, vector: str, nearest: int = NEAREST, ratio: float | None = None, size: int = LIST) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which is_query (of column id) holds, against all rows."""
    kept = valid(rows, key, vector)
    found = materialize(classes(kept, nearest + 1), "classes")
    index = fit(found, size, nearest)
    queries = kept.where(is_query).select(F.col("id").alias("query_id"), "v").distinct()
    members = materialize(queries.join(found.select("v", "cid"), "v").select("query_id", "cid"), "query-classes")
    hits = search(found, found.join(members.select("cid").distinct(), "cid", "left_semi"), nearest, index, ratio)
    ids = hits.select("qid", F.explode("hits").alias("h")).join(found.select(F.col("cid").alias("h_cid"), "ids"), F.col("h.cid") == F.col("h_cid"))
    best = ids.select("qid", (-F.col("h.loss")).alias("score"), F.explode("ids").alias("vec_id"))
    few = best.selectExpr("*", "row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r").where(F.col("r") <= nearest + 1)
    listed = few.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("loss"), "vec_id"))).alias("near"))
    own = members.join(listed, F.col("cid") == F.col("qid")).withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest))
    return own.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.loss")).alias("score"))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(documents(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, "vec_id", "embedding")
