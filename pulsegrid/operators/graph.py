"""Interaction graphs: edges from posts and relationships, degrees, PageRank, betweenness, influence.

posts: event_id, platform, author_id, published_at, likes, replies, reposts, quotes, views, followers, verified,
hashtags, reply_to_author, quote_of, forward_of, mentions. Node ids are platform:id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numbers import js_round, null_sum
from pulsegrid.functions.text import node_id, relation_type, username
from pulsegrid.operators.distributions import at_ranks
from pulsegrid.operators.trend import before
from pulsegrid.session import checkpoint_folder, stored

#: Weight of each interaction and of each signal of the influence score.
EDGE_WEIGHTS = {"follow": 1, "like": 1, "mention": 1, "reply": 2, "quote": 3, "repost": 3}
SIGNALS = {"content_impact": 0.30, "network_authority": 0.25, "reach": 0.15, "received_influence": 0.20, "interaction_activity": 0.10}
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 100
#: Edges up to which tasks hold a graph's edges, as numbers, to find its betweenness; sources times edges dealt to a task, at
#: most so many parts of a graph and tasks in all; nodes and edges of the searches that a task advances together.
SMALL, WORK, PARTS, MOST_TASKS, TOGETHER = 2_000_000, 25_000_000, 64, 2_000, 250_000


def author_nodes(posts: DataFrame) -> DataFrame:
    """Metrics of each author who posted."""
    total = null_sum("likes", "replies", "reposts", "quotes")
    return posts.where(F.col("author_id").isNotNull()).groupBy(node_id(F.col("platform"), F.col("author_id")).alias("id")).agg(
        F.count(F.lit(1)).alias("posts"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("likes", "replies", "reposts", "quotes", "views")],
        F.sum(F.coalesce(total, F.lit(0))).alias("interactions"), F.max("followers").alias("followers"), F.greatest(F.max("followers"), F.max("views")).alias("reach"),
        F.coalesce(F.bool_or("verified"), F.lit(False)).alias("verified"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hashtags")))).alias("hashtags"),
        F.min("published_at").alias("first_seen"),
    )


def post_authors(posts: DataFrame) -> DataFrame:
    """(platform, post, author): the first writer of each post id."""
    bare = F.regexp_replace("event_id", F.concat(F.lit("(?i)^("), F.col("platform"), F.lit(":)+")), F.lit(""))
    first = posts.groupBy("platform", bare.alias("post")).agg(F.min_by("author_id", F.struct("published_at", "event_id")).alias("author"))
    return first.where(F.col("author").isNotNull())


def resolved(posts: DataFrame, column: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Edges from the posts that refer to another by id, and the unresolved ones. Self-references make no edge."""
    asked = posts.where(F.col(column).isNotNull())
    key = F.regexp_replace(F.col(column), F.concat(F.lit("(?i)^("), F.col("platform"), F.lit(":)+")), F.lit(""))
    joined = asked.withColumn("post", key).join(post_authors(posts), ["platform", "post"], "left")
    src, dst = node_id(F.col("platform"), F.col("author_id")), node_id(F.col("platform"), F.col("author"))
    hits = joined.where(F.col("author").isNotNull() & F.col("author_id").isNotNull())
    return hits.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), "published_at", "event_id").where("src <> dst"), joined.where(F.col("author").isNull())


def reply_edges(posts: DataFrame) -> DataFrame:
    asked = posts.where(F.col("reply_to_author").isNotNull() & F.col("author_id").isNotNull())
    return asked.select(node_id(F.col("platform"), F.col("author_id")).alias("src"), node_id(F.col("platform"), F.col("reply_to_author")).alias("dst"), F.lit("reply").alias("kind"), "published_at", "event_id").where("src <> dst")


def mention_edges(posts: DataFrame, handles: DataFrame) -> DataFrame:
    """Mentions by handle (platform, handle, author_id, ord); unknown handles become external nodes."""
    asked = posts.where(F.col("author_id").isNotNull()).select("platform", "author_id", "published_at", "event_id", F.explode("mentions").alias("m")).withColumn("handle", username(F.col("m")))
    known = handles.groupBy("platform", username(F.col("handle")).alias("handle")).agg(F.min_by("author_id", "ord").alias("target"))
    joined = asked.join(known, ["platform", "handle"], "left")
    dst = F.when(F.col("target").isNotNull(), node_id(F.col("platform"), F.col("target"))).otherwise(F.concat(F.lit("external:"), F.col("platform"), F.lit(":"), F.col("handle")))
    return joined.select(node_id(F.col("platform"), F.col("author_id")).alias("src"), dst.alias("dst"), F.lit("mention").alias("kind"), "published_at", "event_id").where("src <> dst")


def mention_targets(posts: DataFrame, nodes: DataFrame, handles: DataFrame) -> DataFrame:
    """Edges from mentions (array of id, username): to the node of the id where there is one (nodes: id), else to the
    author of that handle on the platform (platform, handle, author_id, ord), else to an external node named by the id or
    the handle. A mention with neither makes no edge."""
    asked = posts.where(F.col("author_id").isNotNull()).select("platform", "author_id", "published_at", "event_id", F.explode("mentions").alias("m"))
    asked = asked.withColumns({"handle": username(F.col("m.username")), "by_id": node_id(F.col("platform"), F.col("m.id"))})
    known = handles.groupBy("platform", username(F.col("handle")).alias("handle")).agg(F.min_by("author_id", "ord").alias("target"))
    there = nodes.select(F.col("id").alias("by_id"), F.lit(True).alias("there")).distinct()
    joined = asked.join(there, "by_id", "left").join(known, ["platform", "handle"], "left")
    name = F.coalesce(F.col("m.id"), F.nullif(F.col("handle"), F.lit("")))
    dst = F.when(F.col("there"), F.col("by_id")).when(F.col("target").isNotNull(), node_id(F.col("platform"), F.col("target"))).otherwise(F.concat(F.lit("external:"), F.col("platform"), F.lit(":"), name))
    return joined.select(node_id(F.col("platform"), F.col("author_id")).alias("src"), dst.alias("dst"), F.lit("mention").alias("kind"), "published_at", "event_id").where("src <> dst")


def relationship_edges(relationships: DataFrame) -> DataFrame:
    """Edges from given relationships (platform, source_user, target_user, type, observed_at, post)."""
    return relationships.select(
        node_id(F.col("platform"), F.col("source_user")).alias("src"), node_id(F.col("platform"), F.col("target_user")).alias("dst"), relation_type(F.col("type")).alias("kind"),
        F.col("observed_at").alias("published_at"), F.col("post").alias("event_id"),
    ).where("kind is not null and src <> dst")


def aggregate_edges(links: DataFrame) -> DataFrame:
    """One row for each (src, dst): counts by kind, weight, first and last time, number of links; edge_events has ids."""
    weight = F.create_map(*[F.lit(x) for p in EDGE_WEIGHTS.items() for x in p])[F.col("kind")]
    return links.groupBy("src", "dst").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in EDGE_WEIGHTS], F.sum(weight).alias("weight"), F.min("published_at").alias("first_at"),
        F.max("published_at").alias("last_at"), F.count(F.lit(1)).alias("links"),
    )


def edge_events(links: DataFrame) -> DataFrame:
    """(src, dst, event_ids): all different ids of each edge's events, in order."""
    return links.groupBy("src", "dst").agg(F.sort_array(F.collect_set("event_id")).alias("event_ids"))


def new_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are not among the nodes."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and weighted degrees; edges with an unknown end count nothing. Centrality: degree over 2 (n - 1)."""
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    ends = inside.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("ow"), F.lit(0).alias("iw")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("ow"), F.col("weight").alias("iw")))).alias("e")).select("e.*")
    by = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum("iw").alias("weighted_in"), F.sum("ow").alias("weighted_out"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    found = nodes.select("id").join(by, "id", "left").crossJoin(F.broadcast(n))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    degree = F.coalesce("in_degree", F.lit(0)) + F.coalesce("out_degree", F.lit(0))
    return found.select("id", zero("in_degree"), zero("out_degree"), zero("weighted_in"), zero("weighted_out"), degree.alias("degree"), F.when(F.col("n") > 1, js_round(degree / (2 * (F.col("n") - 1)), 6)).otherwise(0.0).alias("degree_centrality"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, pagerank): unweighted, dangling mass spread over all; ends with the first round whose L1 change is below the
    tolerance.

    Edges are dealt by their source once and kept so on the executors' disks, so a round shuffles what nodes gain and
    the ranks alone. Ranks are stored each round; the driver sees a row of sums a round."""
    spark = nodes.sparkSession
    checkpoint_folder(spark)
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    out = edges.select("src", "dst").distinct().join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = out.join(out.groupBy("src").agg(F.count(F.lit(1)).alias("k")), "src").select("src", "dst", (1.0 / F.col("k")).alias("share")).checkpoint()
    dealt = shares.repartition(parts, "src").persist(StorageLevel.DISK_ONLY)
    sources = shares.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(True))
    state = ids.join(sources, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("old")).checkpoint()
    loose = F.coalesce(F.sum(F.when(~F.col("linked"), F.col("rank"))), F.lit(0.0)).alias("loose")
    sums = state.agg(loose).first()
    for _ in range(rounds):
        gained = dealt.join(state, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        moved = state.select("id", "linked", F.col("rank").alias("old")).join(gained, F.col("id") == F.col("dst"), "left")
        rank = (1 - DAMPING) / n + DAMPING * (F.coalesce("in", F.lit(0.0)) + sums["loose"] / n)
        state = stored(moved.select("id", "linked", rank.alias("rank"), "old"))
        sums = state.agg(loose, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change")).first()
        if sums["change"] < tolerance:
            break
    dealt.unpersist()
    return state.select("id", js_round(F.col("rank"), 8).alias("pagerank"))


def _chains(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner, first, place) of n nodes with edges from src to dst, distinct and without loops: whether one edge ends and one
    begins in a node, the first node of its chain of such nodes, and its place there from 1; 0 for the other nodes. The
    smallest node of a ring of such nodes alone isn't inner. Chains are followed by doubled pointers."""
    inner = (np.bincount(src, minlength=n) == 1) & (np.bincount(dst, minlength=n) == 1)
    back = np.arange(n)
    back[dst] = src
    while True:
        first = np.where(inner & inner[back], back, np.arange(n))
        place, least = (first != np.arange(n)).astype(np.int64), np.arange(n)
        for _ in range(n.bit_length()):
            place, least, first = place + place[first], np.minimum(least, least[first]), first[first]
        ring = inner & inner[back[first]]
        if not ring.any():
            return inner, first, np.where(inner, place + 1, 0)
        inner = inner & ~(ring & (least == np.arange(n)))


def _folded(src: np.ndarray, dst: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The graph with its chains as edges: starts, nexts and the inner nodes of each edge, as _credits takes them; and of
    each of the n nodes its number there or, for a chain's, the number of nodes there and that of the edge, its place in the
    chain from 1 and the chain's length, 0 for the other nodes."""
    inner, first, place = _chains(src, dst, n)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[dst], after[src] = src, dst
    plain, lasts = ~inner[src] & ~inner[dst], np.flatnonzero(inner & ~inner[after])
    number, nodes = np.cumsum(~inner) - 1, n - int(inner.sum())
    begins = number[np.concatenate([src[plain], before[first[lasts]]])]
    ends = number[np.concatenate([dst[plain], after[lasts]])]
    long = np.concatenate([np.zeros(plain.sum(), np.int64), place[lasts]])
    order = np.lexsort((long, ends, begins))
    edge, chain = np.empty(len(order), np.int64), np.zeros(n, np.int64)
    edge[order] = np.arange(len(order))
    chain[first[lasts]] = edge[plain.sum() :]
    chain = chain[first]
    return {
        "starts": np.searchsorted(begins[order], np.arange(nodes + 1)), "nexts": ends[order], "inner": long[order], "number": np.where(inner, nodes + chain, number), "place": place,
        "long": np.where(inner, long[order][chain] if len(order) else 0, 0),
    }


def _credits(starts: np.ndarray, nexts: np.ndarray, sources: np.ndarray, inner: np.ndarray | None = None, sums: np.ndarray | None = None) -> np.ndarray:
    """Sums over these sources of each node's credit: the share of the shortest paths from a source that lead through it.
    The targets of node v are nexts[starts[v]:starts[v + 1]]. Searches of a few sources advance together, in the order of
    their distances; the node v of the k-th of n nodes each is k * n + v.

    An edge may stand for a chain of inner nodes. They begin no search: their paths leave through the end of the chain and
    arrive through its beginning, so a source stands for the chains that end in it and a target for those that begin in
    it; pairs within a chain, the first before the second, take the chain alone. Added to sums for each edge: credit of all
    its inner nodes, targets that its end reaches, whether that reaches its beginning, sources that reach its beginning."""
    n = len(starts) - 1
    inner = np.zeros(len(nexts), np.int64) if inner is None else inner
    sums = np.zeros((4, len(nexts))) if sums is None else sums
    begins, chains = np.repeat(np.arange(n), np.diff(starts)), np.flatnonzero(inner)
    behind, ahead = 1.0 + np.bincount(nexts, inner, n), 1.0 + np.bincount(begins, inner, n)
    lengths, kind = np.unique(inner, return_inverse=True)
    kind = kind.astype(np.int16)  # the lengths of chains add up to the nodes, so few differ
    total, wide = np.zeros(n), max(1, TOGETHER // (n + len(nexts)))
    for at in range(0, len(sources), wide):
        own = sources[at : at + wide]
        v, base = own, np.arange(len(own)) * n
        row = np.full(n, -1)
        row[own] = np.arange(len(own))
        mine = chains[row[nexts[chains]] >= 0]
        spot = row[nexts[mine]] * n + begins[mine]
        pairs = np.outer(behind[own], ahead).ravel()
        np.subtract.at(pairs, spot, inner[mine] * (inner[mine] + 1) / 2)
        seen, paths, credit, last = np.zeros(len(own) * n, bool), np.zeros(len(own) * n), np.zeros(len(own) * n), np.zeros(len(own) * n, np.int32)
        seen[base + v], paths[base + v], steps, waiting, far = True, 1.0, [], {}, 0
        while True:
            many = starts[v + 1] - starts[v]
            edge = np.repeat(starts[v] - np.cumsum(many) + many, many) + np.arange(many.sum())
            base, here = np.repeat(base, many), np.repeat(base + v, many)
            new = ~seen[base + nexts[edge]]
            base, here, edge = base[new], here[new], edge[new]
            if len(chains):
                order = np.argsort(kind[edge], kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(kind[edge[order]])) + 1):
                    if len(part):
                        waiting.setdefault(far + 1 + int(inner[edge[part[0]]]), []).append((base[part], here[part], edge[part]))
            elif len(edge):
                waiting[far + 1] = [(base, here, edge)]
            if not waiting:
                break
            far = min(waiting)
            base, here, edge = (np.concatenate(x) for x in zip(*waiting.pop(far), strict=True))
            there = base + nexts[edge]
            if len(chains):
                new = ~seen[there]
                base, here, edge, there = base[new], here[new], edge[new], there[new]
            np.add.at(paths, there, paths[here])
            steps.append((here, there, edge))
            count = np.arange(len(there), dtype=np.int32)
            last[there] = count
            once = last[there] == count
            base, v = base[once], nexts[edge[once]]
            seen[there[once]] = True
        for here, there, edge in reversed(steps):
            gained = paths[here] / paths[there] * (pairs[there] + credit[there])
            np.add.at(credit, here, gained)
            if len(chains):
                sums[0] += np.bincount(edge, gained, len(nexts))
        met, pairs = seen.reshape(-1, n), np.where(seen, pairs, 0.0).reshape(-1, n)
        reached = met @ ahead
        credit = np.where(met, credit.reshape(-1, n) + pairs - behind[own][:, None], 0.0)
        credit[np.arange(len(own)), own] = pairs.sum(axis=1) - reached - behind[own] + 1
        total += credit.sum(axis=0)
        sums[1, mine] += reached[row[nexts[mine]]]
        sums[2, mine] += seen[spot]
        sums[3] += (behind[own] @ met)[begins]
    return total


def _task_betweenness(links: DataFrame, graph: str) -> DataFrame:
    """Betweenness of graphs of at most SMALL edges; sums of credits, not scaled. A graph is packed into numbers once, its
    chains as edges; its sources are dealt over tasks by the work they make, and each task has the numbers of one graph at
    a time. The credits of a chain's nodes follow from the chain's sums and their places in it."""
    checkpoint_folder(links.sparkSession)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        number, ids = pd.factorize(np.concatenate([rows["src"].to_numpy(object), rows["dst"].to_numpy(object)]), sort=True)
        src, dst = number.astype(np.int64).reshape(2, -1)
        graph_of = _folded(src[src != dst], dst[src != dst], len(ids))
        parts = min(PARTS, 1 + (len(graph_of["starts"]) - 1) * len(graph_of["nexts"]) // WORK)
        lists = {c: [graph_of[c]] for c in ("number", "place", "long")}
        return pd.DataFrame({graph: [rows[graph].iloc[0]], "ids": [ids], **lists, **{c: [graph_of[c].astype("<i4").tobytes()] for c in ("starts", "nexts", "inner")}, "parts": [parts]})

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        starts, nexts, inner = (np.frombuffer(r[c], "<i4").astype(np.int64) for c in ("starts", "nexts", "inner"))
        sums = np.zeros((4, len(nexts)))
        credit = _credits(starts, nexts, np.arange(r["part"], len(starts) - 1, r["parts"]), inner, sums)
        chains, none = np.flatnonzero(inner), np.zeros(len(credit))
        numbers = np.concatenate([np.arange(len(credit)), len(credit) + chains])
        return pd.DataFrame({graph: r[graph], "number": numbers, **{c: np.concatenate([credit if c == "credit" else none, x[chains]]) for c, x in zip(gains, sums, strict=True)}})

    gains, kind = ("credit", "onward", "round", "inward"), dict(links.dtypes)[graph]
    shape = f"{graph} {kind}, ids array<string>, number array<int>, place array<int>, long array<int>, starts binary, nexts binary, inner binary, parts int"
    packed = links.groupBy(graph).applyInPandas(pack, shape).checkpoint()
    tasks = max(1, min(MOST_TASKS, packed.agg(F.sum("parts")).first()[0] or 0))
    dealt = packed.select(graph, "starts", "nexts", "inner", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).repartition(tasks, graph, "part")
    solved = dealt.groupBy(graph, "part").applyInPandas(solve, f"{graph} {kind}, number int, " + ", ".join(f"{c} double" for c in gains))
    sums = solved.groupBy(graph, "number").agg(*[F.sum(c).alias(c) for c in gains])
    named = packed.select(graph, F.explode(F.arrays_zip("ids", "number", "place", "long")).alias("n")).select(graph, F.col("n.ids").alias("id"), "n.number", F.col("n.place").cast("double").alias("place"), F.col("n.long").cast("double").alias("long"))
    # of a chain's node: paths from those before it to what the end reaches, to those after it from what reaches the beginning,
    # and between both; without what would lead from the chain's end to its beginning and into it
    j, m = F.col("place"), F.col("long")
    twice = F.col("round") * ((j - 1) * (m + 1 - j / 2) + (m * (m + 1) - j * (j + 1)) / 2)
    within = (j - 1) * F.col("onward") + (m - j) * F.col("inward") + (j - 1) * (m - j) - twice
    # exploded names are far larger than estimated, so they are not to be broadcast
    return sums.join(named.hint("merge"), [graph, "number"]).select(graph, "id", (F.col("credit") + F.when(j > 0, within).otherwise(0.0)).alias("credit"))


def _frontier_betweenness(links: DataFrame, graph: str, share: float) -> DataFrame:
    """The same for graphs of any size: all sources' searches advance together, a level a round. A round joins the
    frontier (source, node, paths) with the edges and leaves out what has been reached; credits flow back level by
    level along the same edges. Levels are stored; no task holds a graph."""
    checkpoint_folder(links.sparkSession)
    by = [graph, "source"]
    edges = links.select(F.col(graph), F.col("src").alias("node"), F.col("dst").alias("next")).checkpoint()
    ends = links.select(graph, F.explode(F.array("src", "dst")).alias("id")).distinct()
    chosen = F.pmod(F.xxhash64(F.col(graph).cast("string"), "id"), F.lit(1_000_000)) < int(share * 1_000_000) if share < 1 else F.lit(True)
    level = ends.where(chosen).select(graph, F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("paths")).checkpoint()
    levels, reached = [level], level.select(*by, "node")
    while True:
        onward = level.join(edges, [graph, "node"]).groupBy(*by, F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        level = stored(onward.join(reached, [*by, "node"], "left_anti").select(graph, "source", "node", "paths"))
        if not level.limit(1).count():
            break
        levels.append(level)
        reached = stored(reached.unionByName(level.select(*by, "node")))
    credit, found = levels[-1].withColumn("credit", F.lit(0.0)), []
    for level in reversed(levels[:-1]):
        found.append(credit.groupBy(graph, F.col("node").alias("id")).agg(F.sum("credit").alias("credit")))
        after = credit.select(graph, "source", F.col("node").alias("next"), F.col("paths").alias("through"), F.col("credit").alias("behind"))
        back = level.join(edges, [graph, "node"]).join(after, [graph, "source", "next"]).groupBy(*by, "node").agg(F.sum(F.col("paths") / F.col("through") * (1 + F.col("behind"))).alias("credit"))
        credit = stored(level.join(back, [*by, "node"], "left").select(graph, "source", "node", "paths", F.coalesce("credit", F.lit(0.0)).alias("credit")))
    every = ends.select(graph, "id", F.lit(0.0).alias("credit"))  # a source's own credit, on level 0, isn't counted
    for part in found:
        every = every.unionByName(part)
    return every.groupBy(graph, "id").agg((F.sum("credit") / share).alias("credit"))


def betweenness(edges: DataFrame, graph: str, small: int = SMALL, share: float = 1.0) -> DataFrame:
    """(graph, id, betweenness): shortest-path betweenness, directed and unweighted, of each of many graphs (one
    collection each; those without a name are one); over (n - 1)(n - 2), 0 where n <= 2.

    Graphs of at most `small` edges are solved in tasks, each for a share of the sources, larger ones by frontiers over
    DataFrames. Every source meets every edge, so the work grows with nodes times edges of a graph. Exact; with a
    share below 1 the larger ones take about that share of their nodes as sources, by a hash, and scale up: an unbiased
    estimate whose error for a node stays, in 19 of 20 cases, within 1.4 * sqrt((1 - share) / (share * n)) of the range."""
    named = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.to_json(F.struct(graph)).alias("graph_"), F.col(graph).alias("name_"), "src", "dst")
    checkpoint_folder(edges.sparkSession)
    known = named.distinct().checkpoint()  # read by each of the steps below
    names, links = known.select("graph_", "name_").distinct(), known.select("graph_", "src", "dst")
    large = links.groupBy("graph_").agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") > small).select("graph_")
    if large.limit(1).count():
        credits = _task_betweenness(links.join(large, "graph_", "left_anti"), "graph_").unionByName(_frontier_betweenness(links.join(large, "graph_", "left_semi"), "graph_", share))
    else:
        credits = _task_betweenness(links, "graph_")
    n = links.select("graph_", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("graph_").agg(F.count(F.lit(1)).alias("n"))
    scale = (F.col("n") - 1) * (F.col("n") - 2)
    found = credits.join(n, "graph_").join(names, "graph_")
    return found.select(F.col("name_").alias(graph), "id", js_round(F.when(F.col("n") > 2, F.col("credit") / scale).otherwise(0.0), 6).alias("betweenness"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community, size, modularity): communities by weighted label propagation over edges taken as undirected.

    Every node begins as its own community. In a round the nodes of one half (by a hash of their name, in turn; so two
    neighbours seldom swap labels for ever) take the label of the greatest weight among their neighbours; ties keep the
    own label if it is among them, else the smallest one. It ends when both halves stay as they are, or after so many
    rounds. Modularity is that of the whole division, 6 decimals. Loops and edges with unknown ends count nothing."""
    checkpoint_folder(nodes.sparkSession)
    ids = nodes.select("id").where("id is not null").distinct()
    known = surviving_edges(edges.where("src <> dst"), ids).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    either = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = known.select(either.alias("e"), "weight").groupBy("e.src", "e.dst").agg(F.sum("weight").alias("weight")).checkpoint()
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the edges of those who choose in a round, dealt by the neighbours whose labels they ask for
    dealt = [both.where(F.crc32("src") % 2 == half).repartition(parts, "dst").persist(StorageLevel.DISK_ONLY) for half in (0, 1)]
    state, still = ids.select("id", F.col("id").alias("label"), F.lit(False).alias("moved")).checkpoint(), 0
    for k in range(2 * rounds):
        votes = dealt[k % 2].join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), F.col("label").alias("vote")).agg(F.sum("weight").alias("weight"))
        # the heaviest; then the own label; then the smallest; none for the other half
        best = F.min(F.struct((-F.col("weight")).alias("w"), (F.col("vote") != F.col("label")).alias("other"), "vote"))["vote"]
        chosen = state.select("id", "label").join(votes, "id", "left").groupBy("id", "label").agg(best.alias("vote"))
        state = stored(chosen.select("id", F.coalesce("vote", "label").alias("label"), F.coalesce(F.col("vote") != F.col("label"), F.lit(False)).alias("moved")))
        still = 0 if state.where("moved").limit(1).count() else still + 1
        if still == 2:
            break
    for edges_of in dealt:
        edges_of.unpersist()
    named = state.select("id", F.col("label").alias("community"))
    of = lambda end: named.select(F.col("id").alias(end), F.col("community").alias(f"{end}_of"))
    placed = both.join(of("src"), "src").join(of("dst"), "dst")
    by = placed.groupBy(F.col("src_of").alias("community")).agg(F.sum("weight").alias("degree"), F.coalesce(F.sum(F.when(F.col("src_of") == F.col("dst_of"), F.col("weight"))), F.lit(0.0)).alias("inside"))
    whole = both.agg(F.sum("weight").alias("all"))
    parts = by.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("inside") / F.col("all") - (F.col("degree") / F.col("all")) * (F.col("degree") / F.col("all"))).alias("q"))  # one row
    sizes = named.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    found = named.join(sizes, "community").crossJoin(F.broadcast(parts)).select("id", "community", "size", js_round(F.coalesce("q", F.lit(0.0)), 6).alias("modularity"))
    return found


def influence_signals(authors: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, observed, pagerank, signals) of authors, as author_nodes has them, and of the external ends of edges.

    Content impact: likes, replies and reposts of an author's posts, and reposts by others. Network authority:
    PageRank. Reach: followers or views. Received influence: quotes and reposts of the posts, and all edges that end
    in the author. Interaction activity: interactions with the posts, and all edges that begin in the author.
    """
    kinds = [F.sum(f"n_{k}").alias(f"n_{k}") for k in EDGE_WEIGHTS]
    all_kinds = sum((F.col(f"n_{k}") for k in EDGE_WEIGHTS), F.lit(0))
    got = edges.groupBy(F.col("dst").alias("id")).agg(*kinds).select("id", all_kinds.alias("got"), F.col("n_repost").alias("got_reposts"))
    gave = edges.groupBy(F.col("src").alias("id")).agg(*kinds).select("id", all_kinds.alias("gave"))
    known = authors.select("id", "likes", "replies", "reposts", "quotes", "interactions", F.col("reach").alias("own_reach"), F.lit(True).alias("observed"))
    ends = known.join(got, "id", "full_outer").join(gave, "id", "full_outer").join(ranks, "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return ends.select(
        "id", F.coalesce("observed", F.lit(False)).alias("observed"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"),
        (n("likes") + n("replies") + n("reposts") + n("got_reposts")).alias("content_impact"), F.coalesce("pagerank", F.lit(0.0)).alias("network_authority"), n("own_reach").alias("reach"),
        (n("quotes") + n("reposts") + n("got")).alias("received_influence"), (n("interactions") + n("gave")).alias("interaction_activity"),
    )


def influence_scores(nodes: DataFrame) -> DataFrame:
    """Adds influence (0 to 100) and its tier to nodes (id, observed, signals).

    Each signal is scaled by its maximum over observed nodes; external nodes score 0.
    """
    most = nodes.where("observed").agg(*[F.max(s).alias(f"m_{s}") for s in SIGNALS])
    scaled = nodes.crossJoin(F.broadcast(most))  # one row
    total = F.lit(0.0)
    for s, w in SIGNALS.items():
        total = total + F.when(F.col(f"m_{s}") > 0, w * F.coalesce(F.col(s), F.lit(0)) / F.col(f"m_{s}")).otherwise(0.0)
    score = F.when(F.col("observed"), js_round(total * 100, 2)).otherwise(0.0)
    found = scaled.select(*nodes.columns, score.alias("influence"))
    return found.withColumn("influence_tier", influence_tier(F.col("influence"), F.col("observed")))


def influence_tier(score: Column, observed: Column) -> Column:
    return F.when(~observed, "external").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def top_influencers(scored: DataFrame, most: int = 10) -> DataFrame:
    top = scored.where("observed").orderBy(F.desc("influence"), F.desc("pagerank"), "id").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("influence"), F.desc("pagerank"), "id")))


def surviving_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, observed, external, edges, weight, density and counts by kind."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if("observed").alias("observed"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_weight"), *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in EDGE_WEIGHTS])
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    return n.crossJoin(e).select("*", (F.col("nodes") - F.col("observed")).alias("external"), F.when(pairs > 0, js_round(F.col("edges") / pairs, 6)).otherwise(0.0).alias("density"))


def behaviour(posts: DataFrame, by: str = "author_id") -> DataFrame:
    """Delays between an author's posts: number, upper median, mean and population deviation, in milliseconds. Posts are
    put in order within short slots of time, and the median is found by its rank, so nobody's posts are sorted as a whole."""
    checkpoint_folder(posts.sparkSession)
    linked = before(posts.select(by, "published_at", "event_id").withColumn("at", F.unix_micros("published_at")), "at", by, "published_at", "event_id")
    gaps = linked.where("previous is not null").select(by, ((F.col("at") - F.col("previous")) / 1000).alias("d")).checkpoint()
    stats = gaps.groupBy(F.col(by).alias("of")).agg(F.count(F.lit(1)).alias("delays"), js_round(F.avg("d"), 2).alias("mean_ms"), js_round(F.stddev_pop("d"), 2).alias("deviation_ms"))
    middle = at_ranks(gaps, "d", {"median": (0.5, F.floor(F.col("n") / 2))}, by)
    return middle.join(stats, F.col(by).eqNullSafe(F.col("of"))).select(by, "delays", js_round(F.col("median"), 3).alias("median_ms"), "mean_ms", "deviation_ms")


def coordinated(density: Column, betweenness: Column, delays: Column, mean_ms: Column, deviation_ms: Column) -> Column:
    """Dense, central and evenly timed: at least three timestamps, short delays that hardly vary."""
    return (density > 0.75) & (betweenness > 0.65) & (delays >= 2) & (deviation_ms < 500) & (mean_ms < 2000)


def hashtag_overlap(posts: DataFrame, by: str) -> DataFrame:
    """(by, overlap): share of a collection's posts that have its most common hashtag, 3 decimals; 0 where none has any."""
    n = posts.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    tags = posts.select(by, F.explode(F.array_distinct("hashtags")).alias("tag")).groupBy(by, "tag").agg(F.count(F.lit(1)).alias("c"))
    top = tags.groupBy(F.col(by).alias("of")).agg(F.max("c").alias("c"))
    return n.join(top, F.col(by).eqNullSafe(F.col("of")), "left").select(by, js_round(F.coalesce("c", F.lit(0)) / F.col("n"), 3).alias("overlap"))


def analyze_network(posts: DataFrame, links: DataFrame, by: str, most: int = 10, exact: bool = True) -> DataFrame:
    """One row for each collection: nodes, edges, density, counts by kind, delays between its posts, hashtag overlap and,
    where exact, the mean betweenness of its top influencers (by degree within the collection) and the coordination flag.

    posts: by, id (node), published_at, event_id, hashtags; links: by, src, dst, kind, published_at, event_id.
    """
    weight = F.create_map(*[F.lit(x) for p in EDGE_WEIGHTS.items() for x in p])[F.col("kind")]
    checkpoint_folder(links.sparkSession)
    edges = links.groupBy(by, "src", "dst").agg(F.sum(weight).alias("weight"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in EDGE_WEIGHTS]).checkpoint()
    ends = edges.select(by, F.explode(F.array("src", "dst")).alias("id"), F.lit(False).alias("posted"))
    nodes = ends.unionByName(posts.where("id is not null").select(by, "id", F.lit(True).alias("posted"))).groupBy(by, "id").agg(F.bool_or("posted").alias("observed"), F.count_if(~F.col("posted")).alias("degree"))
    n = nodes.groupBy(by).agg(F.count(F.lit(1)).alias("nodes"), F.count_if("observed").alias("observed"))
    e = edges.groupBy(by).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("total_weight"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in EDGE_WEIGHTS])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", "total_weight", *[f"n_{k}" for k in EDGE_WEIGHTS])]
    whole = n.join(e, by, "left").select(by, "nodes", "observed", (F.col("nodes") - F.col("observed")).alias("external"), *zero)
    pairs = F.col("nodes") * (F.col("nodes") - 1)
    whole = whole.withColumn("density", F.when(pairs > 0, js_round(F.col("edges") / pairs, 6)).otherwise(0.0))
    whole = whole.join(behaviour(posts, by), by, "left").join(hashtag_overlap(posts, by), by, "left")
    if not exact:
        return whole
    place = Window.partitionBy(by).orderBy(F.desc("degree"), "id")
    top = nodes.where("observed").withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
    between = betweenness(edges.select(by, "src", "dst"), by)
    mean = top.join(between, [by, "id"], "left").groupBy(by).agg(js_round(F.avg(F.coalesce("betweenness", F.lit(0.0))), 6).alias("avg_betweenness"))
    flag = coordinated(F.col("density"), F.col("avg_betweenness"), F.col("delays"), F.col("mean_ms"), F.col("deviation_ms"))
    return whole.join(mean, by, "left").withColumn("suspected", F.coalesce(flag, F.lit(False)))


def edge_keys(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """Edges (platform, src, dst) with the surrogate keys of their ends from authors (platform, author_id, author_key);
    an unknown end has none."""
    key = lambda end: authors.select(F.col("platform"), F.col("author_id").alias(end), F.col("author_key").alias(f"{end}_key"))
    return edges.join(key("src"), ["platform", "src"], "left").join(key("dst"), ["platform", "dst"], "left")


def trend_bridge(posts: DataFrame, trends: DataFrame) -> DataFrame:
    """(event_id, trend_key) once for each post and trend that is known."""
    return posts.select("event_id", "trend_key").distinct().join(trends.select("trend_key"), "trend_key", "left_semi").select("event_id", "trend_key")


def edge_platform(explicit: Column, src: Column, dst: Column, single: Column) -> Column:
    """The explicit platform, else the prefix of an end's id, else the only platform of the collection; null: no edge."""
    known = lambda x: F.when(F.split_part(x, F.lit(":"), F.lit(1)).isin("x", "reddit", "telegram") & x.contains(":"), F.split_part(x, F.lit(":"), F.lit(1)))
    return F.coalesce(F.nullif(F.lower(F.trim(explicit)), F.lit("")), known(src), known(dst), single)


def degree_rank(edges: DataFrame) -> DataFrame:
    """(id, edge_count, rank): edges of each node; nodes that no edge ends in have rank 0."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(False).alias("target")), F.struct(F.col("dst").alias("id"), F.lit(True).alias("target")))).alias("e")).select("e.*")
    by = ends.groupBy("id").agg(F.count(F.lit(1)).alias("edge_count"), F.bool_or("target").alias("target"))
    return by.select("id", "edge_count", F.when(F.col("target"), F.col("edge_count")).otherwise(0).alias("rank"))
