"""Near-duplicate detection by b-bit MinHash.

A document's set is the hashes of its distinct word shingles. Documents with equal sets are one class, so copies are
compared once; classes are numbered when their table is written. Each class has K minima; BANDS bands of ROWS minima
are its bucket keys, and the B low bits of every minimum are its packed b-bit signature. A second packed sketch, one
parity bit for each hash value modulo PARITY, bounds the symmetric difference of two sets from below: it can only rule
out pairs that are certainly too far apart.

Buckets are cut into blocks of bounded size and searched in memory: pairs stay whose collision-corrected b-bit
estimate is within SLACK of the threshold and whose parity sketches allow a link. Of these, a spanning forest in order
of the sketch distance is confirmed on full sets. First every block is searched by itself. A bucket of several blocks
that still holds several components is then searched across its blocks: all members outside its largest component
against all members, so a bucket that one large group of near copies fills costs no pairs of blocks. Where a forest
pair fails, all pairs of its buckets between components found so far that the sketches allow are confirmed. So every
link between different sets that shares a bucket ends within one component, without listing the pairs of large
groups. A link at exactly the threshold shares no bucket with probability under 1e-8.

Components come from label propagation on tables in the shared folder; nothing of the documents passes through the
driver.

Nulls: a null text, or one without words, has an empty set, links with nothing and is kept. Fewer words than a shingle: the whole
sequence is the only shingle. Every row is a node of its own: rows with null or repeated ids take part like others,
and rows that share an id but not a text are not linked by that. A component's id is the smallest of its ids, null where
all are null; one of its rows (by id, nulls last, then the text's SHA-256) is marked as its leader, so are all rows
that equal it. An empty table gives an empty result. Input columns are not overwritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import arrow_rows, documents, few, materialize, release, text_or_empty

ROWS, BANDS, BITS, PARITY, SEED = 3, 21, 4, 4_096, 3
K = 64
BLOCK, SLACK = 512, 0.27
MEMO = 250_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_random = np.random.default_rng(SEED)
#: Odd multipliers and offsets of the K hash functions.
MULTIPLY = _random.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, K, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """64-bit hash of each word; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = found
        return found


def shingles(text: str, size: int, memo: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. bytes.lower and bytes.split know ASCII only, as asked."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * M1 + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(K, ~np.uint64(0))
    for i in range(0, len(s), 4096):  # bounded memory for very long texts
        part = s[i : i + 4096, None] * MULTIPLY + ADD
        part ^= part >> np.uint64(32)
        part *= M2
        out = np.minimum(out, part.min(0))
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    rows = m[: ROWS * BANDS].reshape(BANDS, ROWS)
    for r in range(ROWS):
        keys = _mix(keys * M1 + rows[:, r])
    return keys.view(np.int64)


def b_bits(m: np.ndarray) -> bytes:
    """The BITS low bits of each minimum (of its middle, which the final multiplication mixes well), one byte each two."""
    low = ((m >> np.uint64(32)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[::2] | (low[1::2] << 4)).tobytes()


def parity(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n, set_key, bands, bits, odd) of every document; texts don't leave their task. text_key: the
    text's SHA-256 in hexadecimal, as F.sha2 has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, seen = Words(), {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                known = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                if known not in seen:
                    if len(seen) > 2_000:
                        seen.clear()
                    s = shingles(text, size, memo)
                    if len(s):
                        m = minima(s)
                        seen[known] = (known, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(m), b_bits(m), parity(s))
                    else:
                        seen[known] = (known, 0, None, None, None, None)
                rows.append(seen[known])
            found = pd.DataFrame(rows, columns=["text_key", "n", "set_key", "bands", "bits", "odd"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True).astype({"doc_id": "Int64"}), found], axis=1)
        memo.clear()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    with arrow_rows(docs.sparkSession):
        return materialize(rows.mapInPandas(run, "doc_id long, text_key string, n long, set_key binary, bands array<long>, bits binary, odd binary"), "near-signatures")


def _possible(a: pd.DataFrame, b: pd.DataFrame, threshold: float) -> np.ndarray:
    """Sketch distances of the pairs that may be links, -1 elsewhere."""
    na, nb = a["n"].to_numpy(float), b["n"].to_numpy(float)
    total = na[:, None] + nb[None]
    far = total * (1 - threshold) / (1 + threshold) + 1e-9  # most elements that a link's sets differ in
    ok = np.abs(na[:, None] - nb[None]) <= far
    bits = [np.frombuffer(b"".join(x["bits"]), np.uint8).reshape(len(x), -1) for x in (a, b)]
    odd = [np.frombuffer(b"".join(x["odd"]), np.uint64).reshape(len(x), -1) for x in (a, b)]
    i, j = np.nonzero(ok)
    out = np.full(ok.shape, -1, np.int32)
    for at in range(0, len(i), 16_384):
        x, y = i[at : at + 16_384], j[at : at + 16_384]
        # share of equal b-bit values, corrected for equality by chance
        differ = bits[0][x] ^ bits[1][y]
        equal = ((differ & 15) == 0).sum(1) + ((differ >> 4) == 0).sum(1)
        chance = 1 / (1 << BITS)
        likely = (equal / K - chance) / (1 - chance) >= threshold - SLACK
        x, y = x[likely], y[likely]
        apart = np.bitwise_count(odd[0][x] ^ odd[1][y]).sum(1)
        near = apart <= far[x, y]
        out[x[near], y[near]] = apart[near]
    return out


def _pairs_of(a: pd.DataFrame, b: pd.DataFrame, same: bool, threshold: float, forest: bool) -> Iterator[tuple[int, int]]:
    """Pairs (smaller number, larger number) of classes: a spanning forest of the possible links between rows of a and
    of b, or all between components. same: a and b are one block; else b may hold rows of a's kind (side 0), and a pair
    of two such is taken up where a has the smaller one."""
    apart = _possible(a, b, threshold)
    if same:
        apart[np.tril_indices(len(a))] = -1
    else:
        apart[(b["outside"].to_numpy(bool)[None]) & (b["cid"].to_numpy()[None] <= a["cid"].to_numpy()[:, None])] = -1
    ca, cb = a["comp"].to_numpy(), b["comp"].to_numpy()
    apart[ca[:, None] == cb[None]] = -1
    i, j = np.nonzero(apart >= 0)
    ia, ib = a["cid"].to_numpy()[i], b["cid"].to_numpy()[j]
    low, high = np.minimum(ia, ib), np.maximum(ia, ib)
    if not forest:
        yield from zip(low.tolist(), high.tolist())
        return
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for k in np.lexsort((high, low, apart[i, j])):
        x, y = find(int(ca[i[k]])), find(int(cb[j[k]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            yield int(low[k]), int(high[k])


def _alone(members: DataFrame) -> DataFrame:
    """(bucket, i, j, side, outside, cid, comp): each block of rows (bucket, m, cid, comp) by itself."""
    block = F.pmod(F.xxhash64("cid"), F.ceil(F.col("m") / BLOCK)).cast("int")
    return members.select("bucket", block.alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), F.lit(True).alias("outside"), "cid", "comp")


def _across(members: DataFrame) -> DataFrame:
    """(bucket, i, j, side, outside, cid, comp): blocks of members outside their bucket's largest component (side 0),
    each with every block of the bucket's members (side 1)."""
    by = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = by.groupBy("bucket").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    sizes = sizes.select("bucket", F.col("top.comp").alias("largest"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int").alias("left"), F.ceil(F.col("n") / BLOCK).cast("int").alias("right"))
    placed = members.join(sizes, "bucket").withColumn("outside", F.col("comp") != F.col("largest"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    as_left = F.transform(every("right"), lambda x: F.struct(own("left").alias("i"), x.alias("j"), F.lit(0).alias("side")))
    as_right = F.transform(every("left"), lambda x: F.struct(x.alias("i"), own("right").alias("j"), F.lit(1).alias("side")))
    at = F.explode(F.when(F.col("outside"), F.concat(as_left, as_right)).otherwise(as_right))
    return placed.withColumn("at", at).select("bucket", "at.i", "at.j", "at.side", "outside", "cid", "comp")


def _search(dealt: DataFrame, sketches: DataFrame, threshold: float, forest: bool) -> DataFrame:
    """(a, b) pairs of classes to confirm, from rows of _alone or _across."""
    rows = dealt.join(sketches.select("cid", "n", "bits", "odd"), "cid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        done: set = set()

        def close(group: pd.DataFrame) -> list[tuple[int, int]]:
            if len(group) < 2:
                return []
            if group["j"].iloc[0] < 0:
                return list(_pairs_of(group, group, True, threshold, forest))
            a, b = group[group["side"] == 0], group[group["side"] == 1]
            return list(_pairs_of(a, b, False, threshold, forest)) if len(a) and len(b) else []

        for batch in batches:
            whole = pd.concat([*held, batch], ignore_index=True) if held else batch
            key = (whole["bucket"].to_numpy(), whole["i"].to_numpy(), whole["j"].to_numpy())
            new = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)) + 1
            starts = [0, *new.tolist()]
            out = []
            for s, e in zip(starts, starts[1:]):
                if e - s > 1:
                    out += close(whole.iloc[s:e])
            held = [whole.iloc[starts[-1] :]]
            out = [p for p in dict.fromkeys(out) if p not in done]
            done.update(out)
            if len(done) > 200_000:
                done.clear()
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if held:
            yield pd.DataFrame(close(held[0]), columns=["a", "b"], dtype="int64")

    ordered = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "cid")
    return ordered.mapInPandas(run, "a long, b long").distinct()


def _confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b, link) with link decided on the full sets of both classes, from one text of each class that is asked for."""
    pairs = materialize(pairs, "near-pairs")
    asked = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    keys = materialize(classes.select("cid", F.col("first.doc_id").alias("own_id"), F.col("first.text_key").alias("own_key")).join(asked, "cid", "left_semi"), "near-asked")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_key", F.sha2("text", 256))
    found = text.join(few(keys), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key"))).select("cid", "text")
    # rows that repeat id and text have equal sets: any of them will do
    both = pairs.join(found.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(found.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        for batch in batches:
            link = []
            for x, y in zip(batch["ta"], batch["tb"], strict=True):
                p, q = shingles(x, size, memo), shingles(y, size, memo)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                link.append(threshold[1] * shared >= threshold[0] * (len(p) + len(q) - shared))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "link": link})
        memo.clear()
        release()

    with arrow_rows(docs.sparkSession):
        return materialize(both.mapInPandas(run, "a long, b long, link boolean").groupBy("a", "b").agg(F.max("link").alias("link")), "near-confirmed")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, comp): smallest id reachable over links (a, b), for every id that has one. Labels travel along links and
    jump to their label's label, two such steps for each table in the shared folder, until none moves (they only ever
    fall). known: labels from some of the links, to begin with."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    labels = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp"))
    if known is not None:
        labels = labels.union(known.select("id", "comp")).groupBy("id").agg(F.min("comp").alias("comp"))

    def step(labels: DataFrame) -> DataFrame:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        to = labels.join(near, F.col("id") == F.col("a")).select("id", "was", F.least("comp", "near").alias("to"))
        return to.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("next")), "to").select("id", "was", F.least("to", "next").alias("comp"))

    labels = materialize(labels, "near-labels")
    while True:
        new = materialize(step(step(labels.withColumn("was", F.col("comp")))), "near-labels")
        moved = new.where("comp < was").limit(1).count()
        labels = new.select("id", "comp")
        if not moved:
            return labels


def _members(classes: DataFrame) -> DataFrame:
    """(bucket, m, cid) of buckets with m > 1 members. Large buckets are few; they are told apart first, so that their
    members are not dealt by bucket."""
    buckets = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = materialize(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "near-shared")
    large = few(shared.where(F.col("m") > BLOCK).select("bucket", F.col("m").alias("many")))
    marked = buckets.join(large, "bucket", "left")
    rest = marked.where("many is null").join(shared.where(F.col("m") <= BLOCK), "bucket").select("bucket", "m", "cid")
    return materialize(marked.where("many is not null").select("bucket", F.col("many").alias("m"), "cid").unionByName(rest), "near-buckets")


def near_duplicates(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, leader) of every row; links: threshold[1] * shared >=
    threshold[0] * union. kept: the row has its component's id; leader: the row, or one that equals it, stands for its
    component."""
    least = threshold[0] / threshold[1]
    rows = signatures(docs, size)
    # of a component or class: its smallest row, nulls last
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    whole = rows.where("n > 0").groupBy("set_key").agg(smallest.alias("first"), F.min(F.struct("n", "bands", "bits", "odd")).alias("s"))
    classes = materialize(whole.select(F.monotonically_increasing_id().alias("cid"), "set_key", "first", "s.*"), "near-classes")
    sketches = classes.select("cid", "n", "bits", "odd")
    members = _members(classes)
    tried = _confirm(_search(_alone(members.withColumn("comp", F.col("cid"))), sketches, least, True), classes, docs, size, threshold)
    found = components(tried.where("link"))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    def with_more(more: DataFrame) -> DataFrame:
        nonlocal found
        if more.where("link").limit(1).count():
            found = components(tried.unionByName(more).where("link"), found)
        return tried.unionByName(more)

    large = members.where(F.col("m") > BLOCK)
    if large.limit(1).count():
        crossed = materialize(_across(labelled(large)), "near-across")
        if crossed.limit(1).count():
            tried = with_more(_confirm(_search(crossed, sketches, least, True), classes, docs, size, threshold))
    failed = tried.where("not link").select("a", "b")
    if failed.limit(1).count():
        # buckets that hold both ends of a failed pair: all possible pairs between their components
        ends = failed.join(members.select(F.col("cid").alias("a"), "bucket"), "a").join(members.select(F.col("cid").alias("b"), "bucket"), ["b", "bucket"], "left_semi")
        again = materialize(labelled(members.join(ends.select("bucket").distinct(), "bucket", "left_semi")), "near-again")
        open_ = again.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
        again = again.join(open_, "bucket", "left_semi")
        dealt = _alone(again.where(F.col("m") <= BLOCK)).unionByName(_across(again.where(F.col("m") > BLOCK)))
        with_more(_confirm(_search(dealt, sketches, least, False).join(failed, ["a", "b"], "left_anti"), classes, docs, size, threshold))
    linked = classes.select("cid", "set_key", "first").join(found, F.col("cid") == F.col("id"))
    tops = linked.groupBy("comp").agg(F.min("first").alias("top"))
    of_class = classes.select("cid", "set_key", "first").join(linked.join(tops, "comp").select("cid", "top"), "cid", "left").select("set_key", F.coalesce("top", "first").alias("top"))
    of_class = materialize(of_class, "near-tops")  # so that the join that follows can split the rows of a set that very many have
    # ids that are not null come first, so the smallest row has the smallest id
    of_row = rows.select("doc_id", "text_key", "n", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("top.doc_id")).otherwise(F.col("doc_id"))
    leads = F.when(F.col("n") > 0, F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_key") == F.col("top.text_key"))).otherwise(True)
    return of_row.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key", leads.alias("leader"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), 3, (85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
