"""Phrase collocations by contiguous pattern growth, each language by itself.

1. Tasks cut texts into pieces and words and count the words of each language; the sums are written. A word of a language
   has a 64-bit number, the XXH64 of both; a check over all different words makes sure that the numbers are one-to-one,
   and takes the next seed where they are not.
2. The frequent words' numbers set bits in a map of fixed size (BITS). A second pass writes the texts as numbers of words
   whose bit is set; all others, and the ends of pieces, are breaks. (Words that share a bit by chance only cost time.)
3. Projection: each occurrence of a word with a follower becomes a pointer to it with the at most three words on its
   right. A task merges equal ones, and deals them in packed blocks to the task of their prefix.
4. Growth: a prefix's task sorts its projection and extends it to the right depth-first; each extension that is frequent
   narrows the range of pointers in which the next word is looked for.

A prefix with more than a quarter of a task's usual share is split: its pointers go by the next longer prefix, if need be
up to all four words, and what several tasks have counted of it is summed. Such prefixes are found by counting in each
batch those above an eighth of a task's share; every prefix above the bound is found so, and their number is bounded by
24 a task. Everything else that is broadcast is the map and rows counted to be few.

The score of a phrase is that of its lowest-scoring cut, floor(2000000 * a / (l + r)), in decimals of 38 digits. A phrase
is dropped where a longer frequent one that holds it has DROP percent of its count. Ranks are found among the best of
each of SPREAD shares of a language.

Nulls: a null text is empty, a null lang is `und`; ids aren't read. Repeated rows count as often as they come, overlaps and
repeats within a text likewise; ties of score and count go by the phrase's bytes. Very long texts are read whole; a text
without words adds nothing. Other columns are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.shared import arrow_rows, documents, few, materialize, release, shuffle_parts

#: Least count of a phrase; most words of one; factor of the score; percent at which a longer one replaces it; phrases of a language.
LEAST, LONGEST, SCALE, DROP, TOP = 30, 4, 2_000_000, 80, 2_000
#: Bits of the map of frequent words; pointers that a task of growth should have; shares of a language ranked apart; rows of a batch.
BITS, POINTERS, SPREAD, ROWS = 1 << 26, 2_000_000, 64, 2_000
#: Pointers that a task holds before it packs them.
HELD = 1_500_000
SPACES, ENDS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
KIND, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
KIND[list(SPACES)], KIND[list(ENDS)], LOWER[65:91] = 1, 2, np.arange(97, 123)
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
H = [f"h{i}" for i in range(1, LONGEST + 1)]


def cut(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of each word, the different words, number of the piece of each word) of large strings without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = LOWER[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets - offsets[0]] = True
    kind = KIND[data]
    word = kind == 0
    starts = np.flatnonzero(word & (begins[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (begins[1:] | ~np.concatenate([word[1:], [False]])))
    places = np.concatenate([[0], np.cumsum(ends + 1 - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[word])]).dictionary_encode()
    piece = np.cumsum((kind == 2) | begins[:-1])[starts]
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), piece


def numbers(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    head = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh64_intdigest(head + w, seed) for w in words), np.uint64, len(words))


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(lang, its texts) of a batch (lang, text)."""
    lang, text = batch.column(0), batch.column(1).cast(pa.large_string())
    coded = lang.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    for name, a, b in zip(coded.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True):
        yield name, text.take(pa.array(order[a:b]))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, h, n) of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in by_lang(batch):
                code, words, _ = cut(own)
                n = np.bincount(code, minlength=len(words)).astype(np.int64)
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(numbers(words, lang, seed).view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "h", "n"])
        release()

    return texts.mapInArrow(count, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def clashes(words: DataFrame) -> bool:
    """Whether two words have one number, or one has that of a break."""
    found = words.groupBy("h").agg(F.count("*").alias("words")).where("words > 1 or h = 0")
    return bool(found.limit(1).count())


def bit_map(frequent: DataFrame) -> np.ndarray:
    """BITS bits, those of the frequent words' numbers set; at most BITS / 64 rows come to the driver."""
    slot = F.shiftright(F.col("h").bitwiseAND(F.lit(BITS - 1)), 6)
    bit = F.expr("shiftleft(cast(1 as bigint), cast(h & 63 as int))")
    rows = frequent.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toPandas()
    found = np.zeros(BITS // 64, np.uint64)
    found[rows["slot"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return found


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def encoded(texts: DataFrame, bits: np.ndarray, seed: int) -> DataFrame:
    """(words, codes): numbers of a batch's words, the first that of a break, and its texts as places among them."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # of fixed size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in by_lang(batch):
                code, words, piece = cut(own)
                h = numbers(words, lang, seed)
                known = in_map(shared.value, h)
                place = np.where(known, np.cumsum(known), 0).astype(np.uint32)
                new = np.concatenate([[False], piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, bool)
                out = np.zeros(len(code) + int(new.sum()) + 1, np.uint32)
                out[np.arange(len(code)) + np.cumsum(new)] = place[code]
                on = out != 0
                alone = on & ~np.concatenate([[False], on[:-1]]) & ~np.concatenate([on[1:], [False]])
                on &= ~alone
                out[alone] = 0
                out = out[on | np.concatenate([[False], on[:-1]])]
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[np.uint64(0)], h[known]]).tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["words", "codes"])
        release()

    return texts.mapInArrow(encode, "words binary, codes binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of words, pointers (row: four places among them), counts) of each row of encoded texts; equal pointers
    are one, in order."""
    for batch in batches:
        for words, codes in zip(batch.column(0), batch.column(1), strict=True):
            h, c = np.frombuffer(words.as_buffer(), np.uint64), np.frombuffer(codes.as_buffer(), np.uint32)
            c = np.concatenate([c, np.zeros(LONGEST, np.uint32)])
            columns = [c[k : len(c) - LONGEST + k] for k in range(LONGEST)]
            at = np.flatnonzero((columns[0] > 0) & (columns[1] > 0))
            own = np.stack([x[at] for x in columns], axis=1).astype(np.int64)
            for k in range(2, LONGEST):
                own[:, k] *= own[:, k - 1] > 0  # nothing goes on behind a break
            order, starts = _grouped(own)
            yield h, own[order[starts]], np.diff(np.append(starts, len(order)))


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by their four columns, and where each group of equal ones starts in it."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, second = (rows[:, k] << 32 | rows[:, k + 1] for k in (0, 2))
    if rows.max() < 1 << 16:
        key = (rows[:, 0] << 48 | rows[:, 1] << 32 | rows[:, 2] << 16 | rows[:, 3]).view(np.uint64)
        order = np.argsort(key)
    else:
        order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def longer(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The key of a prefix and one more word; that of a single word is its number."""
    with np.errstate(over="ignore"):
        mixed = (key ^ (key >> np.uint64(29))) * TURN + (h ^ MIX)
        return (mixed ^ (mixed >> np.uint64(32))) * MIX


def _among(keys: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(keys), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys


def split_prefixes(pieces: DataFrame, hot_words: np.ndarray, parts: int, limit: float) -> np.ndarray:
    """Sorted keys of the prefixes of one to three words whose pointers are dealt by longer ones."""
    if not len(hot_words):
        return hot_words
    words = np.sort(hot_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, rows, n in _blocks(batches):
            least = n.sum() / (8 * parts)
            key = h[rows[:, 0]]
            on = _among(key, words)
            key, rows, n = key[on], rows[on], n[on]
            for k in (1, 2):
                key = longer(key, h[rows[:, k]])
                found, group = np.unique(key, return_inverse=True)
                times = np.bincount(group, n, len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found[times > least].view(np.int64)), pa.array(times[times > least].astype(np.int64))], names=["key", "n"])

    found = pieces.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > limit / 2).select("key")
    more = found.toPandas()["key"].to_numpy(np.int64).view(np.uint64)  # at most 16 a part
    return np.unique(np.concatenate([words, more]))


def _pack(words: np.ndarray, pointers: np.ndarray, n: np.ndarray) -> bytes:
    """A block: sorted numbers of words as byte planes of their differences, pointers (four columns of places among
    them) and counts, compressed together."""
    steps = np.diff(words, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
    raw = b"".join((len(words).to_bytes(4, "little"), len(n).to_bytes(4, "little"), np.ascontiguousarray(steps).tobytes(), pointers.T.astype(kind).tobytes(), n.astype(np.uint32).tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    words, n = (int.from_bytes(raw[i : i + 4], "little") for i in (0, 4))
    kind = np.uint16 if words <= 1 << 16 else np.uint32
    at = 8 + 8 * words
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * words, 8).reshape(8, -1).T).view(np.uint64).ravel()
    pointers = np.frombuffer(raw, kind, LONGEST * n, at).reshape(LONGEST, -1).T
    return np.cumsum(steps, dtype=np.uint64), pointers.astype(np.int32), np.frombuffer(raw, np.uint32, n, at + pointers.nbytes).astype(np.int64)


def projected(pieces: DataFrame, split: np.ndarray, parts: int) -> DataFrame:
    """(part, block): packed pointers, for the task of their prefix."""
    shared = pieces.sparkSession.sparkContext.broadcast(split)  # 24 keys a part at most

    def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        split = shared.value
        h = np.unique(np.concatenate([words for words, _, _ in held]))
        rows = np.concatenate([np.searchsorted(h, words).astype(np.int32)[places] for words, places, _ in held])
        n = np.concatenate([x for *_, x in held])
        held.clear()
        key = h[rows[:, 0]]
        deep = np.flatnonzero(_among(key, split))
        for k in range(1, LONGEST):
            key[deep] = longer(key[deep], h[rows[deep, k]])
            deep = deep[_among(key[deep], split)]
        with np.errstate(over="ignore"):
            part = ((key * MIX >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        blocks = []
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            used, places = np.unique(rows[order[a:b]], return_inverse=True)  # in the order of the numbers, as h is
            own = places.reshape(-1, LONGEST)
            by, first = _grouped(own)
            blocks.append(_pack(h[used], own[by[first]], np.add.reduceat(n[order[a:b]][by], first)))
        return pa.RecordBatch.from_arrays([pa.array(part[order[starts]], pa.int32()), pa.array(blocks, pa.binary())], names=["part", "block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for h, rows, n in _blocks(batches):
            if len(n):
                held.append((h, rows.astype(np.int32), n))
            if sum(len(x) for *_, x in held) >= HELD:
                yield packed(held)
        if held:
            yield packed(held)
        release()

    return pieces.mapInArrow(deal, "part int, block binary")


class Growth:
    """Frequent phrases of the prefixes of one task. rows: four places among h (0: a break), n: their counts."""

    def __init__(self, h: np.ndarray, rows: np.ndarray, n: np.ndarray, split: np.ndarray, least: int):
        order = np.lexsort((rows[:, 2] << 32 | rows[:, 3], rows[:, 0] << 32 | rows[:, 1]))
        self.columns = [np.ascontiguousarray(rows[order, k]) for k in range(LONGEST)]
        self.upto = np.concatenate([[0], np.cumsum(n[order])])
        self.h, self.split, self.least = h, split, least
        self.found: list[tuple[tuple[int, ...], int, bool]] = []

    def groups(self, depth: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(place of a word, its range of pointers) of the words at a depth within a range."""
        own = self.columns[depth][lo:hi]
        edges = [lo, *(np.flatnonzero(own[1:] != own[:-1]) + lo + 1).tolist(), hi]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(self.columns[depth][a]), a, b

    def grow(self, prefix: tuple[int, ...], key: np.ndarray | None, lo: int, hi: int) -> None:
        """Extends a prefix to the right; key: its own, where it is split."""
        for word, a, b in self.groups(len(prefix), lo, hi):
            n = int(self.upto[b] - self.upto[a])
            own, partly = None, False
            if key is not None:
                own = longer(key, self.h[[word]])
                partly = bool(_among(own, self.split)[0])
            if word and (partly or n >= self.least):
                phrase = (*prefix, word)
                self.found.append((phrase, n, partly))
                if len(phrase) < LONGEST:
                    self.grow(phrase, own if partly else None, a, b)

    def run(self) -> list[tuple[tuple[int, ...], int, bool]]:
        if len(self.columns[0]):
            for word, a, b in self.groups(0, 0, len(self.columns[0])):
                key = self.h[[word]]
                self.grow((word,), key if _among(key, self.split)[0] else None, a, b)
        return self.found


def grown(dealt: DataFrame, split: np.ndarray, least: int) -> DataFrame:
    """(h1 … h4, words, a, partly) of frequent phrases; partly: other tasks have more of it."""
    shared = dealt.sparkSession.sparkContext.broadcast(split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            own += [_unpack(block) for block in batch.column(1).to_pylist()]
        if own:
            h = np.unique(np.concatenate([[np.uint64(0)], *(w for w, _, _ in own)]))
            rows = np.concatenate([np.searchsorted(h, w)[r] for w, r, _ in own])
            n = np.concatenate([x for _, _, x in own])
            own.clear()
            found = Growth(h, rows, n, shared.value, least).run()
            places = np.array([[*p, *[0] * (LONGEST - len(p))] for p, _, _ in found], np.int64).reshape(-1, LONGEST)
            columns = [*(pa.array(h[places[:, k]].view(np.int64)) for k in range(LONGEST)), pa.array([len(p) for p, _, _ in found], pa.int32()), pa.array([a for _, a, _ in found], pa.int64()), pa.array([x for *_, x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*H, "words", "a", "partly"])
        release()

    kinds = ", ".join(f"{c} long" for c in H)
    return dealt.mapInArrow(run, f"{kinds}, words int, a long, partly boolean")


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def inner_phrases(found: DataFrame) -> DataFrame:
    """(s1 … s4, at, size, h1 … h4, a): contiguous phrases of two or more words within each longer one."""
    parts = [(at, size) for size in range(2, LONGEST) for at in range(LONGEST - size + 1)]
    within = F.array(*[F.when(F.col("words") >= F.greatest(F.lit(at + size), F.lit(size + 1)), F.struct(F.lit(at).alias("at"), F.lit(size).alias("size"), *[(F.col(H[at + k]) if k < size else F.lit(0).cast("long")).alias(f"s{k + 1}") for k in range(LONGEST)])) for at, size in parts])
    rows = found.where("words > 2").select(*H, "a", F.explode(F.array_compact(within)).alias("inner"))
    return rows.select("inner.*", *H, "a")


def scored(found: DataFrame, frequent: DataFrame, hot: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one replaces. found: (h1 … h4, words, a), written;
    hot: the frequent words that are many phrases' own, few."""
    inner = inner_phrases(found)
    replaced = inner.groupBy(*[F.col(f"s{k}").alias(f"h{k}") for k in range(1, LONGEST + 1)]).agg(F.max("a").alias("longest"))
    kept = found.join(replaced, H, "left").where(F.col("longest").isNull() | (_big("longest") * 100 < _big("a") * DROP)).drop("longest")
    counts = found.select(*[F.col(h).alias(f"s{k}") for k, h in enumerate(H, 1)], F.col("a").alias("n"))
    several = inner.join(counts, [f"s{k}" for k in range(1, LONGEST + 1)]).select(*H, "at", "size", "n", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word"))
    single = found.select(*H, F.posexplode(F.slice(F.array(*H), 1, F.col("words"))).alias("at", "h"))
    of = lambda rows, words: rows.join(words, "h").select(*H, "at", F.lit(1).alias("size"), "n", "lang", "word")
    rare = frequent.join(F.broadcast(hot.select("h")), "h", "left_anti")
    ones = of(single, F.broadcast(hot)).unionByName(of(single.join(F.broadcast(hot.select("h")), "h", "left_anti"), rare))
    known = several.unionByName(ones).groupBy(*H).agg(F.max("lang").alias("lang"), F.map_from_entries(F.collect_list(F.struct(F.col("at") * 10 + F.col("size"), "n"))).alias("n"), F.sort_array(F.collect_list(F.when(F.col("size") == 1, F.struct("at", "word")))).alias("spelled"))
    whole = kept.join(known, H)
    l_of, r_of = (lambda k: F.col("n")[F.lit(k)]), (lambda k: F.col("n")[F.lit(k * 10) + F.col("words") - k])
    cuts = F.array_compact(F.array(*[F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), l_of(k).alias("l"), r_of(k).alias("r"))) for k in range(1, LONGEST)]))
    withcuts = whole.select("lang", F.array_join(F.transform("spelled", lambda x: x["word"]), " ").alias("phrase"), "a", cuts.alias("cuts"))
    quotient = F.expr(f"transform(cuts, c -> named_struct('score', (cast(a as decimal(19,0)) * {SCALE}) div (cast(c.l as decimal(19,0)) + cast(c.r as decimal(19,0))), 'k', c.k, 'l', c.l, 'r', c.r))")
    return withcuts.select("lang", "phrase", "a", F.array_min(quotient).alias("lowest")).select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    with arrow_rows(spark, ROWS):
        seed = 0
        while clashes(words := materialize(word_counts(texts, seed), "phrase-words")):
            seed += 1
        frequent = words.where(F.col("n") >= least)
        total = words.agg(F.sum("n")).first()[0] or 0
        parts = max(shuffle_parts(spark), -(-total // POINTERS))
        limit = max(4.0 * least, total / (4 * parts))
        hot = frequent.where(F.col("n") > limit)  # at most 4 a part
        pieces = materialize(encoded(texts, bit_map(frequent), seed), "phrase-pieces")
        split = split_prefixes(pieces, hot.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64), parts, limit)
        dealt = projected(pieces, split, parts).repartitionById(parts, F.col("part"))
        rows = materialize(grown(dealt, split, least), "phrase-growth")
    summed = rows.where("partly").groupBy(*H, "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    found = materialize(rows.where("not partly").drop("partly").unionByName(summed), "phrases")
    ranked = scored(found, frequent, hot)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    best = ranked.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(few(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, t FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS t FROM d)),
q AS (SELECT lang, piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS ws FROM p),
w AS (SELECT lang, piece, unnest(ws) AS w1, unnest(range(1, len(ws) + 1)) AS spot FROM q),
g AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY piece ORDER BY spot)),
f AS (SELECT lang, [w1] AS ws, count(*) AS a FROM g GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT * FROM f WHERE len(ws) > 1),
i AS (SELECT lang, unnest(list_concat(CASE WHEN len(ws) = 3 THEN [ws[1:2], ws[2:3]] ELSE [ws[1:2], ws[2:3], ws[3:4], ws[1:3], ws[2:4]] END, [])) AS ws, a FROM c WHERE len(ws) > 2),
x AS (SELECT lang, ws, max(a) AS longest FROM i GROUP BY ALL),
k AS (SELECT c.* FROM c LEFT JOIN x USING (lang, ws) WHERE x.longest IS NULL OR 100 * CAST(x.longest AS HUGEINT) < {DROP} * CAST(c.a AS HUGEINT)),
u AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS cut FROM k),
s AS (SELECT u.lang, u.ws, u.a, u.cut, l.a AS l, r.a AS r, {SCALE} * CAST(u.a AS HUGEINT) // (CAST(l.a AS HUGEINT) + r.a) AS score FROM u
  JOIN f l ON l.lang = u.lang AND l.ws = u.ws[1:u.cut] JOIN f r ON r.lang = u.lang AND r.ws = u.ws[u.cut + 1:]),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
n AS (SELECT lang, sum(a) AS n FROM f WHERE len(ws) = 1 GROUP BY lang),
z AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM m),
v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT v.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM v JOIN n USING (lang) WHERE rank <= {TOP}
"""
