"""Toxicity from nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

A document's vector has two parts. The words: every word, hashed to one of SLOTS terms, with its frequency in the
document. The marks: words, short word prefixes, and prefixes that several words of a document share, of which at most
TERMS are chosen from the examples because they mark toxic documents far beyond chance: n * KL(t/n, base rate) must
exceed the logarithm of the number of terms of that kind over NOISE, and the odds rise at least ODDS times. Both parts
are TF-IDF, the document frequencies counted over all documents, each of length 1; marks make up MARKED of the squared
length of a vector that has any. (By words alone the few that make a long text toxic are lost among its others.) A
vector holds the terms that occur in examples; those no example has can't bring one nearer than another.

Marks are chosen from at most EXAMPLES labelled documents, half of the bound for each label, by a hash of the id; the
index holds the first INDEXED of them, likewise. A document's neighbours are the NEAREST of these by cosine, found
exactly: examples are laid out in blocks of like ones, each term stores its largest weight by block, the blocks of the
highest upper bounds are scored, then those others that could still hold a nearer example. Votes weighted by nearness
give a raw score, which isotonic regression over the votes for all EXAMPLES, each left out of its own, turns into a
probability, for documents with marks and for those with words alone each by its own. Documents without any term of an
example have the rate of toxic examples among those without marks. As the bounds cut each label by itself, an example
counts in votes, calibration and rates as the labelled documents of its label that it stands for. The choice of marks
asks what chance would do in the sample itself, so it uses the sample's own rate. The neighbours' ids are returned as
evidence.

Nulls: a null text is empty; labels with a null id or label teach nothing; a null id is held out. Several labels of a document: the
largest. Repeated rows are scored alike. Very long texts are read whole. Without labels of both kinds every score is
the rate of label 1 (0 without any labels). An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pulsegrid.llm.shared import arrow_rows, documents, materialize, release, text_or_empty

#: Labelled documents that marks are chosen from; those of them in the index; marks kept; terms expected by chance; prefix lengths; neighbours; block; blocks scored first; the cut.
EXAMPLES, INDEXED, TERMS, NOISE, PREFIXES, NEAREST, BLOCK, FIRST, CUT = 12_000, 2_048, 2_048, 0.2, (4, 5, 6), 15, 64, 6, 0.7
REPEATS = ((2, "2"), (4, "4"))
#: Least odds of a toxic document among those with a mark, against the odds among all examples; marks' share of a squared length; slots of words.
ODDS, MARKED, SLOTS = 8, 0.9, 1 << 20
#: Words a task remembers; documents and terms handled at once.
MEMO, TOGETHER, TERMS_TOGETHER = 250_000, 64, 12_000
#: Characters of the texts read at once; a document's number and a term in one key.
CHARACTERS, KEY, MARKING = 2_000_000, 1 << 21, 1 << 40
#: Share of the examples from which on a term's weights are stored for every example.
HOT = 1 / 16
PUNCTUATION = ".,;:!?\"'()[]{}<>*_-#@/\\|~`«»“”‘’…"


def held_out(key: str = "doc_id") -> Column:
    """The test fold of the contract: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(True))


def terms_of(word: str) -> list[str]:
    w = word.strip(PUNCTUATION)
    return [w, *(f"{w[:k]}*" for k in PREFIXES if len(w) > k)] if w else []


def with_repeats(counts: dict[str, int]) -> dict[str, int]:
    """Terms with the number of a document's different words that have them; a prefix of two or more words, or of
    four or more, is a further term."""
    more = {f"{t}{m}": n for t, n in counts.items() if t.endswith("*") for least, m in REPEATS if n >= least}
    return counts | more


def base(term: str) -> str:
    return term[:-1] if term[-2:-1] == "*" else term


class _Memo(dict):
    """Word to its slot (SLOTS: nothing is left of it), plus MARKING where it has marks; bounded."""

    def __init__(self, marks: dict[str, int]):
        super().__init__()
        self.bases = {base(t) for t in marks}
        self.heads = {t[: PREFIXES[0]] for t in self.bases if t.endswith("*")}

    def marks_of(self, word: str) -> tuple[str, ...]:
        return tuple(t for t in terms_of(word) if t in self.bases)

    def __missing__(self, word: str) -> int:
        w = word.strip(PUNCTUATION)
        found = zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS if w else SLOTS
        if (w in self.bases or w[: PREFIXES[0]] in self.heads) and self.marks_of(word):
            found += MARKING
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found


class Reader:
    """Terms of texts: slots of words, and SLOTS + number of marks, with their frequencies."""

    def __init__(self, marks: list[str]):
        self.marks = {t: i for i, t in enumerate(marks)}
        self.memo = _Memo(self.marks)

    def keys(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text * KEY + term, frequency), by key; a mark's frequency is the number of different words that
        have it. Arrow cuts the texts, so Python sees each distinct word once."""
        parts = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = np.array(list(map(self.memo.__getitem__, words)), np.int64)
        having = {i: self.memo.marks_of(words[i]) for i in np.flatnonzero(found >= MARKING).tolist()}
        code = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        slots = found % MARKING
        keys = row * KEY + slots[code]
        keys, counts = np.unique(keys[slots[code] < SLOTS], return_counts=True)
        if having:
            on = (found >= MARKING)[code]
            marked: dict[int, dict[str, set[int]]] = {}
            for r, c in set(zip(row[on].tolist(), code[on].tolist(), strict=True)):
                own = marked.setdefault(r, {})
                for t in having[c]:
                    own.setdefault(t, set()).add(int(slots[c]))
            more = [(r * KEY + SLOTS + self.marks[t], n) for r, own in marked.items() for t, n in with_repeats({t: len(x) for t, x in own.items()}).items() if t in self.marks]
            keys, counts = np.concatenate([keys, np.array([k for k, _ in more], np.int64)]), np.concatenate([counts, np.array([n for _, n in more], np.int64)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
        return keys, counts

    def chunks(self, texts: list[str]) -> Iterator[list[str]]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CHARACTERS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, frequencies) of each text, by term."""
        for chunk in self.chunks(texts):
            keys, counts = self.keys(chunk)
            cuts = np.searchsorted(keys, np.arange(len(chunk) + 1) * KEY)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield keys[a:b] % KEY, counts[a:b]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each range, one after the other."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + size, size)


class Model:
    """known: the examples' terms, in order; idf: theirs; ids, toxic: of the examples; weight: labelled documents that
    each stands for; steps: raw and calibrated scores of documents with marks, and of those without; empty: the score of
    documents without terms."""

    def __init__(self, marks: list[str], known: np.ndarray, idf: np.ndarray):
        self.marks, self.known, self.idf = marks, known, idf
        self.steps = [(np.array([0.0]), np.array([0.0]))] * 2
        self.empty = 0.0
        self.build([], [], [])

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the known terms, weights), of length 1."""
        at = np.searchsorted(self.known, terms)
        on = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == terms) if len(self.known) else np.zeros(len(terms), bool)
        at, marks = at[on], terms[on] >= SLOTS
        weight = (1 + np.log(counts[on])) * self.idf[at]
        for part, share in ((marks, MARKED), (~marks, 1 - MARKED)):
            length = np.sqrt((weight[part] ** 2).sum())
            if length:
                weight[part] *= np.sqrt(share if marks.any() and not marks.all() else 1.0) / length
        return at, weight

    def marked(self, vector: tuple[np.ndarray, np.ndarray]) -> bool:
        return bool(len(vector[0]) and self.known[vector[0][-1]] >= SLOTS)

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], ids: list[int], stands: tuple[float, float] = (1.0, 1.0)) -> None:
        """The block-max inverted index: for each term its blocks, with their largest weight, and their postings.
        Examples with a common heaviest mark, else a common most frequent kind of word, lie together."""

        def like(i: int) -> tuple:
            at, weight = vectors[i]
            if not len(at):
                return (2, 0)
            return (0, int(at[weight.argmax()])) if self.marked(vectors[i]) else (1, int(at[(weight / self.idf[at]).argmax()]))

        order = sorted(range(len(vectors)), key=lambda i: (like(i), ids[i]))
        self.toxic, self.ids = np.array([toxic[i] for i in order], float), np.array([ids[i] for i in order], np.int64)
        self.weight = np.where(self.toxic > 0, stands[1], stands[0])
        self.blocks = max(1, -(-len(order) // BLOCK))
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)])
        example = np.repeat(np.arange(len(order), dtype=np.int32), [len(vectors[i][0]) for i in order])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        by = np.lexsort((example, term))
        term, self.example, self.posted = term[by], example[by], weight[by]
        key = term * self.blocks + self.example // BLOCK
        self.start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.start, len(key)))
        self.block = (key[self.start] % self.blocks).astype(np.int32)
        self.most = np.maximum.reduceat(self.posted, self.start) if len(key) else np.zeros(0)
        self.first = np.searchsorted(term[self.start], np.arange(len(self.known) + 1))
        # weights of frequent terms as rows over all examples; the others are looked up in the postings
        often = np.flatnonzero(np.bincount(term, minlength=len(self.known)) >= max(1.0, HOT * len(order))) if len(order) else np.zeros(0, np.int64)
        self.dense = np.zeros((len(often), len(order)))
        self.hot = np.full(len(self.known), -1)
        self.hot[often] = np.arange(len(often))
        on = self.hot[term] >= 0
        self.dense[self.hot[term[on]], self.example[on]] = self.posted[on]
        self.rare = self.hot[term[self.start]] < 0 if len(key) else np.zeros(0, bool)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the nearest of each vector but one (-1: none), by cosine, then id; exact. The blocks of the highest
        bounds are scored first; of the others, only those whose bound reaches the last neighbour found so far."""
        n = len(vectors)
        if not len(self.ids):
            return [(np.zeros(0, int), np.zeros(0))] * n
        row = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term, weight = (np.concatenate(x) for x in zip(*vectors, strict=True))
        own = np.zeros((n, len(self.dense)))
        hot = self.hot[term] >= 0
        own[row[hot], self.hot[term[hot]]] = weight[hot]
        whole = own @ self.dense  # what frequent terms add to every cosine
        size = self.first[term + 1] - self.first[term]
        entry, row, weight = _ranges(self.first[term], size), np.repeat(row, size), np.repeat(weight, size)
        block = self.block[entry]
        bounds = np.bincount(row * self.blocks + block, weight * self.most[entry], n * self.blocks).reshape(n, -1)
        rare = self.rare[entry]
        entry, row, weight, block = entry[rare], row[rare], weight[rare], block[rare]

        def scored(live: np.ndarray) -> np.ndarray:
            """Cosines of the examples in each row's live blocks, 0 elsewhere."""
            on = live[row, block]
            e, length = entry[on], self.size[entry[on]]
            at = _ranges(self.start[e], length)
            found = np.bincount(np.repeat(row[on] * len(self.ids), length) + self.example[at], np.repeat(weight[on], length) * self.posted[at], n * len(self.ids)).reshape(n, -1)
            found = found + np.where(np.repeat(live, BLOCK, axis=1)[:, : len(self.ids)], whole, 0.0)
            if but is not None:
                some = np.flatnonzero(np.array(but) >= 0)
                found[some, np.array(but)[some]] = 0
            return found

        def last(scores: np.ndarray) -> np.ndarray:
            return np.partition(scores, -NEAREST, axis=1)[:, -NEAREST, None] if scores.shape[1] >= NEAREST else np.zeros((n, 1))

        live = np.zeros((n, self.blocks), bool)
        live[np.arange(n)[:, None], np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]] = True
        scores = scored(live)
        rest = (bounds >= last(scores) - 1e-12) & ~live & (bounds > 0)
        if rest.any():
            scores += scored(rest)
        least, out = last(scores), []
        for i in range(n):
            at = np.flatnonzero((scores[i] >= least[i]) & (scores[i] > 0))
            at = at[np.lexsort((self.ids[at], -scores[i, at]))][:NEAREST]
            out.append((at, scores[i, at]))
        return out

    def vote(self, at: np.ndarray, near: np.ndarray, marked: bool) -> float:
        """The share of toxic ones among the neighbours, weighted by nearness; of marked documents, less where none is near."""
        if not len(at):
            return 0.0
        weight = near**2 * self.weight[at]
        return float((weight * self.toxic[at]).sum() / weight.sum() * (near[: max(1, len(near) // 3)].mean() ** 0.5 if marked else 1.0))

    def calibrate(self, raw: np.ndarray, toxic: np.ndarray, marked: bool, stands: tuple[float, float] = (1.0, 1.0)) -> None:
        """Isotonic regression by pooling adjacent violators."""
        blocks: list[list[float]] = []  # raw sum, toxic sum, count, each weighted
        for r, y in sorted(zip(raw, toxic, strict=True)):
            w = stands[int(y)]
            blocks.append([r * w, y * w, w])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        if blocks:
            self.steps[marked] = (np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks]))

    def batches(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[int]]:
        """Numbers of vectors to search for together."""
        held, size = [], 0
        for i, (terms, _) in enumerate(vectors):
            held.append(i)
            size += len(terms)
            if len(held) >= TOGETHER or size >= TERMS_TOGETHER:
                yield held
                held, size = [], 0
        if held:
            yield held

    def scores(self, texts: list[str], reader: Reader) -> list[tuple[float, list[int]]]:
        """(score, evidence) of each text; equal ones are scored once."""
        distinct = list(dict.fromkeys(texts))
        vectors = [self.vector(*x) for x in reader.many(distinct)]
        out: dict[str, tuple[float, list[int]]] = {}
        for held in self.batches(vectors):
            for i, (at, near) in zip(held, self.nearest([vectors[i] for i in held]), strict=True):
                marked = self.marked(vectors[i])
                out[distinct[i]] = (float(np.interp(self.vote(at, near, marked), *self.steps[marked])), [int(x) for x in self.ids[at[:3]]]) if len(at) else (self.empty, [])
        return [out[t] for t in texts]


def _bounded_labels(labels: DataFrame, most: int, indexed: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, in_index) to learn from, at most about most / 2 of each label by a hash of the id, and of these
    about indexed / 2 for the index; the numbers of all by label."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000))

    def within(bound: int) -> Column:
        share = F.lit(0)
        for label, n in counts.items():
            share = F.when(F.col("toxic") == label, int(min(1.0, bound / 2 / n) * 1_000_000_000)).otherwise(share)
        return place < share

    return known.where(within(most)).withColumn("in_index", within(indexed)), counts


def _marking_terms(examples: DataFrame, n: int, toxic: int) -> list[str]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_, bad = Counter(), Counter()
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                found = with_repeats(Counter(t for w in {x.strip(PUNCTUATION) for x in set(text.lower().split())} for t in terms_of(w)))
                all_.update(found)
                if y:
                    bad.update(found)
            yield pd.DataFrame({"term": list(all_), "n": list(all_.values()), "t": [bad[x] for x in all_]})

    counted = materialize(examples.mapInPandas(count, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "toxic-terms")
    of = F.when(F.col("term").rlike(r"\*[24]?$"), F.length(F.regexp_extract("term", r"\*.*$", 0)) * 10 + F.instr("term", "*")).otherwise(0)
    kinds = {r["k"]: r["count"] for r in counted.groupBy(of.alias("k")).count().collect()}
    p, rate = toxic / n, F.col("t") / F.col("n")
    part = lambda x, q: F.when(x > 0, x * F.log(x / q)).otherwise(0.0)
    gain = F.col("n") * (part(rate, p) + part(1 - rate, 1 - p))
    asked = F.lit(0.0)
    for k, size in kinds.items():
        asked = F.when(of == k, math.log(max(size, 1) / NOISE)).otherwise(asked)
    kept = counted.where((F.col("t") >= 3) & (rate * (1 - p) >= ODDS * p * (1 - rate))).withColumn("gain", gain).where(F.col("gain") >= asked)
    return [r["term"] for r in kept.orderBy(F.desc("gain"), "term").limit(TERMS).collect()]


def _packed(terms: np.ndarray, counts: np.ndarray) -> bytes:
    return np.concatenate([terms, counts]).astype(np.int32).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, np.int32).astype(np.int64)
    return both[: len(both) // 2], both[len(both) // 2 :]


def _frequencies(docs: DataFrame, marks: list[str], known: np.ndarray) -> np.ndarray:
    """How many of all documents hold each known term."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, n = Reader(marks), np.zeros(SLOTS + len(marks), np.int64)
        for batch in batches:
            for chunk in reader.chunks(batch["text"].tolist()):
                n += np.bincount(reader.keys(chunk)[0] % KEY, minlength=len(n))
        own = shared.value
        own = own[n[own] > 0]
        yield pd.DataFrame({"i": own, "n": n[own]})

    rows = docs.select(text_or_empty().alias("text")).mapInPandas(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # SLOTS + TERMS rows at most
    found = np.zeros(SLOTS + len(marks), np.int64)
    found[rows["i"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return found[known]


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, indexed: int = INDEXED) -> Model:
    """Learn from labels (doc_id, toxic) outside the test fold; what the driver holds is bounded by indexed, TERMS and SLOTS."""
    chosen, known = _bounded_labels(labels, most, min(most, indexed))
    chosen = materialize(chosen, "toxic-labels")
    kept = {r["toxic"]: r["count"] for r in chosen.where("in_index").groupBy("toxic").count().collect()}  # two rows at most
    stands = tuple(known[y] / kept[y] if kept.get(y) else 1.0 for y in (0, 1))
    docs = docs.select("doc_id", "text")
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "in_index", text_or_empty().alias("text"))  # at most `most` labels
    with arrow_rows(docs.sparkSession):
        examples = materialize(texts, "toxic-examples")
        tally = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
        n, bad = sum(tally.values()), tally.get(1, 0)
        if not bad or bad == n:
            model = Model([], np.zeros(0, np.int64), np.zeros(0))
            model.empty = bad / n if n else 0.0
            return model
        marks = _marking_terms(examples, n, bad)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = Reader(marks)
            for batch in batches:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [_packed(*x) for x in reader.many(batch["text"].tolist())]})

        rows = examples.where("in_index").mapInPandas(read, "doc_id long, toxic int, terms binary").orderBy("doc_id", "terms").collect()  # the examples' terms
        found = [_unpacked(bytes(r["terms"])) for r in rows]
        terms = np.unique(np.concatenate([t for t, _ in found]))
        frequency, total = _frequencies(docs, marks, terms), docs.count()
    model = Model(marks, terms, np.log(1 + total / (1 + frequency)))
    model.build([model.vector(*x) for x in found], [r["toxic"] for r in rows], [r["doc_id"] for r in rows], stands)
    return _calibrated(model, examples, known, tally)


def _calibrated(model: Model, examples: DataFrame, known: dict[int, int], tally: dict[int, int]) -> Model:
    """Fits the steps and the rate of documents without terms from the votes for all examples, found in tasks."""
    shared = examples.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        reader, place = Reader(own.marks), {int(i): at for at, i in enumerate(own.ids)}
        for batch in batches:
            vectors = [own.vector(*x) for x in reader.many(batch["text"].tolist())]
            left = [place.get(int(i), -1) for i in batch["doc_id"]]
            raw = np.zeros(len(vectors))
            for held in own.batches(vectors):
                for i, (at, near) in zip(held, own.nearest([vectors[i] for i in held], [left[i] for i in held]), strict=True):
                    raw[i] = own.vote(at, near, own.marked(vectors[i]))
            yield pd.DataFrame({"toxic": batch["toxic"], "marked": [own.marked(v) for v in vectors], "raw": raw})

    with arrow_rows(examples.sparkSession):
        found = examples.select("doc_id", "toxic", "text").mapInPandas(votes, "toxic int, marked boolean, raw double").toPandas()  # at most EXAMPLES rows
    stands = tuple(known[y] / tally[y] if tally.get(y) else 1.0 for y in (0, 1))
    toxic, marked, raw = found["toxic"].to_numpy(float), found["marked"].to_numpy(bool), found["raw"].to_numpy()
    for kind in (False, True):
        model.calibrate(raw[marked == kind], toxic[marked == kind], kind, stands)
    plain = toxic[~marked] if not marked.all() else toxic
    bad = plain.sum()
    model.empty = float(bad * stands[1] / (bad * stands[1] + (len(plain) - bad) * stands[0]))
    return model


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Adds score, predicted and evidence (ids of the nearest examples) to the rows of docs, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size
    docs = docs.drop("toxic_score", "toxic_evidence", "toxic_predicted")
    out = StructType([*docs.schema.fields, StructField("toxic_score", DoubleType()), StructField("toxic_evidence", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = Reader(own.marks)
        for batch in batches:
            found = own.scores([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], reader)
            columns = [*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "toxic_score", "toxic_evidence"])
        release()

    return docs.mapInArrow(run, out).withColumn("toxic_predicted", F.when(F.col("toxic_score") >= cut, 1).otherwise(0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, documents(spark, sf_dir, "labels"))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"), F.col("toxic_evidence").alias("evidence"))
