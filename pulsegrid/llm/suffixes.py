"""Suffix-array deduplication of repeated byte strings.

A byte is removed where a string of WIDTH bytes (a window) covers it that also starts in a document with a smaller id.
The suffix array is sparse: each window is reached from the suffix that starts at its leading token, the eight-byte
token within the window that comes first in a fixed pseudo-random order (rare tokens of a sample before frequent
ones), so equal windows have equal leading tokens at equal places. A suffix and the run of windows that it leads are
one piece, about one for every 22 bytes.

Splitters, sampled suffixes in byte order, range-partition the suffixes by their leading tokens into buckets of about
equal weight; where one token fills more than a bucket, splitters reach into the token after it. A bucket first
receives, for each suffix, hashes of the token with the 21 bytes before and after it; a window contains one of the
two, so a piece whose hashes occur in no other document is done. Only the other pieces travel with their text to
their bucket. There the suffixes are sorted locally by multikey quicksort, eight bytes at a time, where each pass
orders only the groups that are still equal; so are their left contexts, read backwards. Common lengths of neighbours
in the two orders tell, for every place of the leading token, which windows are equal.

Buckets are compared across their boundaries: a window that ends before the second token can belong to suffixes on
both sides of a splitter within that token. Such a window goes to the bucket that holds the smallest suffix beginning
as the window does, so its equals on both sides meet there.

A stretch that repeats itself every one to PERIODS bytes ("-----", blanks) has only so many different windows; its first
ones stand for all, and what is found for them is spread over the stretch when the results are put together. So a
megabyte of one character is one piece, not a million.

Before that, a task compares the pieces of frequent tokens in its batch among themselves and remembers those it has
sent, so a passage that very many documents share arrives about once from each task.

Nulls: a null text is empty; a document with a null id neither loses bytes nor takes any from others. Rows that repeat an id are one document: they
never take bytes from each other, each is reported. Texts shorter than WIDTH bytes lose nothing; very long
ones are read whole, by the task of their part. An empty table gives an empty result. Other columns of the input are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import arrow_rows, documents, materialize, release, text_or_empty

WIDTH, TOKEN = 50, 8
SIDE = (WIDTH - TOKEN) // 2
#: Bytes of text sampled for splitters and token frequencies, at most; bytes of text for each bucket, and for each part of the documents; bytes handled at once; pieces a task holds before it packs them.
SAMPLE_BYTES, BUCKET_BYTES, PART_BYTES, BATCH_BYTES, HELD_PIECES = 8_000_000, 1_000_000, 4_000_000, 1_000_000, 400_000
#: Suffixes drawn for each splitter, and at most; pieces sorted at once; passages of frequent tokens a task remembers.
DRAWN, MOST_DRAWN, SORTED, REMEMBERED = 8, 2_000_000, 50_000, 40_000
#: Longest period of a stretch whose windows are looked at once; with the two times that WIDTH holds, stretches of two periods never share a window.
PERIODS, PROBE = 16, WIDTH // 2
#: Bytes of text of a bucket above which, where MOST_DRAWN leaves no more splitters, its tokens are dealt into shares by a hash.
CROWDED = 64_000_000
#: Classes of token frequency; slots of the frequency table.
CLASSES, SLOTS = 4, 1 << 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def words_at(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from every position as a big-endian number (so numbers sort like bytes)."""
    return np.ndarray((max(len(data) - TOKEN + 1, 0),), ">u8", data.tobytes(), strides=(1,))


def mixed(tokens: np.ndarray) -> np.ndarray:
    h = tokens.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def slots_of(data: np.ndarray) -> np.ndarray:
    """How often a document has each token slot: 0 or 1."""
    found = np.zeros(SLOTS, np.int64)
    found[(mixed(words_at(data)) & np.uint64(SLOTS - 1)).astype(np.int64)] = 1
    return found


def order_of(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Place of each token in the fixed order: frequency class first, then a mixing of its bytes."""
    h = mixed(tokens)
    return (classes[(h & np.uint64(SLOTS - 1)).astype(np.int64)] << np.uint64(61)) | (h >> np.uint64(3))


def leading(order: np.ndarray, span: int) -> np.ndarray:
    """Position of the first smallest of every span neighbours, by doubling."""
    out, at, have = order, np.arange(len(order), dtype=np.int32), 1
    while have < span:
        step = min(have, span - have)
        less = out[step:] < out[:-step]
        out, at = np.where(less, out[step:], out[:-step]), np.where(less, at[step:], at[:-step])
        have += step
    return at


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.full(size, c, np.uint64)) for c in (int(M1), pow(int(M1), -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def multikey(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of byte strings of equal width (a multiple of eight): their order, and how many first bytes
    each has in common with the one before it in that order.

    Multikey quicksort, eight bytes at a time: a pass looks at one digit of the groups that agree so far, orders each
    group by it and divides the group; strings that stand alone are not looked at again.
    """
    n, width = rows.shape
    digits = rows.view(">u8")
    first = digits[:, 0].astype(np.uint64)
    order = np.argsort(first)
    new = np.ones(n, bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    for k in range(1, width // TOKEN):
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        digit, group = digits[order[at], k].astype(np.uint64), np.cumsum(new)[at]
        by = np.lexsort((digit, group))
        order[at], digit = order[at][by], digit[by]
        new[at[1:]] |= digit[1:] != digit[:-1]
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), width)
    return order, np.concatenate([[0], common])


def _contexts(data: np.ndarray, token: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each piece from its leading token on, and those before it read backwards; zeros beyond the piece."""
    view = np.lib.stride_tricks.sliding_window_view
    right = view(np.concatenate([data, np.zeros(56, np.uint8)]), 56)[token]
    right[np.arange(56) >= np.minimum(first + n - 1 + WIDTH - token, WIDTH)[:, None]] = 0
    left = view(np.concatenate([np.zeros(48, np.uint8), data]), 48)[token][:, ::-1].copy()
    left[np.arange(48) >= (token - first)[:, None]] = 0
    return right, left


def _equal_windows(right: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """[piece, bytes of the window before the token]: whether a smaller document has an equal window. least, most:
    the fewest and most bytes before the token among each piece's windows."""
    hit = np.zeros((len(doc), WIDTH - TOKEN + 1), bool)
    (r_order, r_common), (l_order, l_common) = multikey(right), multikey(left)
    r_group, l_group = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    for before in range(int(least.min()), int(most.max()) + 1):
        r_group[r_order] = np.cumsum(r_common < WIDTH - before)
        own = np.flatnonzero((least <= before) & (before <= most))
        own = own[np.bincount(r_group[own])[r_group[own]] > 1]
        if not len(own):
            continue
        l_group[l_order] = np.cumsum(l_common < before)
        key = r_group[own] * (len(doc) + 1) + l_group[own]
        order = np.argsort(key)
        key, docs = key[order], doc[own[order]]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(docs, start), np.diff(np.append(start, len(key))))
        hit[own[order], before] = docs > smallest
    return hit


def later_copies(data: np.ndarray, token: np.ndarray, first: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, number) of the runs of windows that a document with a smaller id holds as well, by piece.

    token, first, n, doc: place of each piece's leading token, its first window, its windows, its document."""
    value = words_at(data)[token].astype(np.uint64)
    order = np.argsort(value)
    start = np.flatnonzero(np.concatenate([[True], value[order[1:]] != value[order[:-1]]])) if len(order) else np.zeros(0, int)
    size = np.diff(np.append(start, len(order)))
    if len(order):  # tokens of one document lead no equal windows of two
        docs = doc[order]
        shared = np.minimum.reduceat(docs, start) != np.maximum.reduceat(docs, start)
        order, size = order[np.repeat(shared, size)], size[shared]
    pieces, windows, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends, at = np.cumsum(size), 0
    while at < len(order):  # whole tokens together
        end = int(ends[max(np.searchsorted(ends, at + SORTED, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        own = order[at:end]
        at = end
        p, f, k = token[own], first[own], n[own]
        hit = _equal_windows(*_contexts(data, p, f, k), p - f - k + 1, p - f, doc[own])
        edge = np.diff(np.pad(hit[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, begin), stop = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
        pieces.append(own[row])
        windows.append(p[row] - (WIDTH - TOKEN) + begin)
        counts.append(stop - begin)
    piece, window, count = (np.concatenate(x) for x in (pieces, windows, counts))
    by = np.argsort(piece, kind="stable")
    return piece[by], window[by], count[by]


def runs_of(lead: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number) of runs of windows that share their leading token; windows that are not ok are left out."""
    edge = np.ones(len(lead), bool)
    edge[1:] = (lead[1:] != lead[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(edge)
    n = np.diff(np.append(first, len(lead)))
    keep = ok[first]
    return first[keep], n[keep]


def stretches(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(begin, end, period) of the longest stretches, within documents that end at ends, that hold more than their first
    period windows: those of period 1 first, and none twice. Three bytes in every PROBE say whether a period is worth a look."""
    found: list[tuple[int, int, int]] = []
    begins = np.concatenate([[0], ends[:-1]])
    for p in range(1, PERIODS + 1):
        i = np.arange(p, len(data) - 16, PROBE)
        same = [data[at + p :: PROBE][: len(i)] == data[at::PROBE][: len(i)] for at in (0, 8, 16)]
        hits = np.flatnonzero(same[0] & same[1] & same[2])
        own: list[tuple[int, int, int]] = []
        for chain in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1) if len(hits) else ():
            lo, hi = max(0, int(i[chain[0]]) - PROBE - p), min(len(data), int(i[chain[-1]]) + 17 + PROBE)
            edge = np.diff(np.concatenate([[0], (data[lo + p : hi] == data[lo : hi - p]).astype(np.int8), [0]]))
            start, stop = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo + p
            long = stop - start >= WIDTH + p
            for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
                for d in range(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(begins, b, side="left"))):
                    x, y = max(a, int(begins[d])), min(b, int(ends[d]))
                    if y - x >= WIDTH + p and not any(u <= x and y <= v for u, v, q in found if p % q == 0):
                        own.append((x, y, p))
        found += own
    return np.array(found, np.int64).reshape(-1, 3)


def spread(spans: list[tuple[int, int]], own: np.ndarray) -> list[tuple[int, int]]:
    """The removed bytes (start, end) of a document, with those of its stretches' further windows."""
    if not spans or not len(own):
        return spans
    start, end = np.array(sorted(spans), np.int64).T
    last = np.maximum.accumulate(end - WIDTH)  # the last window of each that is gone
    more = []
    for a, b, p in own.tolist():
        first = np.arange(a, a + p)
        at = np.searchsorted(start, first, side="right") - 1
        gone = first[(at >= 0) & (last[at] >= first)]
        more += [(int(x), int(x + (b - WIDTH - x) // p * p + WIDTH)) for x in gone]
    return spans + more


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which hash_at gives the hash of any range of bytes."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])
    return sums, down


def hash_at(roll: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (roll[0][end] - roll[0][start]) * roll[1][start]


def sides(roll: tuple, token: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each piece's token with SIDE bytes before it, and after it; 0 where none of its windows holds
    those bytes. Windows with SIDE bytes before the token hold the first, all others the second."""
    out = []
    for on, start, end in ((first <= token - SIDE, token - SIDE, token + TOKEN), (first + n - 1 > token - SIDE, token, token + TOKEN + SIDE)):
        h = np.zeros(len(token), np.uint32)
        some = np.flatnonzero(on)
        h[some] = ((hash_at(roll, start[some], end[some]) * M2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        out.append(h)
    return out[0], out[1]


class Plan:
    """Broadcast, of bounded size: frequency class of token slots, and the splitters: their first tokens, and the
    tokens after those (0 but for tokens that several splitters begin with)."""

    def __init__(self, classes: np.ndarray, drawn: np.ndarray, total: int):
        """drawn: (token, next token) of the suffixes drawn, in byte order, DRAWN for each splitter; total: bytes of text."""
        self.classes = classes
        first, second = drawn[DRAWN::DRAWN].T if len(drawn) > DRAWN else (np.zeros(0, np.uint64),) * 2
        often = np.concatenate([first[1:] == first[:-1], [False]]) | np.concatenate([[False], first[1:] == first[:-1]]) if len(first) else np.zeros(0, bool)
        both = np.unique(np.stack([first, np.where(often, second, np.uint64(0))], axis=1), axis=0)
        self.first, self.second = both[:, 0].copy(), both[:, 1].copy()
        self.deep = np.unique(self.first[1:][self.first[1:] == self.first[:-1]])
        self.shares = max(1, -(-total // (CROWDED * (len(self.first) + 1))))

    def bucket(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many splitters are not behind the suffixes that begin with these two tokens."""
        out = np.searchsorted(self.first, first, side="right")
        some = np.flatnonzero(np.isin(first, self.deep)) if len(self.deep) else []
        for token in np.unique(first[some]) if len(some) else ():
            begin, end = np.searchsorted(self.first, token, side="left"), np.searchsorted(self.first, token, side="right")
            own = some[first[some] == token]
            out[own] = begin + np.searchsorted(self.second[begin:end], second[own], side="right")
        return out

    def placed(self, token: np.ndarray, value: np.ndarray, after: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(piece, first window, number, bucket) of pieces, cut where their windows belong to several buckets.

        A window that holds the second token goes with its suffix. One that holds k bytes of it, k under eight, is
        equal to windows of all suffixes with these k bytes, on whichever side of a splitter; it goes to the bucket
        of the smallest of them."""
        bucket = self.bucket(value, after)
        whole = np.ones(len(token), bool)
        short = token - at > WIDTH - 2 * TOKEN
        if len(self.deep):
            whole = ~short | (bucket == self.bucket(value, np.zeros_like(after)))
        keep, cut = np.flatnonzero(whole), np.flatnonzero(~whole)
        out = [(keep, at[keep], n[keep], bucket[keep])]
        if len(cut):
            most, least = (token - at)[cut], (token - at - n + 1)[cut]
            long = cut[least <= WIDTH - 2 * TOKEN]
            begin = token[long] - (WIDTH - 2 * TOKEN)
            out.append((long, begin, at[long] + n[long] - begin, bucket[long]))
            for before in range(WIDTH - 2 * TOKEN + 1, WIDTH - TOKEN + 1):
                own = cut[(least <= before) & (before <= most)]
                known = WIDTH - before - TOKEN  # bytes of the second token within the window
                mask = np.uint64(((1 << 64) - 1) ^ ((1 << (8 * (TOKEN - known))) - 1))
                out.append((own, token[own] - before, np.ones(len(own), np.int64), self.bucket(value[own], after[own] & mask)))
        piece, begin, count, bucket = (np.concatenate(x) for x in zip(*out, strict=True))
        if self.shares > 1:
            bucket = bucket * self.shares + (mixed(value[piece]) % np.uint64(self.shares)).astype(np.int64)
        if len(cut):
            by = np.lexsort((begin, piece))
            return piece[by], begin[by], count[by], bucket[by]
        return piece, begin, count, bucket


def make_plan(texts: DataFrame, total: int) -> Plan:
    """From a sample of whole documents, chosen by hash, of at most about SAMPLE_BYTES; results don't depend on it."""
    asked = min(MOST_DRAWN, DRAWN * max(1, -(-total // BUCKET_BYTES)))
    share = min(1.0, max(SAMPLE_BYTES, 22 * asked) / max(total, 1))
    chosen = texts.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("text")

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) >= WIDTH:
                    slots += slots_of(data)
        yield pd.DataFrame({"slot": np.flatnonzero(slots), "n": slots[np.flatnonzero(slots)]})

    counted = chosen.mapInPandas(sample, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most SLOTS rows
    n = np.zeros(SLOTS, np.int64)
    for r in counted:
        n[r["slot"]] = r["n"]
    typical = max(float(np.median(n)), 1.0)
    classes = np.select([n <= 4 * typical, n <= 16 * typical, n <= 64 * typical], [0, 1, 2], 3).astype(np.uint64)
    # about one suffix for every 22 bytes of the sample
    every = max(1, int(total * share / 22 / asked))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every so many suffixes of the sample, packed."""
        skip = 0
        for batch in batches:
            found = [np.zeros((0, 2), np.uint64)]
            for text in batch["text"]:
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) >= WIDTH:
                    lead = np.unique(leading(order_of(words_at(data), classes), WIDTH - TOKEN + 1))
                    own = lead[skip % every :: every]
                    skip -= len(lead)
                    tokens = words_at(np.concatenate([data, np.zeros(TOKEN, np.uint8)]))
                    found.append(np.stack([tokens[own], tokens[own + TOKEN]], axis=1).astype(np.uint64))
            yield pd.DataFrame({"drawn": [np.concatenate(found).tobytes()]})

    rows = chosen.mapInPandas(draw, "drawn binary").collect() if asked > DRAWN else []  # about MOST_DRAWN suffixes at most, 16 bytes each
    drawn = np.frombuffer(b"".join(bytes(r["drawn"]) for r in rows), np.uint64).reshape(-1, 2)
    return Plan(classes, drawn[np.lexsort((drawn[:, 1], drawn[:, 0]))], total)


def _pack(**columns: np.ndarray) -> bytes:
    head = ",".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in columns.items()).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + b"".join(v.tobytes() for v in columns.values()))


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for part in raw[4:at].decode().split(","):
        k, kind, n = part.split(":")
        out[k] = np.frombuffer(raw, kind, int(n), at)
        at += out[k].nbytes
    return out


def _spans(doc: np.ndarray, th: np.ndarray, part: np.ndarray, begin: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, packed doc, th, start, end) of removed bytes, for each part of the documents."""
    if not len(doc):
        return
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts):
        yield int(part[own[0]]), _pack(doc=doc[own], th=th[own], start=begin[own].astype(np.int32), end=(begin[own] + n[own] + WIDTH - 1).astype(np.int32))


class Sent:
    """What a task has sent on: the smallest document of whole texts (by a 128-bit digest) and of passages of frequent
    tokens (by their bytes); bounded, as forgetting only sends more."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def before(self, key: bytes, doc: int) -> bool:
        """Whether a smaller document sent it on; else this one is remembered."""
        least = self.known.get(key)
        if least is not None and least < doc:
            return True
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[key] = doc
        return False


def _first_pass(batch: list[tuple], plan: Plan, sent: Sent) -> Iterator[tuple[int, int, object]]:
    """(kind, number, found) of some documents (doc_id, th, part, text bytes): kind 0, pieces for bucket number;
    kind 1, packed spans for part number."""
    doc, th, part, raw = zip(*batch, strict=True)
    doc, th, part = np.array(doc, np.int64), np.array(th, np.int64), np.array(part, np.int32)
    # exact copies: all but the smallest id go whole
    best: dict[bytes, int] = {}
    for i in sorted(range(len(raw)), key=lambda i: doc[i]):
        best.setdefault(raw[i], i)
    first = np.array([best[r] for r in raw])
    size = np.array([len(r) for r in raw])
    copy = doc[first] < doc
    for i in np.flatnonzero((first == np.arange(len(raw))) & (size >= WIDTH)):
        copy[i] = sent.before(hashlib.blake2b(raw[i], digest_size=16).digest(), int(doc[i]))
    copy |= copy[first]
    gone = np.flatnonzero(copy & (size >= WIDTH))
    yield from ((1, p, b) for p, b in _spans(doc[gone], th[gone], part[gone], np.zeros(len(gone), np.int64), size[gone] - WIDTH + 1))
    stay = np.flatnonzero(~copy & (size >= WIDTH))
    if not len(stay):
        return
    data = np.frombuffer(b"".join([*(raw[i] for i in stay), bytes(TOKEN)]), np.uint8)
    ends = np.cumsum(size[stay])
    begins = ends - size[stay]
    tokens = words_at(data)  # one for each byte, and one more
    order = order_of(tokens[:-TOKEN], plan.classes)
    lead = leading(order, WIDTH - TOKEN + 1)
    ok = np.ones(len(lead), bool)
    for e in ends[:-1].tolist():  # windows that would cross into the next document
        ok[max(0, e - WIDTH + 1) : e] = False
    for a, b, p in stretches(data[:-TOKEN], ends).tolist():
        ok[a + p : b - WIDTH + 1] = False
    # pieces of frequent tokens: compared within the batch, so that each goes on once
    at, n = runs_of(lead, ok)
    token = lead[at].astype(np.int64)
    some = np.flatnonzero(order[token] >= np.uint64(1 << 61))
    if len(some):
        owner = np.searchsorted(ends, at[some], side="right")
        piece, begin, count = later_copies(data, token[some], at[some], n[some], doc[stay][owner])
        hit = np.zeros(len(lead) + 1, np.int8)
        np.add.at(hit, begin, 1)
        np.add.at(hit, begin + count, -1)
        hit = np.cumsum(hit[:-1]).astype(bool)
        # and those that the task has sent on
        a, k = runs_of(lead, ok & ~hit & (order[lead] >= np.uint64(1 << 61)))
        own = np.searchsorted(ends, a, side="right")
        for b, m, i in zip(a.tolist(), k.tolist(), doc[stay][own].tolist()):
            if sent.before(data[b : b + m + WIDTH - 1].tobytes(), i):
                hit[b : b + m] = True
        # a run of hits doesn't cross documents, as windows that do are not ok
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        b, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        own = np.searchsorted(ends, b, side="right")
        i = stay[own]
        yield from ((1, p, x) for p, x in _spans(doc[i], th[i], part[i], b - begins[own], e - b))
        at, n = runs_of(lead, ok & ~hit)
        token = lead[at].astype(np.int64)
    piece, at, n, bucket = plan.placed(token, tokens[token].astype(np.uint64), tokens[token + TOKEN].astype(np.uint64), at, n)
    token = token[piece]
    before, after = sides(rolling(data), token, at, n)
    owner = np.searchsorted(ends, at, side="right")
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    for own in np.split(by, cuts):
        if len(own):
            i = stay[owner[own]]
            yield 0, int(bucket[own[0]]), (doc[i], th[i], part[i], at[own] - begins[owner[own]], n[own], (token - at)[own], before[own], after[own])


def _turned(x: np.ndarray) -> np.ndarray:
    """Small numbers as byte planes, which compress well."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).reshape(-1)


def _back(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(4, -1).T).reshape(-1).view("<i4").astype(np.int64)


def _pieces_blob(doc: np.ndarray, th: np.ndarray, part: np.ndarray, begin: np.ndarray, n: np.ndarray, lead: np.ndarray, **more: np.ndarray) -> bytes:
    """Pieces, packed: their documents once, then small numbers, then more columns as they are. begin: first window;
    n: windows; lead: bytes of the first window before the leading token."""
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    step = np.where(first, begin, np.diff(begin, prepend=0))
    return _pack(doc=doc[first], th=th[first], part=part[first], first=np.packbits(first), step=_turned(step), n=n.astype(np.uint8), lead=lead.astype(np.uint8), **more)


def _read_pieces(raw: bytes) -> dict[str, np.ndarray]:
    c = _unpack(raw)
    step, n = _back(c.pop("step")), c.pop("n").astype(np.int64)
    first = np.unpackbits(c.pop("first"), count=len(n)).astype(bool)
    at = np.cumsum(first) - 1
    sums = np.cumsum(step)
    begin = sums - (sums[first] - step[first])[at]
    return c | {"doc": c["doc"][at], "th": c["th"][at], "part": c["part"][at], "begin": begin, "n": n}


def _by_part(c: dict[str, np.ndarray], keep: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, packed pieces) of the pieces to keep, for each part of the documents."""
    own = np.flatnonzero(keep)
    own = own[np.lexsort((c["begin"][own], c["th"][own], c["doc"][own], c["part"][own]))]
    cuts = np.flatnonzero(np.diff(c["part"][own])) + 1
    for i in np.split(own, cuts):
        if len(i):
            yield int(c["part"][i[0]]), _pieces_blob(*(c[k][i] for k in ("doc", "th", "part", "begin", "n", "lead")))


def packed_runs(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """(key, packed values) of each run of rows with one key; only the run at hand is held."""
    now, held = None, []
    for batch in batches:
        for *own, packed in zip(*(batch[k] for k in key), batch["packed"], strict=True):
            if own != now:
                if held:
                    yield tuple(map(int, now)), held
                now, held = own, []
            held.append(packed)
    if held:
        yield tuple(map(int, now)), held


def _alive(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(part, packed pieces) of one bucket's pieces that may hold a window of another document."""
    parts = [_read_pieces(b) for b in blobs]
    c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    keep = np.zeros(len(c["doc"]), bool)
    for side in ("before", "after"):
        some = np.flatnonzero(c[side])
        if not len(some):
            continue
        some = some[np.argsort(c[side][some])]
        h, doc = c[side][some], c["doc"][some]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        differ = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        keep[some] |= np.repeat(differ, np.diff(np.append(start, len(h))))
    yield from _by_part(c, keep)


def _with_text(docs: pd.DataFrame, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed pieces with text) for one part's documents; asked: (bucket, packed pieces)."""
    raw = {(d, t): x.encode("utf-8", "surrogatepass") for d, t, x in zip(docs["doc_id"], docs["th"], docs["text"], strict=True) if not pd.isna(d)}
    for bucket, blob in asked:
        c = _read_pieces(blob)
        text = b"".join([raw[d, t][b : b + n + WIDTH - 1] for d, t, b, n in zip(*(c[k].tolist() for k in ("doc", "th", "begin", "n")), strict=True)])
        yield bucket, _pieces_blob(*(c[k] for k in ("doc", "th", "part", "begin", "n", "lead")), bytes=np.frombuffer(text, np.uint8))


def _search_bucket(blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Spans that the pieces of one bucket lose to documents with smaller ids."""
    parts = [_read_pieces(b) for b in blobs]
    c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    del parts
    sizes = c["n"] + WIDTH - 1
    at = np.cumsum(sizes) - sizes
    piece, window, count = later_copies(c["bytes"], at + c["lead"], at, c["n"], c["doc"])
    yield from _spans(c["doc"][piece], c["th"][piece], c["part"][piece], c["begin"][piece] + window - at[piece], count)


def _finish(docs: pd.DataFrame, spans: list[bytes]) -> pd.DataFrame:
    """The result rows of one part's documents."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for raw in spans:
        c = _unpack(raw)
        for d, t, s, e in zip(*(c[k].tolist() for k in ("doc", "th", "start", "end"))):
            found.setdefault((d, t), []).append((s, e))
    rows = []
    texts = [t.encode("utf-8", "surrogatepass") for t in docs["text"]]
    ends = np.cumsum([len(t) for t in texts])
    far = stretches(np.frombuffer(b"".join(texts), np.uint8), ends) if found else np.zeros((0, 3), np.int64)
    owner = np.searchsorted(ends, far[:, 0], side="right")
    for i, (doc_id, th, data) in enumerate(zip(docs["doc_id"], docs["th"], texts, strict=True)):
        kept, at, removed, count, end = hashlib.sha256(), 0, 0, 0, -1
        own = far[owner == i] - [[int(ends[i]) - len(data)] * 2 + [0]] if len(far) else far
        for s, e in sorted(spread(found.get((doc_id, th), []), own) if not pd.isna(doc_id) else ()):
            if s > end:  # a gap: the run before ends here
                kept.update(data[at:s])
                count += 1
                removed += e - s
                at = end = e
            elif e > end:
                removed += e - end
                at = end = e
        kept.update(data[at:])
        rows.append((doc_id, len(data), removed, count, kept.hexdigest()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"))


def removed_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // PART_BYTES))
    plan = spark.sparkContext.broadcast(make_plan(rows, total))
    texts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "th"), F.lit(parts)).cast("int"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, size, held, weight, sent = [], 0, {}, 0, Sent()

        def take() -> Iterator[tuple[int, int, bytes]]:
            """Spans at once; pieces wait until a task has enough of them to pack well."""
            nonlocal weight
            for kind, number, found in _first_pass(docs, plan.value, sent):
                if kind == 1:
                    yield kind, number, found
                else:
                    held.setdefault(number, []).append(found)
                    weight += len(found[0])

        def flush() -> Iterator[tuple[int, int, bytes]]:
            nonlocal weight
            for number in sorted(held):
                *columns, before, after = (np.concatenate(x) for x in zip(*held.pop(number), strict=True))
                yield 0, number, _pieces_blob(*columns, before=before, after=after)
            weight = 0

        frame = lambda rows: pd.DataFrame(list(rows), columns=["kind", "number", "packed"])
        for batch in batches:
            for doc_id, th, part, text in zip(*(batch[c] for c in ("doc_id", "th", "part", "text")), strict=True):
                if pd.isna(doc_id):
                    continue
                raw = text.encode("utf-8", "surrogatepass")
                docs.append((int(doc_id), th, part, raw))
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield frame(take())
                    docs, size = [], 0
                    if weight >= HELD_PIECES:
                        yield frame(flush())
        if docs:
            yield frame(take())
            docs = []
        yield frame(flush())
        sent.known.clear()
        _POWERS.clear()
        release()

    def alive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (kind, number), blobs in packed_runs(batches, ["kind", "number"]):
            out = ((0, p, number, x) for p, x in _alive(blobs)) if kind == 0 else ((1, number, 0, x) for x in blobs)
            yield pd.DataFrame(list(out), columns=["kind", "part", "bucket", "packed"])
        release()

    def with_text(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(list(_with_text(docs, list(zip(asked["bucket"], asked["packed"], strict=True)))), columns=["bucket", "packed"])
        release()
        return found

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, blobs in packed_runs(batches, ["bucket"]):
            yield pd.DataFrame(list(_search_bucket(blobs)), columns=["part", "packed"])
        release()

    def finish(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = _finish(docs, found["packed"].tolist())
        release()
        return out

    with arrow_rows(spark, 200):  # rows are texts or packed arrays
        packed = texts.mapInPandas(first, "kind int, number int, packed binary").repartition("kind", "number").sortWithinPartitions("kind", "number")
        staged = materialize(packed.mapInPandas(alive, "kind int, part int, bucket int, packed binary"), "suffix-pieces")
    dealt = texts.groupBy("part")
    pieces = dealt.cogroup(staged.where("kind = 0").groupBy("part")).applyInPandas(with_text, "bucket int, packed binary")
    spans = pieces.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(search, "part int, packed binary").unionByName(staged.where("kind = 1").select("part", "packed"))
    return dealt.cogroup(spans.groupBy("part")).applyInPandas(finish, SCHEMA)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(documents(spark, sf_dir).select("doc_id", "text"))
