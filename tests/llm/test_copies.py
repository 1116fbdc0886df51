from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from pulsegrid.llm import neardup, piecewise, suffixes

DICE = random.Random(11)
WORDS = ["".join(DICE.choice("abcdeé") for _ in range(DICE.randint(1, 7))) for _ in range(400)]
LINE = " ".join(WORDS[:25])


def text(n: int) -> str:
    return " ".join(DICE.choice(WORDS) for _ in range(n))


def edited(t: str, n: int) -> str:
    words = t.split(" ")
    for _ in range(n):
        words[DICE.randrange(len(words))] = DICE.choice(WORDS)
    return " ".join(words)


def corpus() -> list[tuple]:
    base = [text(DICE.randint(1, 200)) for _ in range(40)]
    near = [edited(base[i % 8], DICE.randint(0, 12)) for i in range(160)]
    lines = [f"{text(20)}\n{LINE}\n{text(20)}" for _ in range(30)]
    short = ["a b c", "a b c d", "A B\tC", "a", "", None, "a b", "b a", " \n", "x" * 49, "x" * 50, "ab" * 200, "Ä" * 60]
    texts = base + near + lines + short
    DICE.shuffle(texts)
    rows = [(3 * i, t, "p", "t") for i, t in enumerate(texts)]
    return rows + rows[:3] + [(None, base[0], "p", "t"), (1, LINE * 3, "p", "t")]


ROWS = corpus()


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, part string, th string").repartition(3)


def brute_groups(rows, size, threshold):
    """(doc_id, shingles, component id, kept) of each row; every row is a node."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and threshold[1] * n >= threshold[0] * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return Counter((r[0], len(sets[i]), least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows))


def near(rows, size, threshold):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(rows, size, threshold).collect())


#: Near copies with null ids, ids that unlike texts share, groups of null ids alone.
LONG = text(120)
ODD = [(None, edited(LONG, 1), "p", "t"), (None, edited(LONG, 2), "p", "t"), (7001, LONG, "p", "t"), (7001, text(60), "p", "t"), (7000, LONG, "p", "t"), (7001, LONG, "p", "t"),
       (None, WORDS[0] + " only nulls here", "p", "t"), (None, WORDS[0] + " ONLY nulls here", "p", "t"), (None, "", "p", "t"), (None, None, "p", "t")]


def test_near_duplicates_equal_brute_force(spark):
    rows = ROWS + ODD
    for size, threshold in ((3, (85, 100)), (5, (8, 10))):
        frame = spark.createDataFrame(rows, "doc_id long, text string, part string, th string").repartition(3)
        assert near(frame, size, threshold) == brute_groups(rows, size, threshold)


def test_leaders_are_one_row_of_each_group(spark):
    rows = ROWS + ODD
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, part string, th string"), 3, (85, 100)).collect()
    by: dict = defaultdict(set)
    for r in found:
        if r["leader"] and r["n_shingles"]:
            by[r["component_id"]].add((r["doc_id"], r["text_key"]))
    assert by and all(len(v) == 1 for k, v in by.items() if k is not None and k != 7001)
    assert len(by[7000]) == 1 and len(by[7001]) == 1
    assert all(r["leader"] for r in found if not r["n_shingles"])


def test_blocks_and_failed_pairs_change_nothing(spark, monkeypatch):
    """Buckets of several blocks: each block alone, then members outside the largest component against all."""
    whole = near(docs(spark), 3, (85, 100))
    crossed = []
    across = neardup._across
    monkeypatch.setattr(neardup, "_across", lambda m: crossed.append(1) or across(m))
    for block in (8, 2):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert near(docs(spark), 3, (85, 100)) == whole
    assert crossed


def test_sketches_never_rule_out_a_link():
    memo, dice = neardup.Words(), random.Random(2)
    for _ in range(50):
        a = text(dice.randint(3, 300))
        x, y = (neardup.shingles(t, 3, memo) for t in (a, edited(a, dice.randint(0, 5))))
        apart = np.bitwise_count(np.frombuffer(neardup.parity(x), np.uint8) ^ np.frombuffer(neardup.parity(y), np.uint8)).sum()
        assert apart <= len(np.setxor1d(x, y))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a long, b long")
    assert {(r["id"], r["comp"]) for r in neardup.components(links).collect()} == {(i, 0) for i in range(101)} | {(200, 200), (201, 200)}


def brute_suffixes(rows=None) -> list[tuple]:
    least: dict = {}
    raw = [(r[0], (r[1] or "").encode()) for r in (ROWS if rows is None else rows)]
    for i, t in raw:
        for k in range(len(t) - 49) if i is not None else ():
            w = t[k : k + 50]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t in raw:
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - 49) if i is not None else ():
            if least[t[k : k + 50]] < i:
                hit[k : k + 50] = True
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
        out.append((i, len(t), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    want = Counter(brute_suffixes())
    assert sum(r[2] for r in want) > 1000
    assert Counter(map(tuple, suffixes.removed_repeats(docs(spark)).collect())) == want
    for name, value in (("BUCKET_BYTES", 1500), ("PART_BYTES", 9000), ("BATCH_BYTES", 5000), ("HELD_PIECES", 500), ("SAMPLE_BYTES", 30_000), ("SORTED", 60), ("REMEMBERED", 30), ("CROWDED", 2_000)):
        monkeypatch.setattr(suffixes, name, value)
    assert Counter(map(tuple, suffixes.removed_repeats(docs(spark)).collect())) == want


def test_multikey_quicksort_and_common_lengths():
    dice = np.random.default_rng(4)
    rows = dice.integers(97, 99, (500, 56)).astype(np.uint8)
    rows[100:200, :30] = rows[0, :30]
    rows[300:310] = rows[299]
    order, common = suffixes.multikey(rows)
    texts = [r.tobytes() for r in rows]
    assert [texts[i] for i in order] == sorted(texts)
    for k in range(1, len(rows)):
        a, b = texts[order[k - 1]], texts[order[k]]
        assert common[k] == next((i for i in range(56) if a[i] != b[i]), 56)


def pieces_of(raw: bytes) -> tuple:
    data = np.frombuffer(raw, np.uint8)
    order = suffixes.order_of(suffixes.words_at(data), np.zeros(suffixes.SLOTS, np.uint64))
    lead = suffixes.leading(order, suffixes.WIDTH - suffixes.TOKEN + 1)
    at, n = suffixes.runs_of(lead, np.ones(len(lead), bool))
    return data, lead[at].astype(np.int64), at, n


def test_equal_windows_meet_across_the_boundaries_of_buckets(monkeypatch):
    """Windows that end within the second token, whose suffixes go on differently: some lie on both sides of a
    splitter within that token, and meet in one bucket all the same."""
    monkeypatch.setattr(suffixes, "DRAWN", 1)
    dice, moved = random.Random(8), 0
    for _ in range(12):
        passage = bytes(dice.choice(b"abcdefgh") for _ in range(60))
        raws = [bytes(dice.choice(b"xyz") for _ in range(30)) + passage + bytes(dice.choice(b"ijklmn") for _ in range(40)) for _ in range(40)]
        found = [pieces_of(r) for r in raws]
        drawn = np.array(sorted((int(v), int(w)) for data, token, _, _ in found for t in [suffixes.words_at(np.concatenate([data, np.zeros(8, np.uint8)]))] for v, w in zip(t[token], t[token + 8])), np.uint64)
        plan = suffixes.Plan(np.zeros(suffixes.SLOTS, np.uint64), drawn, 1)
        assert len(plan.deep)
        place: dict = defaultdict(set)
        for data, token, at, n in found:
            t = suffixes.words_at(np.concatenate([data, np.zeros(8, np.uint8)]))
            value, after = t[token].astype(np.uint64), t[token + 8].astype(np.uint64)
            own = plan.bucket(value, after)
            piece, begin, count, bucket = plan.placed(token, value, after, at, n)
            assert sorted(w for b, k in zip(begin.tolist(), count.tolist()) for w in range(b, b + k)) == list(range(len(data) - 49))
            moved += int((bucket != own[piece]).sum())
            for b, k, x in zip(begin.tolist(), count.tolist(), bucket.tolist()):
                for w in range(b, b + k):
                    place[data[w : w + 50].tobytes()].add(x)
        assert all(len(x) == 1 for x in place.values())
    assert moved > 0


def test_later_copies_in_chunks_of_tokens(monkeypatch):
    dice = random.Random(3)
    common = bytes(dice.choice(b"abc") for _ in range(200))
    raws = [bytes(dice.choice(b"abc") for _ in range(60)) + common[dice.randrange(100) : 100 + dice.randrange(100)] for _ in range(50)]
    data, token, at, n, doc, base = [], [], [], [], [], 0
    for i, r in enumerate(raws):
        if len(r) >= 50:
            _, p, a, k = pieces_of(r)
            token.append(p + base), at.append(a + base), n.append(k), doc.append(np.full(len(p), i))
        data.append(r)
        base += len(r)
    whole = np.frombuffer(b"".join(data), np.uint8)
    token, at, n, doc = (np.concatenate(x) for x in (token, at, n, doc))
    least: dict = {}
    for a, k, d in zip(at, n, doc):
        for w in range(a, a + k):
            key = whole[w : w + 50].tobytes()
            least[key] = min(d, least.get(key, d))
    want = {w for a, k, d in zip(at, n, doc) for w in range(a, a + k) if least[whole[w : w + 50].tobytes()] < d}
    assert want
    for size in (10, 100_000):
        monkeypatch.setattr(suffixes, "SORTED", size)
        _, begin, count = suffixes.later_copies(whole, token, at, n, doc)
        assert {w for b, c in zip(begin.tolist(), count.tolist()) for w in range(b, b + c)} == want and count.sum() == len(want)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fingerprints_of_documents_and_edits(spark):
    rows = sorted({(r[0], r[1] or "") for r in ROWS if r[0] is not None}, key=lambda r: (-r[0], r[1]))  # no id has two texts here
    got = {(r["doc_id"], r["n_chars"]): r for r in piecewise.fingerprints(docs(spark).where("doc_id is not null").dropDuplicates(["doc_id", "text"])).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        new = piecewise.edited(t, rows[(k + 1) % len(rows)][1])
        r = got[i, len(t)]
        assert (r["fingerprint"], r["edited_sha256"], r["edited_fingerprint"]) == (piecewise.fingerprint(t.encode()), hashlib.sha256(new.encode()).hexdigest(), piecewise.fingerprint(new.encode()))
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1


def plain_fingerprint(data: bytes) -> str:
    """Byte by byte: a window of seven bytes as a number ends chunks; a chunk's digit is a polynomial of its bytes."""
    a, b, all_ = int(piecewise.A), int(piecewise.B), (1 << 64) - 1
    mix = lambda x: (lambda y: y ^ y >> 29)(((lambda z: z ^ z >> 32)(x * a & all_)) * b & all_)
    if not data:
        return "1::"
    ones, window = [], 0
    for byte in data:
        window = (window >> 8) | byte << 48
        h, k = mix(window), 0
        while h >> k & 1:
            k += 1
        ones.append(k)
    level = next(k for k in range(100) if sum(x >= k for x in ones) <= 64)
    out = [str(1 << level)]
    for k in (level, level + 1):
        chunks, now = [], []
        for i, byte in enumerate(data):
            now.append(byte)
            if (ones[i] >= k and len(chunks) < 63) or i == len(data) - 1:
                chunks.append(now)
                now = []
        # where the 64th chunk would end before the text does, it goes on to its end
        out.append("".join(piecewise.DIGITS.tobytes().decode()[mix(sum(x * pow(b, j, 1 << 64) for j, x in enumerate(c)) & all_) >> 58] for c in chunks))
    return ":".join(out)


def test_fingerprints_are_those_of_a_plain_rolling_hash():
    dice = np.random.default_rng(8)
    for n in (0, 1, 6, 7, 8, 63, 64, 65, 200, 3_000, 20_000):
        for data in (dice.integers(0, 256, n).astype(np.uint8).tobytes(), dice.integers(97, 100, n).astype(np.uint8).tobytes(), b"z" * n):
            assert piecewise.fingerprint(data) == plain_fingerprint(data)


def test_an_edit_changes_the_digits_of_its_own_chunks():
    base = text(3_000).encode()
    at = 1_500
    changed = base[:at] + b"#" + base[at + 1 :]
    a, b = (piecewise.fingerprint(x).split(":") for x in (base, changed))
    assert a[0] == b[0] and distance(a[1], b[1]) <= 3


def test_edit_distances_and_likeness():
    a, b = (["".join(DICE.choice("ABC/") for _ in range(DICE.randint(0, 64))) for _ in range(60)] for _ in range(2))
    assert piecewise.distances(a, b).tolist() == [distance(x, y) for x, y in zip(a, b)]
    x = piecewise.fingerprint(text(900).encode())
    assert piecewise.likeness([(x, x), ("1:ABC:D", "8:ABC:D"), ("1::", "1::"), ("2:ABCD:AB", "4:AB:X")]).tolist() == [1.0, 0.0, 1.0, 1.0]


def test_rows_that_share_an_id_lie_in_many_ranges(spark):
    """A third without an id, a third with one id: their next documents are those of the order by id and hash."""
    rows = [(None, text(9)) for _ in range(150)] + [(77, text(9)) for _ in range(150)] + [(i, text(9)) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    placed = piecewise.with_next(frame).where("ahead = 0").groupBy("range").count().collect()
    assert len(placed) > 1 and max(r["count"] for r in placed) < 300
    keyed = sorted((r["none"], r["down"], r["th"], r["text"]) for r in frame.selectExpr("int(doc_id is null) none", "coalesce(~doc_id, 0L) down", "xxhash64(text) th", "text").collect())
    want = Counter(hashlib.sha256(piecewise.edited(k[3], keyed[(i + 1) % len(keyed)][3]).encode()).hexdigest() for i, k in enumerate(keyed))
    assert Counter(r["edited_sha256"] for r in piecewise.fingerprints(frame).collect()) == want


def test_edges_of_the_fingerprint_order(spark):
    one = spark.createDataFrame([(5, "only one", "x")], "doc_id long, text string, range string")
    r = piecewise.fingerprints(one).first()
    assert r["n_chars"] == 8 and r["near_next"] == 1.0
    few = spark.createDataFrame([(None, None), (None, "b"), (2, "x"), (2, "x"), (9, "")], "doc_id long, text string")
    assert piecewise.fingerprints(few).count() == 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.removed_repeats(none).count() == piecewise.fingerprints(none).count() == neardup.near_duplicates(none, 3, (85, 100)).count() == 0


def test_stretches_of_one_byte_are_one_piece(spark):
    """Many documents with long runs of one character or a short period: as brute force, and few pieces."""
    rng = np.random.default_rng(12)
    word = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    runs = ["-" * 400, " " * 90, "=-" * 120, "abc" * 80, "\n \n" * 60, "0123456789abcdef" * 12, "0123456789abcdefg" * 9]
    rows = []
    for i in range(60):
        parts = [runs[k] if rng.random() < 0.7 else runs[k][: rng.integers(30, 80)] for k in rng.integers(0, len(runs), 3)]
        rows.append((int(rng.integers(0, 50)), word(20) + parts[0] + word(int(rng.integers(0, 3))) + parts[1] + word(30) + parts[2]))
    rows += [(100, "-" * 70), (101, "-" * 49), (102, "-" * 50 + "+"), (103, "=" * 300), (104, "-=" * 100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffixes.removed_repeats(frame).collect())) == Counter(brute_suffixes(rows))
    long = "x" * 1_000_000
    plan = suffixes.Plan(np.zeros(suffixes.SLOTS, np.uint64), np.zeros((0, 2), np.uint64), 1)
    batch = [(i, i, 0, (f"{word(60)}{long[: 200_000 + i]}{word(60)}").encode()) for i in range(5)]
    pieces = [len(found[0]) for kind, _, found in suffixes._first_pass(batch, plan, suffixes.Sent()) if kind == 0]
    assert sum(pieces) < 5 * 60


def test_stretches_are_the_longest_of_the_smallest_period():
    rng = np.random.default_rng(5)
    for _ in range(30):
        texts = [b"".join(bytes(rng.integers(97, 99, rng.integers(1, 20)).astype(np.uint8)) * int(rng.integers(1, 30)) for _ in range(4)) for _ in range(3)]
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        skipped = np.zeros(len(data), bool)
        for a, b, p in suffixes.stretches(data, ends).tolist():
            skipped[a + p : b - suffixes.WIDTH + 1] = True
        raw = data.tobytes()
        for d, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
            for i in range(d, e - suffixes.WIDTH + 1):
                want = any(i - p >= d and raw[i : i + suffixes.WIDTH] == raw[i - p : i - p + suffixes.WIDTH] for p in range(1, suffixes.PERIODS + 1))
                assert skipped[i] == want
