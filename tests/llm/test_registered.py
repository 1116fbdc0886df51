"""The registered queries over the smallest tables, against plain Python."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulsegrid.llm import registry
from pulsegrid.llm.shared import documents
from tests.llm.test_copies import brute_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in documents(spark, SF).collect()]


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_nearest_neighbours(spark):
    table = [(r["vec_id"], np.array(r["embedding"], float)) for r in documents(spark, SF, "embeddings").collect() if r["embedding"] is not None and None not in r["embedding"]]
    table = [(i, v) for i, v in table if np.isfinite(v).all() and v.any()]
    x, ids = np.stack([v for _, v in table]), np.array([i for i, _ in table])
    got: dict = defaultdict(list)
    for r in sorted(run(spark, "op1_nearest_neighbours"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        score = x @ x[ids == q][0]
        best = [(ids[k], score[k]) for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        hits += len({i for i, _ in best} & {i for i, _ in found}) / len(best)
        assert len(found) == len(best) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert hits >= 0.9 * len(got)


def test_op3_token_files(spark, rows):
    code, at, want = tokenizer("byte_bpe_50k.json"), 0, []
    for i, t, _ in sorted(rows):
        ids = [*code.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op3_token_files")) == want


def test_op4_mixing(spark, rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    by: dict = defaultdict(int)
    for i, _, s in rows:
        by[s] += size[i]
    got = run(spark, "op4_mixing")
    taken, target = defaultdict(int), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, sum(by.values()), set()
    while True:  # the excess of the capped is shared by the others
        rest = total - sum(3 * by[s] for s in capped)
        want = {s: 3 * by[s] if s in capped else rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        above = {s for s in order if s not in capped and want[s] > 3 * by[s]}
        if not above:
            break
        capped |= above
    assert len(got) == len(rows)
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= max(0.02 * want[s], 60)


def test_op5_suffix_dedup(spark, rows):
    least: dict = {}
    for i, t, _ in rows:
        raw = t.encode()
        for k in range(len(raw) - 49):
            w = raw[k : k + 50]
            least[w] = min(i, least.get(w, i))
    want = Counter()
    for i, t, _ in rows:
        raw = t.encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if least[raw[k : k + 50]] < i:
                hit[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1).sum())
        want[i, len(raw), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~hit].tobytes()).hexdigest()] += 1
    assert Counter(map(tuple, run(spark, "op5_suffix_dedup"))) == want


def test_op6_near_duplicates(spark, rows):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op6_near_duplicates"))
    assert got == brute_groups([(i, t) for i, t, _ in rows], 3, (85, 100))


def test_op7_toxicity(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op7_toxicity")}
    assert set(got) == {i for i, _, _ in rows}
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_op8_packing(spark, rows):
    code, pieces = tokenizer("word_bpe_49k.json"), {}
    for i, t, _ in rows:
        ids = [*code.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            pieces[i, k // 4096] = (k, len(ids[k : k + 4096]), crc(ids[k : k + 4096]))
    got = run(spark, "op8_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces and len(got) == len(pieces)
    sequences: dict = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(n for _, n, _ in pieces.values()) // 4096) + 1


def test_op9_fingerprints(spark, rows):
    order = sorted(((i, t) for i, t, _ in rows), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in run(spark, "op9_fingerprints")}
    prints: dict = {}
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        after = order[(k + 1) % len(order)][1]
        new = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for text, p in ((t, r["fingerprint"]), (new, r["edited_fingerprint"])):
            assert prints.setdefault(text, p) == p  # equal texts have equal fingerprints
        if new == t:
            assert r["near_edited"] == 1
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()])


def test_op10_url_filter(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = {r["page_id"]: r["url"] for r in documents(spark, SF, "pages").collect()}
    got = run(spark, "op10_url_filter")
    assert len(got) == len(urls)
    for r in got:
        _, mark, rest = (urls[r["page_id"]] or "").partition("://")
        host = re.split(r"[/?#]", rest, maxsplit=1)[0] if mark else ""
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0] if mark else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        best = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best)
        assert r["verdict"] == rules[best] if best else r["verdict"] in ("allow", "block")
