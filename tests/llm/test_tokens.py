from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import packing, tokenfiles, wordcode
from pulsegrid.llm.shared import new_path

PARTS = [" ", "  ", "\n", "\n\n", "\n\n\n", "\t", "a", "A.\n", "b's", "é", "中", " 12", "!", "́", "<|endoftext|>", "İ", "Σ", "\x1c", "　", "’", "word,", "x!\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_by_word_ids_are_the_whole_text_ids(name):
    whole, code, dice = Tokenizer.from_file(public_tokenizers.path(name)), wordcode.encoder(name), random.Random(5)
    texts = ["".join(dice.choice(PARTS) for _ in range(dice.randint(0, 9))) for _ in range(4000)]
    for text, ids in zip(texts, code.many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


class Counted:
    """A part of the tokenizers library that counts the strings it is given."""

    def __init__(self, part, given):
        self._part, self._given = part, given

    def __getattr__(self, name):
        found = getattr(self._part, name)
        if name not in ("encode", "encode_batch", "encode_batch_fast", "tokenize"):
            return found

        def call(texts, **more):
            self._given.append(len(texts) if isinstance(texts, list) else 1)
            return found(texts, **more)

        return call


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_reach_the_library_many_at_a_time_and_their_ends_once(name):
    whole, code, dice, given = Tokenizer.from_file(public_tokenizers.path(name)), wordcode.Encoder(name), random.Random(6), []
    for key, part in list(vars(code).items()):
        if type(part).__module__.startswith("tokenizers"):
            setattr(code, key, Counted(part, given))
    words = sorted({"".join(dice.choice("abcdefghijklmnopqrstuvwxyzABCéßñ") for _ in range(9)) for _ in range(8000)})
    text = " ".join(w + end for w in words for end in ("", ",", "!?", "###", "'s", ".5%"))
    for _ in range(2):
        (ids,) = code.many(["first " + text])
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode("first " + text, add_special_tokens=False).ids
    assert sum(given) < len(words) // 20


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_stay_right_when_words_are_forgotten(name, monkeypatch):
    monkeypatch.setattr(wordcode, "TOGETHER", 2000)
    whole, code, dice = Tokenizer.from_file(public_tokenizers.path(name)), wordcode.Encoder(name, 300), random.Random(7)
    parts = [" ", " ", " ", "\n", "\n\n", "\t", "a", "Zà", "º", "ª", "ſ", "é", "e\u0301", "中文", "\u00a0", "'s", "'ll", ",", "###", "_", "Ⅷ", "²", "12", "<|endoftext|>", "ẞ", "ŉ", "ΑΣ"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, code.many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_frames_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint64).astype("<u4")
    f = tokenfiles.pack_frame(ids, planes, 300)
    assert f["first"] == [0, 300, 600, 900] and f["n"] == [300, 300, 300, 100]
    assert (tokenfiles.unpack_frame(planes, f["n"], f["sizes"], f["payload"]) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_hold_every_document_in_order(spark, planes):
    rows = [(i, f"text {i} " * (i % 5), "x") for i in range(300, 0, -1)] + [(7, "again", "x"), (None, None, "x"), (301, "long word " * 3000, "x")]
    path = new_path(spark, "test-tokens")
    tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, start string"), path, planes=planes, block=512, frame=2000)
    got = sorted(tokenfiles.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    whole, at = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER)), 0
    for r, (i, text, _) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_no_documents(spark):
    path = new_path(spark, "test-none")
    none = spark.createDataFrame([], "doc_id long, text string")
    tokenfiles.write_token_files(none, path)
    assert tokenfiles.read_token_files(spark, path).count() == 0
    assert packing.pack_documents(none).count() == 0


def fewest(lengths: list[int], capacity: int) -> int:
    """Exhaustive: the fewest bins."""
    best = [len(lengths)]

    def place(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases_and_beats_best_fit():
    dice, better = random.Random(3), 0
    for _ in range(60):
        lengths = [dice.randint(20, 60) for _ in range(dice.randint(1, 9))]
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        assert len(bins) == fewest(lengths, 100)
    for _ in range(20):
        lengths = [dice.randint(1000, 2100) for _ in range(60)]
        better += len(packing.best_fit(lengths, 4096)) - len(packing.pack(lengths))
    assert better > 0


def test_completions_are_within_the_waste_and_undominated():
    lengths = [50, 40, 30, 20, 10]
    for chosen in packing.completions(60, lengths, 5):
        assert 55 <= sum(lengths[i] for i in chosen) <= 60
    sums = {sum(c) for n in range(6) for c in combinations(lengths, n) if 55 <= sum(c) <= 60}
    assert sums == {sum(lengths[i] for i in c) for c in packing.completions(60, lengths, 5)} == {60}


def test_packed_documents_are_whole_and_gapless(spark):
    rows = [(i, "word " * (i * 13 % 900), "x") for i in range(200)] + [(5, "word " * 65, "x"), (None, None, "x"), (999, "long " * 9000, "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, piece string"), block=64).collect()
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for i, text, _ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    by: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 4096
