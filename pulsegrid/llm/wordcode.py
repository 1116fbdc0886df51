"""Encoding of whole texts with the tokenizers library, word by word.

Both tokenizers used here never merge across the space before a word or the line end before it, so a text's ids are
the ids of its words, each taken with that space or line end. A task keeps a bounded cache of words it has encoded.
The byte-level tokenizer cuts longer runs of white space in ways that depend on what follows; texts with such runs
(other than an empty line) are encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept by a task, about, if it doesn't name another number; characters of the texts encoded together; runs of letters
#: joined for the merge model.
MOST_WORDS, TOGETHER, JOINED = 400_000, 6_000_000, 64
#: An empty line before more white space, or at the end.
RUN = re.compile(r"\n\n(?:\s|\Z)")
#: The letters that a word begins with, and the line end before them.
LETTERS = re.compile(r"\n?[^\W\d_]*")
#: How byte-level tokenizers write bytes: visible Latin-1 characters as they are, the others from U+0100 on.
ODD, NEW = -1, -2
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, one after the other, and the lists' lengths."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[start:start + size] of each pair, one after the other."""
    upto = np.cumsum(sizes)
    most = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(most, len(pool)) < 1 << 30 else np.int64
    return pool[np.repeat((starts - upto + sizes).astype(kind), sizes) + np.arange(most, dtype=kind)]


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    Both tokenizers take the letters that a word begins with as a word of its own. So new letters go to the merge model many
    at a time, and what follows them (stops, marks, digits) is encoded once for all words that end alike.
    """

    def __init__(self, name: str, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
        self._cuts = self._tokenizer.normalizer is None  # byte level: the space before a word is part of it
        self._most = most_words
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._merges, self._edges = self._model()
        self._forget()

    def _model(self) -> tuple:
        """The merge model alone, and which ids begin (byte level) or end a run of letters. No model if the vocabulary lacks a
        byte, at a run's end too, or has tokens that reach over a space or line end into letters."""
        from tokenizers import Tokenizer, pre_tokenizers

        vocab, suffix = self._tokenizer.get_vocab(), getattr(self._tokenizer.model, "end_of_word_suffix", None)
        merges, shown = Tokenizer(self._tokenizer.model), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        edges, back, leads = np.zeros(max(vocab.values()) + 1, bool), {c: b for b, c in BYTES.items()}, (BYTES[32], BYTES[10])
        if self._cuts:
            merges.pre_tokenizer = shown
            edges[[i for t, i in vocab.items() if t.startswith(leads)]] = True
            over = [t for t in vocab if any(x in t[1:] for x in leads) or t[0] == leads[1] and len(t) > 1]
            fits = not suffix and all(bytes(back.get(c, 0) for c in t).decode(errors="replace").isspace() for t in over)
        else:
            merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), shown])
            edges[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
            fits = bool(suffix) and all(c + suffix in vocab for c in back)
        return merges if fits and all(c in vocab for c in back) else None, edges

    def _forget(self) -> None:
        """Words by number (ODD: one that forces its text to be encoded at once); the ids of number n are
        pool[starts[n]:starts[n] + sizes[n]]. What follows a word's letters is kept with a space before it."""
        self._known: dict[str, int] = {}
        self._pool, self._starts, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self._known.get, words, repeat(NEW)), np.int64, len(words))

    def _keep(self, words: Iterable[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self._starts)
        self._starts = np.concatenate([self._starts, len(self._pool) + np.cumsum(sizes) - sizes])
        self._sizes, self._pool = np.concatenate([self._sizes, sizes]), np.concatenate([self._pool, ids])
        self._known.update(zip(words, range(first, len(self._starts)), strict=True))

    def whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _led(self, words: list[str]) -> list[str]:
        """With the space before them, where it is part of the word."""
        return [w if w[0] == "\n" else " " + w for w in words] if self._cuts else words

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of letters, one after the other, and how many each has."""
        led, between = (self._led(runs), "") if self._cuts else ([r.lower() for r in runs], " ")
        joined = [between.join(led[k : k + JOINED]) for k in range(0, len(led), JOINED)]
        ids, _ = flat([e.ids for e in self._merges.encode_batch_fast(joined, add_special_tokens=False)])
        edges = np.flatnonzero(self._edges[ids])
        return ids, np.diff(edges, append=len(ids)) if self._cuts else np.diff(edges, prepend=-1)

    def _head(self, word: str) -> str:
        """The part of a word that _runs may take; empty, if there is none."""
        if self._merges is None:
            return ""
        head = LETTERS.match(word).group()
        if self._cuts:
            return head if head.isalpha() or head[:1] == "\n" and head[1:].isalpha() else ""
        # nothing that the normalizer changes but for capitals, or merges with what follows
        return head if head.isalpha() and (word.isascii() or max(head) < "\u0180" and "İ" not in head and word[len(head) :].isascii()) else ""

    def _learn(self, words: list[str]) -> np.ndarray:
        """The numbers of these words, none of which is there twice."""
        number = self._numbers(words)
        if len(self._known) > self._most:  # those of this batch stay
            stay, odd = np.flatnonzero(number >= 0), np.flatnonzero(number == ODD)
            starts, sizes = self._starts[number[stay]], self._sizes[number[stay]]
            ids = gather(self._pool, starts, sizes)
            self._forget()
            self._keep([words[i] for i in stay.tolist()], ids, sizes)
            self._known.update((words[i], ODD) for i in odd.tolist())
            number = self._numbers(words)
        at = np.flatnonzero(number == NEW)
        new = [words[i] for i in at.tolist()]
        self._add(new)
        number[at] = self._numbers(new)
        return number

    def _add(self, words: list[str]) -> None:
        known, cuts = self._known, self._cuts
        runs: dict[str, None] = {}
        ended, heads, ends, others = [], [], [], []
        if cuts and self._merges is not None:
            runs, words = dict.fromkeys(filter(str.isalpha, words)), [w for w in words if not w.isalpha()]
        for w in words:
            if cuts and (not w or w[-1].isspace() and w != "\n" or w[0].isspace() and w[0] != "\n"):
                known[w] = ODD
                continue
            head = self._head(w)
            if not head:
                others.append(w)
                continue
            if head not in known:
                runs[head] = None
            if len(head) < len(w):
                ended.append(w)
                heads.append(head)
                ends.append(" " + w[len(head) :])
        if runs:
            ids, sizes = self._runs(list(runs))
            self._keep(runs, ids, sizes)
        if others:
            self._keep(others, *self._each(self._led(others)))
        if ended:
            new = [e for e in dict.fromkeys(ends) if e not in known]
            self._keep(new, *self._each([e[1:] for e in new]))
            pairs = np.stack([self._numbers(heads), self._numbers(ends)], axis=1)
            sizes = self._sizes[pairs]
            self._keep(ended, gather(self._pool, self._starts[pairs].ravel(), sizes.ravel()), sizes.sum(axis=1))

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        """Arrow cuts the texts and numbers their distinct words, of which alone Python sees each once."""
        column = pa.array(texts, pa.large_string())
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " \n" if self._cuts else " "), " ")
        coded = parts.flatten().dictionary_encode()
        ends = parts.offsets.to_numpy()
        number = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = number[coded.indices.to_numpy()]
        pool, starts, sizes = self._pool, self._starts, self._sizes
        whole = set()
        if self._cuts:
            # a text's first word has no space before it
            firsts, own = self._each([t.partition("\n")[0].partition(" ")[0] for t in texts])
            first = len(starts) + np.arange(len(texts))
            at[ends[:-1]] = first
            starts, sizes = np.concatenate([starts, len(pool) + np.cumsum(own) - own]), np.concatenate([sizes, own])
            pool = np.concatenate([pool, firsts])
            whole |= set((np.searchsorted(ends, np.flatnonzero(at == ODD), side="right") - 1).tolist())
            lined = pc.match_substring(column, "\n\n").to_numpy(zero_copy_only=False)
            whole |= {i for i in np.flatnonzero(lined).tolist() if RUN.search(texts[i]) or any(a in texts[i] for a in self._added)}
            at[at == ODD] = first[0] if len(first) else 0  # their texts are encoded whole
        n = sizes[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = gather(pool, starts[at], n).astype("<u4", copy=False).tobytes()
        cuts = (4 * upto[ends]).tolist()
        for i, text in enumerate(texts):
            yield self.whole(text) if i in whole else ids[cuts[i] : cuts[i + 1]]

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; texts of about TOGETHER characters are taken at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        if held:
            yield from self._together(held)

    def rows(self, batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
        """(doc_id, ids) of each row of these batches, in order."""
        waiting: deque = deque()

        def texts() -> Iterator[str]:
            for batch in batches:
                waiting.extend(batch["doc_id"])
                yield from batch["text"]

        for ids in self.many(texts()):
            yield waiting.popleft(), ids


@cache
def encoder(name: str, most_words: int = MOST_WORDS) -> Encoder:
    """One for each Python worker. Its words are no cyclic garbage, so the collector need not look at them often."""
    found = Encoder(name, most_words)
    gc.freeze()
    gc.set_threshold(100_000)
    return found
