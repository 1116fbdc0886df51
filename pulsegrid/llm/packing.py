"""Best-fit packing of documents into training sequences by bin completion.

Each task packs blocks of bounded size: best-fit decreasing gives the incumbent; where it uses more sequences than
the block's lower bound, branch and bound by bin completion takes the worst filled sequences apart: around the
largest document left it enumerates undominated fillings, least waste first, and prunes by the waste that a packing
with one sequence less could afford. Sequences that are far from full at a block's end are packed again with the
next block of the task.

Nulls: a null text is empty (its document is the end id alone); null ids are ids like any other. Repeated rows are
packed as often as they occur. Texts longer than a sequence are cut, others never. An empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import arrow_rows, documents, materialize, release, text_or_empty
from pulsegrid.llm.wordcode import encoder

TOKENIZER, END, CAPACITY = "word_bpe_49k.json", 1, 4096
#: Pieces that a task packs at once; sequences fuller than CLOSED are not packed again; nodes of one search.
BLOCK, CLOSED, NODES = 20_000, 0.98, 4_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; no shuffle, and no text leaves its task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, tail, step = encoder(tokenizer), np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], code.many(batch["text"]), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            found = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield found.assign(doc_id=found["doc_id"].astype("Int64"))
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indices. Open bins are found by their room in a bit set."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in order:
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        by_room.setdefault(left, []).append(b)
        rooms |= 1 << left
    return bins


def completions(room: int, lengths: list[int], waste: int, most: int = 64) -> list[list[int]]:
    """Undominated fillings (positions in lengths, which falls) of a bin's room that leave at most waste free."""
    found: list[tuple[int, list[int]]] = []
    budget = [20 * most]
    after = [0] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        after[k] = after[k + 1] + lengths[k]

    def grow(k: int, left: int, chosen: list[int]) -> None:
        if len(found) >= most or budget[0] <= 0:
            return
        budget[0] -= 1
        if left - after[k] > waste:  # even all that is left to choose from can't fill enough
            return
        if k == len(lengths) or left < lengths[-1]:
            if left <= waste:
                found.append((left, list(chosen)))
            return
        last = None
        for j in range(k, len(lengths)):
            if lengths[j] > left or lengths[j] == last:
                continue
            last = lengths[j]
            chosen.append(j)
            grow(j + 1, left - lengths[j], chosen)
            chosen.pop()
        if left <= waste:
            found.append((left, list(chosen)))

    grow(0, room, [])
    kept, seen = [], set()
    for left, chosen in sorted(found, key=lambda x: (x[0], len(x[1]))):
        key = tuple(lengths[j] for j in chosen)
        if key not in seen and not _dominated(left, chosen, lengths):
            seen.add(key)
            kept.append(chosen)
    return kept


def _dominated(left: int, chosen: list[int], lengths: list[int]) -> bool:
    """Whether one unused document could take the place of one or two chosen ones and fill more."""
    used = set(chosen)
    sums = {lengths[j] for j in chosen} | {lengths[i] + lengths[j] for n, i in enumerate(chosen) for j in chosen[n + 1 :]}
    return any(s < lengths[u] <= s + left for u in range(len(lengths)) if u not in used for s in sums)


def complete(lengths: list[int], capacity: int, bins: int, nodes: int = NODES) -> list[list[int]] | None:
    """A packing into so many bins by bin completion, or None where the search finds none."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    spent = [0]

    def search(left: list[int], bins_left: int, waste: int) -> list[list[int]] | None:
        if not left:
            return []
        spent[0] += 1
        if bins_left == 0 or waste < 0 or spent[0] > nodes:
            return None
        first, rest = left[0], left[1:]
        room = capacity - lengths[first]
        for chosen in completions(room, [lengths[i] for i in rest], waste):
            taken = set(chosen)
            free = room - sum(lengths[rest[j]] for j in chosen)
            more = search([i for j, i in enumerate(rest) if j not in taken], bins_left - 1, waste - free)
            if more is not None:
                return [[first, *(rest[j] for j in chosen)], *more]
            if spent[0] > nodes:
                return None
        return None

    return search(order, bins, bins * capacity - sum(lengths))


def pack(lengths: list[int], capacity: int = CAPACITY, at_once: int = 14, tries: int = 6) -> list[list[int]]:
    """Bins of indices: best-fit decreasing, then bin completion over the worst filled bins while that saves one."""
    bins = best_fit(lengths, capacity)
    least = -(-sum(lengths) // capacity)
    fill = lambda b: sum(lengths[i] for i in b)
    while len(bins) > least and tries:
        bins.sort(key=fill)
        some, waste = 0, 0
        while some < len(bins) and (waste < capacity or some < at_once):
            waste += capacity - fill(bins[some])
            some += 1
        if waste < capacity or some > 6 * at_once:
            break
        items = [i for b in bins[:some] for i in b]
        better = complete([lengths[i] for i in items], capacity, some - 1)
        if better is None:
            tries -= 1
            at_once += 4
            continue
        bins = [[items[j] for j in b] for b in better] + bins[some:]
    return bins


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, start, length, ids_crc32), a table written before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def close(last: bool) -> pd.DataFrame:
            nonlocal number, held
            rows, again = [], []
            lengths = [r[3] for r in held]
            for b in pack(lengths, capacity):
                if not last and sum(lengths[i] for i in b) < CLOSED * capacity:
                    again += [held[i] for i in b]
                    continue
                at = 0
                for i in b:
                    rows.append((*held[i], number, at))
                    at += lengths[i]
                number += 1
            held = again
            found = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
            return found.assign(doc_id=found["doc_id"].astype("Int64"))

        for batch in batches:
            for row in zip(*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), strict=True):
                held.append((None if pd.isna(row[0]) else int(row[0]), *map(int, row[1:])))
                if len(held) >= block:
                    yield close(False)
                    if len(held) > block // 2:  # little could be closed
                        yield close(True)
        yield close(True)

    parts = max(1, -(-cut.count() // block))
    spread = cut.repartition(parts, F.xxhash64("doc_id", "piece", "ids_crc32"))
    ordered = spread.sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
    return ordered.mapInPandas(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    with arrow_rows(docs.sparkSession):
        cut = materialize(pieces(docs, tokenizer, end, capacity), "pieces")
    return pack_pieces(cut, capacity, block)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"))
