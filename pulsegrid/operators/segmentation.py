"""Hashtag segmentation: split at case, digits and underscores; then a beam search over a ranked word list."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beam width, costs of unknown pieces, gap from which the best segmentation counts as confident.
BEAM, UNKNOWN, FAR, CONFIDENT = 8, 15.0, 9e9, 0.12


def split_cases(tag: Column) -> Column:
    """Words at camel case, digits and underscores."""
    bare = F.regexp_replace(tag, "^#", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, r"_+", " "), r"(\p{Ll})(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    spaced = F.regexp_replace(F.regexp_replace(spaced, r"(\p{L})(\p{N})", "$1 $2"), r"(\p{N})(\p{L})", "$1 $2")
    return F.trim(spaced)


def word_costs(ranked: list[str]) -> dict[str, float]:
    """ln(rank * ln(number)) of each word, most frequent first."""
    return {w: math.log((i + 1) * math.log(max(len(ranked), 2))) for i, w in enumerate(ranked)}


def segment(word: str, costs: dict[str, float], longest: int) -> tuple[list[str], bool]:
    """Cheapest cut into words and whether it is clearly cheaper than the second cheapest."""
    beams: list[list[tuple[float, list[str]]]] = [[(0.0, [])]] + [[] for _ in word]
    for end in range(1, len(word) + 1):
        options = []
        for size in range(1, min(end, max(longest, 6)) + 1):
            piece = word[end - size : end]
            cost = costs.get(piece)
            if cost is None:
                cost = UNKNOWN if 2 <= size <= 6 else FAR / size**2
            options += [(c + cost, [*words, piece]) for c, words in beams[end - size]]
        beams[end] = sorted(options)[:BEAM]
    best = beams[-1]
    if not best:
        return [word], False
    gap = (best[1][0] - best[0][0]) / max(best[0][0], 1e-9) if len(best) > 1 else 1.0
    return best[0][1], gap >= CONFIDENT


def segment_tags(tags: DataFrame, column: str, ranked: list[str], fallback: Callable[[str], list[str]] | None = None) -> DataFrame:
    """Adds words, layer and confident. Tags that case splits are done; others go through the word list; where that
    is not confident the fallback may answer, else its best cut stands."""
    costs = word_costs([w.lower() for w in ranked])
    longest = max(map(len, costs), default=0)
    shared = tags.sparkSession.sparkContext.broadcast(costs)  # the given word list

    @F.pandas_udf("words array<string>, layer int, confident boolean")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                words = (text or "").split()
                if len(words) != 1:
                    rows.append((words, 1, True))
                    continue
                found, sure = segment(words[0].lower(), shared.value, longest)
                if not sure and fallback is not None:
                    rows.append((fallback(words[0]), 3, True))
                else:
                    rows.append((found, 2, sure))
            yield pd.DataFrame(rows, columns=["words", "layer", "confident"])

    return tags.withColumn("cut", cut(split_cases(F.col(column)))).select(*tags.columns, "cut.*")
