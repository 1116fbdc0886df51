"""Language and confidence of texts, from profiles of letter trigrams.

A trigram is a letter with its neighbours in its word; a word's ends count as blanks. Profiles are counted from texts
whose language is known: for each language its PROFILE most frequent trigrams with their counts. A text's likelihood in
a language is that of its known trigrams (HALF a count is added to each); the confidence is the best language's share
of the likelihoods, the evidence counted as that of at most EVIDENCE trigrams, so a long text isn't surer than its
trigrams are. A text without any known trigram, blank or null, is ``unknown`` with confidence 0.

Counting combines within tasks and by the shuffle; what comes to the driver and is broadcast is PROFILE rows a language,
for at most LANGUAGES languages, those with most texts. Scoring is one pass without a shuffle, texts of any length are
read whole in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

PROFILE, EVIDENCE, HALF, LANGUAGES = 5_000, 20, 0.5, 256
#: Characters handled at once.
CHARACTERS = 500_000
UNKNOWN = "unknown"


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter; once for each Python worker."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, trigram as three code points in one number) of each letter of the texts."""
    joined = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = [len(j) // 4 + 1 for j in joined]
    codes = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0".join(joined) + b"\0\0\0\0", np.uint32)
    letter = letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.int64)
    at = np.flatnonzero(letter)
    owner = np.searchsorted(np.cumsum(sizes), at - 1, side="right")
    return owner, codes[at - 1] << 42 | codes[at] << 21 | codes[at + 1]


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, texts) of bounded size; a longer text is cut where no word is, if it has such a place."""
    numbers, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < max(len(text), 1):
            end = min(len(text), at + CHARACTERS)
            cut = end
            while end < len(text) and cut > at and (text[cut].isalpha() and text[cut - 1].isalpha()):
                cut -= 1
            part = text[at : cut if cut > at else end]
            at += max(len(part), 1)
            numbers.append(i)
            held.append(part)
            size += len(part)
            if size >= CHARACTERS:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


class Profiles(NamedTuple):
    """names: the languages in order; keys: the known trigrams in order; weights: their log likelihoods, a column a language."""

    names: list[str]
    keys: np.ndarray
    weights: np.ndarray


def profiles(texts: DataFrame, lang: str = "lang", text: str = "text") -> Profiles:
    """Profiles of the texts' known languages; rows without a language or text teach nothing."""
    known = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("lang")["text"]:
                for _, part in pieces(own.tolist()):
                    keys, n = np.unique(trigrams(part)[1], return_counts=True)
                    yield pd.DataFrame({"lang": name, "key": keys, "n": n})

    counted = known.join(F.broadcast(most.select("lang")), "lang").mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    rows = counted.withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "key", "n").toPandas()  # PROFILE rows a language
    names, keys = sorted(rows["lang"].unique()), np.unique(rows["key"].to_numpy(np.int64))
    table = np.zeros((len(keys), len(names)))
    table[np.searchsorted(keys, rows["key"].to_numpy(np.int64)), [names.index(x) for x in rows["lang"]]] = rows["n"].to_numpy(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        weights = np.log((table + HALF) / (table.sum(axis=0) + HALF * len(keys)))
    return Profiles(names, keys, weights)


def likelihoods(texts: list[str], known: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihoods, a column a language; number of known trigrams) of each text."""
    total, n = np.zeros((len(texts), len(known.names))), np.zeros(len(texts))
    for numbers, part in pieces(texts):
        owner, keys = trigrams(part)
        at = np.searchsorted(known.keys, keys)
        on = (at < len(known.keys)) & (known.keys[np.minimum(at, len(known.keys) - 1)] == keys) if len(known.keys) else np.zeros(len(keys), bool)
        at, owner = at[on], np.array(numbers)[owner[on]]
        n += np.bincount(owner, minlength=len(texts))
        for k in range(len(known.names)):
            total[:, k] += np.bincount(owner, known.weights[at, k], len(texts))
    return total, n


def detect(rows: DataFrame, known: Profiles, text: str = "text") -> DataFrame:
    """Adds detected and confidence (two decimals) to the rows; columns of these names are replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(known)  # PROFILE rows a language, LANGUAGES languages at most
    rows = rows.drop("detected", "confidence")
    out = StructType([*rows.schema.fields, StructField("detected", StringType()), StructField("confidence", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if own.names:
                total, n = likelihoods(texts, own)
                scaled = total / np.maximum(1, n / EVIDENCE)[:, None]
                share = np.exp(scaled - scaled.max(axis=1, keepdims=True))
                best = scaled.argmax(axis=1)
                names = [own.names[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
                sure = np.where(n > 0, np.floor(100 / share.sum(axis=1) + 0.5) / 100, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(sure)], names=[*batch.schema.names, "detected", "confidence"])

    return rows.mapInArrow(run, out)
