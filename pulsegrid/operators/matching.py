"""Dictionary matching: which of very many listed names stands in a text, or names nearly the same thing.

A dictionary has rows (name, ord); where several fit, the smallest ord wins (ords tell names apart). One Aho-Corasick automaton finds every listed
name in a text in one pass, however long the list. A dictionary of up to MOST names is one automaton, built once in each
Python worker; a longer one is cut by a hash of the names into parts, which the rows pass one after the other, so no task
holds more than MOST names at once per part and none is left out. Rows aren't shuffled. Texts are read whole.

Null and empty names list nothing, a null text contains nothing; of names listed twice the smaller ord counts.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Names of one automaton.
MOST = 500_000
_HELD: dict[str, Finder] = {}


def plain(name: Column) -> Column:
    """Lower-case letters and digits of a name alone."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")


def _listed(dictionary: DataFrame, key: Column, most: int) -> list[list[tuple[str, int, str]]]:
    """(key, ord, name) of each part of a dictionary, in order; at most about `most` come to the driver at once."""
    rows = dictionary.where(F.col("name").isNotNull() & F.col("ord").isNotNull()).select(key.alias("key"), F.col("ord").cast("long").alias("ord"), "name").where("key <> ''")
    first = rows.groupBy("key").agg(F.min(F.struct("ord", "name")).alias("f")).select("key", "f.ord", "f.name")
    parts = max(1, -(-first.count() // most))
    return [[(r["key"], r["ord"], r["name"]) for r in first.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == p).orderBy("ord", "key").collect()] for p in range(parts)]


class Finder:
    """The listed names of one part in an automaton, and in one text in which names around a given one are found."""

    def __init__(self, listed: list[tuple[str, int, str]]):
        self.ords, self.names = [o for _, o, _ in listed], [n for *_, n in listed]
        self.exact = {k: i for i, (k, *_) in enumerate(listed)}
        self.automaton = ahocorasick.Automaton()
        for i, (k, *_) in enumerate(listed):
            self.automaton.add_word(k, i)
        if listed:
            self.automaton.make_automaton()
        self.text, self.starts = "\n" + "\n".join(k for k, *_ in listed), []
        at = 1
        for k, *_ in listed:
            self.starts.append(at)
            at += len(k) + 1

    def within(self, text: str) -> int | None:
        """The first listed name that the text contains; names are listed by ord."""
        return min((i for _, i in self.automaton.iter(text)), default=None) if self.names else None

    def around(self, name: str) -> int | None:
        """The first listed name that contains this one."""
        at = self.text.find(name) if name else -1
        return bisect_right(self.starts, at) - 1 if at >= 0 else None


def finder(shared: Broadcast, token: str) -> Finder:
    """One for each Python worker and part."""
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = Finder(shared.value)
    return _HELD[token]


@cache
def _fields(kind: str) -> list[StructField]:
    return [StructField(f"{kind}_ord", LongType()), StructField(f"{kind}_name", StringType())]


def _passed(rows: DataFrame, column: str, dictionary: DataFrame, key: Column, kind: str, find, most: int) -> DataFrame:
    """Adds the best (ord, name) that find(Finder, text) gives over all parts."""
    for part in _listed(dictionary, key, most):
        shared = rows.sparkSession.sparkContext.broadcast(part)  # at most about MOST names
        out = StructType([*[f for f in rows.schema.fields if f not in _fields(kind)], *_fields(kind)])

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared, token: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            own, memo = finder(shared, token), {}
            for batch in batches:
                found = []
                before = batch.column(f"{kind}_ord").to_pylist() if f"{kind}_ord" in batch.schema.names else [None] * batch.num_rows
                names = batch.column(f"{kind}_name").to_pylist() if f"{kind}_name" in batch.schema.names else before
                for text, old, name in zip(batch.column(column).to_pylist(), before, names, strict=True):
                    at = None
                    if text is not None:
                        at = memo[text] if text in memo else find(own, text)
                        if len(text) < 64 and len(memo) < 100_000:
                            memo[text] = at
                    better = at is not None and (old is None or own.ords[at] < old)
                    found.append((own.ords[at], own.names[at]) if better else (old, name))
                keep = [c for c in batch.schema.names if c not in (f"{kind}_ord", f"{kind}_name")]
                columns = [batch.column(c) for c in keep] + [pa.array([o for o, _ in found], pa.int64()), pa.array([n for _, n in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, f"{kind}_ord", f"{kind}_name"])

        rows = rows.mapInArrow(run, out)
    return rows


def first_contained(rows: DataFrame, text: str, dictionary: DataFrame, name: str = "found", most: int = MOST) -> DataFrame:
    """Adds the first listed name that a row's text contains, whatever the case; null where it contains none."""
    lowered = rows.drop(name).withColumn("low_", F.lower(F.col(text)))
    found = _passed(lowered, "low_", dictionary, F.lower("name"), "in", Finder.within, most)
    return found.select(*[c for c in rows.columns if c != name], F.col("in_name").alias(name))


def matched(rows: DataFrame, column: str, dictionary: DataFrame, name: str = "matched", most: int = MOST) -> DataFrame:
    """Adds the listed name that equals a row's but for case, spaces and punctuation, else the first that lies in it or
    contains it; null where none does."""
    def nearly(own: Finder, text: str) -> int | None:
        return min((i for i in (own.within(text), own.around(text)) if i is not None), default=None)

    asked = rows.drop(name).withColumn("plain_", plain(F.col(column)))
    same = _passed(asked, "plain_", dictionary, plain(F.col("name")), "same", lambda own, text: own.exact.get(text), most)
    near = _passed(same, "plain_", dictionary, plain(F.col("name")), "near", nearly, most)
    return near.select(*[c for c in rows.columns if c != name], F.coalesce("same_name", "near_name").alias(name))
