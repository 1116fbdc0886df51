"""Small operators on topics by hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.operators import topics as O


def test_related_and_filters(spark):
    topics = spark.createDataFrame([("a", 3.0), ("b", 9.0), ("c", 3.0), ("d", None), ("e", 1.0)], "topic string, growth double")
    got: dict = {}
    for r in O.related(topics, 2).collect():
        got.setdefault(r["topic"], {})[r["place"]] = r["related"]
    assert got == {"a": {1: "b", 2: "c"}, "b": {1: "a", 2: "c"}, "c": {1: "b", 2: "a"}, "d": {1: "b", 2: "a"}, "e": {1: "b", 2: "a"}}
    rows = spark.createDataFrame([("p", " Positive", {"x": 3}), ("q", "negative", {"x": 0}), ("r", None, None), ("s", "positive", {"reddit": 1})], "k string, sentiment string, platforms map<string,int>")
    names = lambda f: sorted(r["k"] for r in f.collect())
    assert names(O.filtered(rows)) == ["p", "q", "r", "s"] and names(O.filtered(rows, "POSITIVE ")) == ["p", "s"]
    assert names(O.filtered(rows, platform="x")) == ["p", "r"] and names(O.filtered(rows, "positive", "x")) == ["p"]


def test_countries_and_referenced_rows(spark):
    rows = spark.createDataFrame([("India",), (" in ",), ("",), (None,), ("Nowhere",), ("FRANCE",)], "country string")
    got = {r["country"]: (r["code"], r["problem"]) for r in O.country_codes(rows, "country", spark.createDataFrame([("India", "IN"), ("france", "FR")], "name string, code string")).collect()}
    assert got == {"India": ("IN", None), " in ": ("IN", None), "": (None, None), None: (None, None), "Nowhere": (None, "unknown country Nowhere"), "FRANCE": ("FR", None)}
    primary, more = (spark.createDataFrame(r, "id long, v string") for r in ([(1, "p"), (2, "z"), (2, "y")], [(1, "r"), (3, "s")]))
    assert sorted(map(tuple, O.with_referenced(primary, more, "id").collect())) == [(1, "p"), (2, "y"), (3, "s")]


def test_raw_payloads_are_replaced_by_source_and_day(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 5)
    rows = lambda *r: spark.createDataFrame(list(r), "value string, s string, at timestamp")
    path = f"file://{tmp_path}/raw"
    O.dump_raw(rows(('{"a":1}', "x", day), ('{"b":1}', "reddit", day)), path, F.col("s"), F.col("at"))
    O.dump_raw(rows(('{"a":2}', "x", day)), path, F.col("s"), F.col("at"))
    assert sorted((r["value"], r["source"]) for r in spark.read.text(path).collect()) == [('{"a":2}', "x"), ('{"b":1}', "reddit")]
