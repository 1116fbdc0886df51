"""Every registered query of the engine against DuckDB over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from pulsegrid.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries without SQL, and the tests that hold them against plain Python or cases by hand.
ELSEWHERE = {
    "betweenness": "test_no_sql", "network_flags": "test_no_sql", "mentions_of_documents": "test_no_sql", "merkle_roots": "test_no_sql",
    "segmented_tags": "test_texts", "sentiment": "test_operators", "language_detection": "test_languages", "communities": "test_graphs",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v.isoformat() if hasattr(v, "isoformat") else v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_query(spark, duck, name):
    query, sql = registry.ALL[name]
    found = query(spark, SF)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if sql is None:
        assert name in ELSEWHERE and (got or name == "segmented_tags")  # the smallest table has no tags
        return
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())


def test_entry(spark):
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
