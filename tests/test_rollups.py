"""Merged rollups against a plain count at every grain."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import rollups as U


def test_distinct_members_of_merged_slots(spark):
    dice, t0 = np.random.default_rng(2), dt.datetime(2023, 12, 25)
    rows = [(["a", "b", None][dice.integers(3)], t0 + dt.timedelta(hours=float(dice.random() * 1_500)), f"m{dice.integers(300)}" if dice.random() < 0.9 else None, float(dice.integers(0, 50))) for _ in range(2_000)] + [("a", None, "m1", 1.0)]
    frame = spark.createDataFrame(rows, "k string, at timestamp, who string, v double")
    want: dict = defaultdict(lambda: [0, 0.0, 0.0, set()])
    for k, at, who, v in rows:
        for name, hours, _ in U.GRAINS:
            if at is not None:
                seconds = int((at - dt.datetime(1970, 1, 1)).total_seconds() // (hours * 3600)) * hours * 3600
                own = want[k, name, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)]
                own[0], own[1], own[2] = own[0] + 1, own[1] + v, max(own[2], v)
                own[3] |= {who} - {None}
    found = U.merged_rollups(frame, ["k"], "at", "who", {"total": F.col("v")}, {"top": F.col("v")}).collect()
    assert {(r["k"], r["granularity"], r["bucket_start"]): (r["rows_"], r["total"], r["top"], r["members"]) for r in found} == {k: (n, s, m, len(who)) for k, (n, s, m, who) in want.items()}


def test_more_members_than_one_bitmap_holds(spark):
    frame = spark.range(70_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 1_000_000).alias("at"), F.format_string("m%06d", F.col("id") % 66_000).alias("who"))
    found = {r["granularity"]: r["members"] for r in U.merged_rollups(frame, ["k"], "at", "who", {}).where("granularity in ('7d', '30d')").collect()}
    assert found == {"7d": 66_000, "30d": 66_000}
    assert U.merged_rollups(frame.limit(0), ["k"], "at", "who", {}).collect() == []


def test_no_row_holds_a_bitmap(spark):
    """A bitmap has 4 KB, however few members it marks; many small groups held one each."""
    frame = spark.range(2_000).select(F.concat(F.lit("k"), F.col("id") % 500).alias("k"), F.timestamp_micros(F.col("id") * 1_000_000).alias("at"), F.when(F.col("id") % 3 > 0, F.format_string("m%d", F.col("id"))).alias("who"))
    found = U.merged_rollups(frame, ["k"], "at", "who", {"n": F.lit(1)})
    assert "bitmap" not in found._jdf.queryExecution().toString() and sum(r["members"] for r in found.where("granularity = '30d'").collect()) == 1_333
    groups = U.merged_rollups(frame.withColumn("who", F.lit(None).cast("string")), ["k"], "at", "who", {}).collect()
    assert len(groups) == 2_000 and {(r["rows_"], r["members"]) for r in groups} == {(4, 0)}
