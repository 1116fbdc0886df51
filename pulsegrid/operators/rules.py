"""Price alert rules: level crossings and moving-average crossings of an instrument's observations.

Touching the level counts as being on its far side: above means previous < level <= current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.validate import messages


def duplicates(prices: DataFrame) -> DataFrame:
    """(instrument, date) keys that occur more than once; a price file must have none."""
    return prices.groupBy("instrument", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def level_alerts(prices: DataFrame, rules: DataFrame) -> DataFrame:
    """(date, rule_id, instrument, direction) where an observation crosses its rule's level."""
    w = Window.partitionBy("instrument").orderBy("date")
    rows = prices.withColumn("before", F.lag("close").over(w)).join(rules.where(F.col("type") == "level"), "instrument")
    above = (F.col("direction") == "above") & (F.col("before") < F.col("level")) & (F.col("close") >= F.col("level"))
    below = (F.col("direction") == "below") & (F.col("before") > F.col("level")) & (F.col("close") <= F.col("level"))
    return rows.where(above | below).select("date", "rule_id", "instrument", "direction")


def running(prices: DataFrame) -> DataFrame:
    """(instrument, date, place from 1, upto: sum of the closes so far, known: number of those that aren't null). Months
    are summed by themselves and start where those before end, so no instrument is sorted as a whole."""
    close = F.coalesce("close", F.lit(0))
    slotted = prices.select("instrument", "date", "close", F.date_trunc("month", "date").alias("slot"))
    own = Window.partitionBy("instrument", "slot").orderBy("date")
    within = slotted.select("instrument", "slot", "date", F.row_number().over(own).alias("place"), F.sum(close).over(own).alias("upto"), F.count("close").over(own).alias("known"))
    ends = slotted.groupBy("instrument", "slot").agg(F.count(F.lit(1)).alias("place"), F.sum(close).alias("upto"), F.count("close").alias("known"))
    past = Window.partitionBy("instrument").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a month
    starts = ends.select("instrument", "slot", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}_before") for c in ("place", "upto", "known")])
    return within.join(starts, ["instrument", "slot"]).select("instrument", "date", *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in ("place", "upto", "known")])


def average_alerts(prices: DataFrame, rules: DataFrame) -> DataFrame:
    """Crossings of a short and a long moving average over the most recent observations; sums are cross-multiplied. Sums
    over windows are differences of running sums, so any number of pairs of windows is one join on shifted places."""
    asked = rules.where(F.col("type") == "ma_cross")
    sums = running(prices)
    rows = sums.join(asked.select("instrument", "short", "long").distinct(), "instrument").where(F.col("place") >= F.col("long"))
    ago = lambda name: sums.select("instrument", (F.col("place") + 0).alias(f"{name}_place"), F.col("upto").alias(f"{name}_upto"), F.col("known").alias(f"{name}_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    for name in ("short", "long"):  # place 0, before the first observation, has no row
        rows = rows.withColumn(f"{name}_place", (F.col("place") - F.col(name))).join(ago(name), ["instrument", f"{name}_place"], "left")
    s, t = F.col("upto") - zero("short_upto"), F.col("upto") - zero("long_upto")
    gap = F.when(F.col("known") - zero("long_known") == F.col("long"), F.signum(F.round(s * F.col("long") - t * F.col("short"), 6)))
    by = ["instrument", "short", "long"]
    gaps = rows.select(*by, "date", "place", gap.alias("g"))
    both = gaps.join(gaps.select(*by, (F.col("place") + 1).alias("place"), F.col("g").alias("p")), [*by, "place"])
    above = (F.col("direction") == "above") & (F.col("p") <= 0) & (F.col("g") > 0)
    below = (F.col("direction") == "below") & (F.col("p") >= 0) & (F.col("g") < 0)
    return both.join(asked, by).where(above | below).select("date", "rule_id", "instrument", "direction")


def rule_errors(rules: DataFrame) -> DataFrame:
    """Adds errors: what is wrong with each price rule."""
    t = F.col("type")
    return rules.withColumn("errors", messages([
        (F.coalesce(F.trim("rule_id"), F.lit("")) == "", "rule_id is required"), (F.coalesce(F.trim("instrument"), F.lit("")) == "", "instrument is required"),
        (t.isNull() | ~t.isin("level", "ma_cross"), "unknown type"), (F.col("direction").isNull() | ~F.col("direction").isin("above", "below"), "unknown direction"),
        ((t == "level") & F.col("level").isNull(), "level is required"),
        ((t == "ma_cross") & (F.col("short").isNull() | F.col("long").isNull() | (F.col("short") < 1) | (F.col("short") >= F.col("long"))), "windows need 1 <= short < long"),
    ]))


def ordered_alerts(alerts: DataFrame) -> DataFrame:
    """By date, then rule id byte by byte."""
    return alerts.orderBy("date", F.encode("rule_id", "utf-8"))
