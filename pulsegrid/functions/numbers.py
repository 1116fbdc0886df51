"""Numeric column functions. Rounding is half towards plus infinity on the binary double, everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("dormant", "emerging", "trending", "viral", "mega_viral")


def js_round(x: Column | str, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d; null and non-finite values become 0."""
    x = F.col(x) if isinstance(x, str) else x
    scale = 10.0**digits
    found = F.floor(x * scale + 0.5) / scale
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(found)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def clamp_scale(x: Column, low: float, high: float) -> Column:
    """Where x lies between two bounds, 0 to 1."""
    return clamp01((x - low) / (high - low))


def null_sum(*columns: Column | str) -> Column:
    """Sum of the known values; null only where all are null."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    total = sum((F.coalesce(c, F.lit(0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0)))
    return F.when(F.coalesce(*cols).isNotNull(), total)


def non_negative(x: Column) -> Column:
    """A number that is 0 where it is missing, not a number or negative."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (d < 0), 0.0).otherwise(d)


def safe_count(x: Column, fallback: int | None = 0) -> Column:
    """A whole number, truncated; the fallback for negative, missing or non-numeric input."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (d < 0), F.lit(fallback)).otherwise(d.cast("long")).cast("long")


def humanize(x: Column) -> Column:
    """1.2B, 3.4M, 5.6K (one decimal, none where it is 0), or the rounded number."""

    def short(unit: float, mark: str) -> Column:
        tenth = F.floor(x / unit * 10 + 0.5) / 10
        whole = tenth == F.floor(tenth)
        return F.concat(F.when(whole, F.floor(tenth).cast("string")).otherwise(tenth.cast("string")), F.lit(mark))

    plain = F.floor(x + 0.5).cast("string")
    return F.when(x >= 1e9, short(1e9, "B")).when(x >= 1e6, short(1e6, "M")).when(x >= 1e3, short(1e3, "K")).otherwise(plain)


def parse_suffixed(text: Column) -> Column:
    """2.4M, 850K, +82% as a number; null where it is none."""
    bare = F.regexp_replace(F.trim(text), r"[+,%]", "")
    number = F.regexp_replace(bare, r"(?i)[kmb]$", "").try_cast("double")
    last = F.upper(F.right(bare, F.lit(1)))
    return number * F.when(last == "K", 1e3).when(last == "M", 1e6).when(last == "B", 1e9).otherwise(1.0)


def influence(followers: Column, vote_confidence: Column | None = None) -> Column:
    """Author influence multiplier: 1 + log10(1 + followers), up to a tenth more with vote confidence."""
    base = F.when(followers > 0, 1 + F.log10(1 + followers.cast("double"))).otherwise(1.0)
    return base if vote_confidence is None else base * (1 + 0.1 * clamp01(F.coalesce(vote_confidence, F.lit(0.0))))


def tier(score: Column) -> Column:
    return F.when(score <= 0.2, "dormant").when(score <= 0.4, "emerging").when(score <= 0.6, "trending").when(score <= 0.8, "viral").otherwise("mega_viral")


def tier_order(name: Column) -> Column:
    """Ordinal of a tier; -1 where it is unknown."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), name) - 1, F.lit(-1)).cast("int")


def polarity(positive: Column, neutral: Column, negative: Column) -> Column:
    """1 to 5 from percentages of the three sentiments."""
    return (5 * positive + 3 * neutral + negative) / 100


def emotion_polarity(score: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), score))


def humanize_fixed(x: Column) -> Column:
    """1.2M with one decimal, K with one decimal below 10 thousand and none from there on, else the number."""
    tenth = lambda u: F.format_string("%.1f", F.floor(x / u * 10 + 0.5) / 10)
    return (
        F.when(x >= 1e6, F.concat(tenth(1e6), F.lit("M"))).when(x >= 1e4, F.concat(F.floor(x / 1e3 + 0.5).cast("string"), F.lit("K")))
        .when(x >= 1e3, F.concat(tenth(1e3), F.lit("K"))).otherwise(F.floor(x + 0.5).cast("string"))
    )


def shortest(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def valid_date(text: Column) -> Column:
    """YYYY-MM-DD that exists in the calendar."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))
