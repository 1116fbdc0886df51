"""Text column functions: tags, mentions, URLs, fingerprints, slugs, relevance."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRAILING = r"[.,;:!?)\]}>'\"]+$"
#: Collected tags and mentions, not after a word character; the mark comes first, so that few places look behind them.
TAG, MENTION = r"#(?<![\p{L}\p{N}_#]#)(\p{L}[\p{L}\p{N}_-]*)", r"@(?<![\p{L}\p{N}_@]@)([A-Za-z0-9_]+)"


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def distinct_folded(items: Column) -> Column:
    """Distinct but for case, the first spelling of each kept, in order. Equal ones are brought together by a sort, so
    each looks at its neighbour alone; the items are worked out once."""
    spelled = F.sort_array(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("folded"), i.alias("at"), x.alias("x"))))
    first = lambda s: F.filter(s, lambda e, j: e["folded"].isNotNull() & ((j == 0) | ~F.get(s, j - 1)["folded"].eqNullSafe(e["folded"])))
    kept = F.get(F.transform(F.array(spelled), first), F.lit(0))  # an array of one, so that the sorted items have a name
    return F.transform(F.sort_array(F.transform(kept, lambda e: F.struct(e["at"], e["x"]))), lambda e: e["x"])


def hashtags(text: Column) -> Column:
    """Lower-case distinct tags of letters, digits and underscores, with their #."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0)), F.lower))


def collected_hashtags(text: Column) -> Column:
    """Tags as collected: a letter first, not after a word character, without #; first spelling kept."""
    return distinct_folded(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)))


def mentions(text: Column) -> Column:
    return distinct_folded(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)))


def urls(text: Column) -> Column:
    """Targets of markdown links, then plain URLs; stops at the end cut off; distinct but for case."""
    linked = F.regexp_extract_all(text, F.lit(r"\]\((https?://[^\s)]+)\)"), F.lit(1))
    plain = F.regexp_extract_all(F.regexp_replace(text, r"\]\(https?://[^\s)]+\)", "]"), F.lit(r"https?://[^\s<>\"]+"), F.lit(0))
    return distinct_folded(F.transform(F.concat(linked, plain), lambda u: F.regexp_replace(u, TRAILING, "")))


def domain(url: Column) -> Column:
    """Host of an http(s) URL in lower case, without user or port."""
    return blank_to_null(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)))


def url_key(url: Column) -> Column:
    """Key under which URLs count as one: scheme, host without www., no default port, path, query."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]+)", 1)), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    rest = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^#]*)", 1)
    return F.struct(scheme.alias("scheme"), host.alias("host"), rest.alias("rest"))


def fingerprint(text: Column, escaped: bool = False) -> Column:
    """SHA-256 of the text with white space collapsed; null where nothing is left. Case counts."""
    plain = unescape(text) if escaped else text
    return F.sha2(blank_to_null(F.regexp_replace(plain, r"\s+", " ")), 256)


def trend_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), r"\s+", "-")


def slug(label: Column) -> Column:
    """Lower case, only letters, digits and single hyphens, 80 characters at most."""
    kept = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(F.trim(kept), r"\s+", "-"), r"-+", "-")
    cut = F.substring(F.regexp_replace(joined, r"^-|-$", ""), 1, 80)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("unknown-trend"))


def clean_post(text: Column) -> Column:
    """Entities decoded up to three times, zero-width spaces dropped, removed posts as null."""
    plain = F.replace(unescape(unescape(unescape(text))), F.lit("​"), F.lit(""))
    return F.when(~F.trim(plain).isin("[removed]", "[deleted]"), plain)


def relevance(text: Column, keyword: Column) -> Column:
    """lexical: the whole keyword occurs; partial_lexical: one of its words does; else unknown."""
    t, k = F.lower(text), F.lower(F.trim(keyword))
    some = F.exists(F.split(k, r"\s+"), lambda w: t.contains(w))
    return F.when(t.contains(k), "lexical").when(some, "partial_lexical").otherwise("unknown")


def has_word(text: Column, word: Column) -> Column:
    """The word stands alone in the text, in any case."""
    quoted = F.regexp_replace(word, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), quoted, F.lit(r"\b")))


def reliable(text: Column) -> Column:
    """Enough running text for language detection: three words and fifteen characters besides tags, mentions, URLs."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~w.rlike(r"^(#|@|https?://)") & w.rlike(r"\p{L}"))
    return (F.size(words) >= 3) & (F.length(F.array_join(words, " ")) >= 15)


def prefixed(prefix: str, value: Column) -> Column:
    """prefix:value without doubling a prefix that is there."""
    return F.when(value.isNotNull(), F.when(value.startswith(f"{prefix}:"), value).otherwise(F.concat(F.lit(f"{prefix}:"), value)))


def node_id(platform: Column, value: Column) -> Column:
    """platform:id, with repeated platform prefixes cut; platform:unknown where nothing is left."""
    p = F.lower(F.trim(platform))
    bare = F.regexp_replace(F.trim(value), F.concat(F.lit("(?i)^("), p, F.lit(":)+")), F.lit(""))
    return F.concat(p, F.lit(":"), F.coalesce(F.nullif(bare, F.lit("")), F.lit("unknown")))


def username(handle: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(handle), "^@+", ""))


RELATIONS = {
    "follow": "follow", "follows": "follow", "like": "like", "likes": "like", "mention": "mention", "mentions": "mention",
    "reply": "reply", "replies": "reply", "quote": "quote", "quotes": "quote", "repost": "repost", "reposts": "repost", "share": "repost", "shares": "repost",
}


def relation_type(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])[F.lower(F.trim(name))]
