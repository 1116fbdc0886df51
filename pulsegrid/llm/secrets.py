"""Secret scans with an incremental blob ledger.

Every text version is content-addressed by its SHA-256. A ledger row (blob, rule_version) says that those rules
have seen that blob, so a run scans only unseen pairs; findings are kept by blob and joined back to every path
(document) that holds the blob. Only DataFrame functions are used.

Positions are code points. They come from splitting a text by a pattern: a match starts after the pieces and
matches before it.

Nulls: a null text is the empty text; a null doc_id is a path like any other. Repeated rows give repeated rows.
Very long texts are read whole: a text without any hint of a rule costs one pass of it, others an array of their matches.
An empty table gives an empty result. Other columns of the input are passed through; blob and spans are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import documents, materialize, text_or_empty


@dataclass(frozen=True)
class Rule:
    """kind; pattern; the group whose length counts; the least length; a cheap pattern that every match contains."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


RULE_VERSION = "base-1"
# The last two patterns ask for the least length themselves: runs are greedy, so the same spans are found as by longer-or-shorter runs of which the short are dropped.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)

SPAN = "struct<kind:string,start:long,end:long,ord:int>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of spans of a rule's leftmost non-overlapping matches that pass its length, in order."""
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(pieces.alias("p"), matches.alias("m"), counted.alias("g"))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["p"])
        end = start + F.coalesce(F.length(part["m"]), F.lit(0))
        span = F.struct(F.lit(rule.kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(order).alias("ord"))
        keep = F.length(part["g"]) >= rule.least
        return F.struct(end.cast("long").alias("at"), F.when(F.coalesce(keep, F.lit(False)), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found")), step)["found"]
    return F.when(text.rlike(rule.hint), found).otherwise(empty)


def blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """The input's rows with the content address of their text in column blob."""
    return versions.withColumn("blob", F.sha2(text_or_empty(text), 256))


def unseen(addressed: DataFrame, ledger: DataFrame | None, rule_version: str, text: str = "text") -> DataFrame:
    """(blob, text) of every distinct blob that these rules have not scanned."""
    todo = addressed.groupBy("blob").agg(F.first(text_or_empty(text)).alias("text"))
    if ledger is not None:
        todo = todo.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return todo


def scan(todo: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of the given blobs; spans by start, then rule order."""
    spans = F.concat(*[spans_of(F.col("text"), r, i) for i, r in enumerate(rules)])
    ordered = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))),
        lambda s: F.struct(s["kind"], s["start"], s["end"], s["ord"]),
    )
    return todo.select("blob", F.lit(rule_version).alias("rule_version"), ordered.cast(f"array<{SPAN}>").alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(addressed rows with their spans, the ledger with this run's rows). Blobs in the ledger are not scanned again."""
    addressed = blobs(versions.drop("spans"), text)
    fresh = materialize(scan(unseen(addressed, ledger, rule_version, text), rules, rule_version), "secret-ledger")
    whole = fresh if ledger is None else ledger.unionByName(fresh)
    # only blobs with findings travel to the paths; the others have none
    findings = whole.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    found = addressed.join(findings, "blob", "left")
    return found.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))), whole


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal run of overlapping spans replaced by the mark."""

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_versions(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(render(F.col("spans")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"), "blob",
    )


def _oracle(kind: str, least: int, order: int) -> str:
    return f"""list_filter(list_transform(range(1, len(m{order}) + 1), lambda i: struct_pack(
      s := list_sum(list_transform(p{order}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{order}[1:i-1], lambda x: length(x))), 0),
      o := {order}, n := length(m{order}[i]), k := '{kind}', g := length(g{order}[i]))), lambda x: x.g >= {least})"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS (SELECT doc_id, t, {", ".join(f"string_split_regex(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') AS p{i}, regexp_extract_all(t, '{r.pattern.replace(chr(39), chr(39) * 2)}', 0) AS m{i}, regexp_extract_all(t, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group}) AS g{i}" for i, r in enumerate(RULES))} FROM d),
f AS (SELECT doc_id, t, {", ".join(f"{_oracle(r.kind, r.least, i)} AS f{i}" for i, r in enumerate(RULES))} FROM r),
s AS (SELECT doc_id, t, len(f0) AS a, len(f1) AS b, len(f2) AS c,
  coalesce(array_to_string(list_transform(list_sort(list_concat(list_concat(f0, f1), f2)), lambda x: x.k || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT)), ','), '') AS spans FROM f)
SELECT doc_id, CAST(a AS BIGINT) AS n_assign, CAST(b AS BIGINT) AS n_access, CAST(c AS BIGINT) AS n_hex, sha256(spans) AS base_sha256, spans, sha256(t) AS blob FROM s
"""
