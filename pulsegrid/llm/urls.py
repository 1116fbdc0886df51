"""URL filters: rule lists and gradient-boosted trees on lexical features.

A rule list decides what it fits; a gradient-boosted tree ensemble, trained from labelled URLs, decides the rest.
Features: lengths, depth, digit ratio, character entropy, parameter counts and statistics of the host suffix (how
often labelled URLs of that suffix are blocked, how common the suffix is). The labelled are dealt into FOLDS by a hash
of the url, and a labelled URL's share of blocked ones comes from the other folds, so neither its own label nor those
of its repeats are in it. Only DataFrame functions and Spark's own ML estimators are used.

Nulls: a null url, or one without ``://``, has empty host and path and is judged by the trees on its (empty)
features. Repeated rows, repeated keys and null keys are judged by their urls alone and give as many rows. Where no
labels exist, or all are of one kind, that kind (else allow) is the verdict. Very long urls are read whole. Equal lengths of fitting rules: the
smaller name. An empty table gives an empty result. Columns of the input other than the key and url are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.shared import documents, few, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most labelled rows that the trees are fitted on, and the trees' settings.
FIT_ROWS, TREES, DEPTH, SEED = 50_000, 20, 4, 7
#: A longer rule list than this is matched by a join.
INLINE_RULES = 256
#: Folds of the labelled URLs for their suffix statistics.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(found, whole, 1), UPPER, LOWER), F.regexp_extract(found, whole, 2)


def _best(fits: Column) -> Column:
    """The longest of an array of rules (length, rule, verdict); equal lengths: the smaller name."""
    return F.element_at(F.array_sort(F.transform(fits, lambda r: F.struct((-r["n"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))), 1)


def with_rules(urls: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """Adds fit: struct(n, rule, verdict) of the longest rule that fits host and path, else null.

    A rule list is a tuple (up to INLINE_RULES: one expression) or a DataFrame (host, path, verdict), joined on the
    host suffixes of the distinct pairs of host and path; a pair then carries at most the rules that fit it.
    """
    if isinstance(rules, tuple) and len(rules) <= INLINE_RULES:
        if not rules:
            return urls.withColumn("fit", F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
        listed = F.array(*[F.struct(F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("h"), F.lit(r.path).alias("p")) for r in rules])
        fits = F.filter(listed, lambda r: ((F.col("host") == r["h"]) | F.col("host").endswith(F.concat(F.lit("."), r["h"]))) & F.col("path").startswith(r["p"]))
        return urls.withColumn("fit", F.when(F.size(fits) > 0, _best(fits)))
    if isinstance(rules, tuple):
        rules = urls.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("p"), "verdict")
    hits = (
        urls.select("host", "path").distinct()
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .join(few(listed), "suffix")
        .where(F.col("path").startswith(F.col("p")))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length(F.concat("suffix", "p"))).alias("n"), F.concat("suffix", "p").alias("rule"), F.col("verdict"))).alias("fit"))
    )
    return urls.join(hits, ["host", "path"], "left")


def repeats_of(text: Column) -> Column:
    """The sum of n * log2(n) over the different code points of a text, n the number of each, from one pass over them in order."""
    characters = F.array_sort(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    closed = lambda run: F.when(run > 1, run * F.log2(run)).otherwise(0.0)

    def step(acc: Column, c: Column) -> Column:
        same = acc["last"] == c
        return F.struct(c.alias("last"), F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"), (acc["sum"] + F.when(same, 0.0).otherwise(closed(acc["run"]))).alias("sum"))

    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    return F.aggregate(characters, start, step, lambda a: a["sum"] + closed(a["run"]))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features; the suffix is the host's last two labels."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    size = F.greatest(n, F.lit(1)).cast("double")
    entropy = F.when(n > 0, F.log2(size) - repeats_of(url) / size).otherwise(0.0)
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    return urls.withColumns({
        "suffix": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."),
        "f_length": n.cast("double"), "f_host": F.length("host").cast("double"), "f_path": F.length("path").cast("double"),
        "f_depth": count(F.col("path"), "/"), "f_labels": F.size(labels).cast("double"), "f_dots": count(url, "."), "f_dashes": count(url, "-"),
        "f_digits": F.length(F.regexp_replace(url, r"[^0-9]", "")) / size, "f_entropy": entropy,
        "f_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "f_query": F.length(query).cast("double"),
        "f_fragment": F.when(F.instr(url, "#") > 0, 1.0).otherwise(0.0), "f_secure": F.when(url.startswith("https:"), 1.0).otherwise(0.0),
    })


FEATURES = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_dots", "f_dashes", "f_digits", "f_entropy", "f_params", "f_query", "f_fragment", "f_secure", "f_suffix_block", "f_suffix_common"]


def with_suffix_statistics(featured: DataFrame) -> DataFrame:
    """Adds, from all rows of a suffix, the smoothed share of blocked among the labelled of other folds, and how common
    the suffix is (log count). Rows without a label are in no fold: all labelled ones count for them."""
    fold = F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    placed = featured.withColumn("fold", fold)
    by = placed.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n_all"), *[F.count_if(F.col("fold") == k).alias(f"n_{k}") for k in range(FOLDS)],
        *[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("label"))), F.lit(0.0)).alias(f"b_{k}") for k in range(FOLDS)],
    )
    by = materialize(by, "url-suffixes")
    others = lambda c: sum((F.when(F.col("fold").eqNullSafe(k), 0).otherwise(F.col(f"{c}_{k}")) for k in range(FOLDS)), F.lit(0))
    # statistics are broadcast only where they are few; else a join that can split a hot suffix
    joined = placed.join(few(by), "suffix", "left")
    return joined.withColumns({"f_suffix_block": (others("b") + 1.0) / (others("n") + 2.0), "f_suffix_common": F.log1p("n_all")}).select(*featured.columns, "f_suffix_block", "f_suffix_common")


def score(urls: DataFrame, key: str, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Adds block_score (0 to 1) to rows (key, url, host, path, label: 1.0 block, 0.0 allow, else null).

    The trees are fitted on at most about fit_rows labelled rows, chosen by a hash of key and url; the suffix
    statistics and the scores cover all rows.
    """
    featured = lexical(urls.withColumn("label", F.col(label)))
    featured = materialize(with_suffix_statistics(featured), "url-features")
    kinds = featured.where("label is not null").groupBy("label").count().collect()  # at most two rows
    known = {r["label"]: r["count"] for r in kinds}
    if len(known) < 2:
        return featured.withColumn("block_score", F.lit(1.0 if known.get(1.0) else 0.0))
    share = min(1.0, fit_rows / sum(known.values()))
    sample = featured.where("label is not null").where(F.pmod(F.xxhash64(key, "url"), F.lit(1_000_000)) < int(share * 1_000_000))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    # a bounded table, in one sorted partition so that reruns fit the same trees
    fitted = materialize(sample.select("label", *FEATURES), "url-fit").coalesce(1).sortWithinPartitions("label", *FEATURES)
    if fitted.select("label").distinct().count() < 2:
        return featured.withColumn("block_score", F.lit(sum(k * v for k, v in known.items()) / sum(known.values())))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features").fit(vectors.transform(fitted))
    scored = model.transform(vectors.transform(featured))
    return scored.withColumn("block_score", F.element_at(vector_to_array("probability"), 2))


def judge(pages: DataFrame, key: str = "page_id", rules: tuple[Rule, ...] | DataFrame = RULES, labels: DataFrame | None = None, at_least: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, block_score) of every row.

    labels: (url, label 1.0 block / 0.0 allow) of known URLs; without it the URLs that rules decide are the labelled
    ones.
    """
    host, path = host_path(F.col("url"))
    urls = with_rules(pages.select(key, "url").withColumns({"host": host, "path": path}), rules)
    known = F.when(F.col("fit").isNotNull(), (F.col("fit")["verdict"] == "block").cast("double"))
    if labels is not None:
        given = labels.groupBy("url").agg(F.max("label").cast("double").alias("given"))
        urls = urls.join(few(given), "url", "left")
        known = F.col("given")
    scored = score(urls.withColumn("known", known), key, "known")
    verdict = F.coalesce(F.col("fit")["verdict"], F.when(F.col("block_score") >= at_least, "block").otherwise("allow"))
    return scored.select(key, "host", "path", F.col("fit")["rule"].alias("rule"), verdict.alias("verdict"), "block_score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"))
