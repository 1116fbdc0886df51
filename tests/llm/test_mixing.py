from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from pulsegrid.llm import mixing


def docs(spark):
    rows = [(i, "w " * (1 + i % 17), ["b", "a", None][i % 3], "x") for i in range(1500)] + [(1, "w w", "a", "x"), (2, None, "c", "x"), (3, "", "a", "x"), (None, "w w w", "a", "x"), (4, "w " * 9000, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_targets_stop_at_three_times_and_share_the_rest():
    got = {s.source: s.target for s in mixing.targets({"a": 10, "b": 500, None: 90, "c": 0})}
    assert got["c"] == 0 and got["a"] == 30 and abs(sum(got.values()) - 600) < 1e-9
    assert list(got) == ["a", "b", "c", None]
    assert mixing.targets({"a": 0})[0].target == 0


def test_flow_is_maximal_and_spreads_repetitions():
    got = mixing.flow({("a",): 100, ("a", "b"): 100, ("b",): 50}, {"a": 150, "b": 300})
    assert sum(f["a"] for f in got.values() if "a" in f) == 150 and sum(f["b"] for f in got.values() if "b" in f) == 300
    passes = {p: sum(f.values()) / {("a",): 100, ("a", "b"): 100, ("b",): 50}[p] for p, f in got.items()}
    assert max(passes.values()) <= 2.0 + 1e-9  # 450 of 250 tokens: nobody needs a third pass


def test_every_source_comes_near_its_target_and_reruns_agree(spark):
    rows = mixing.sized(docs(spark))
    mix = mixing.plan_mix(rows)
    got = mixing.with_copies(rows, mix).select("doc_id", "source", "mix_size", "mix_copies")
    again = mixing.with_copies(rows, mixing.plan_mix(rows)).select("doc_id", "source", "mix_size", "mix_copies")
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    taken = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("t")).collect()}
    for s in mix.sources:
        assert abs(taken[s.source] - s.target) <= 0.02 * s.target + 1, s
    assert got.where("mix_copies > 3 or mix_size = 0 and mix_copies > 0").count() == 0 and got.count() == docs(spark).count()


def test_mixed_documents_repeat_rows_and_keep_columns(spark):
    mixed = mixing.mix_documents(docs(spark))
    assert mixed.columns == docs(spark).columns
    assert mixed.groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0] <= 6  # two equal rows at most


def test_overlapping_sources(spark):
    rows = spark.createDataFrame([(i, "w w w w", ["a", "b"] if i % 2 else ["a"]) for i in range(200)], "doc_id long, text string, of array<string>")
    sized = mixing.sized(rows.withColumn("source", F.lit("")), F.col("of"))
    mix = mixing.plan_mix(sized, weights=(1, 1), share=1.0)
    assert {s.source for s in mix.sources} == {"a", "b"}
    assert mixing.with_copies(sized, mix).agg(F.sum(F.col("mix_size") * F.col("mix_copies"))).first()[0] > 0


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_documents(none).count() == 0


def test_overlap_routing_decides_the_mix(spark):
    """Of 300 documents 100 are a's alone, 100 of both, 100 b's alone; a is to have 50 words more than its own."""
    rows = spark.createDataFrame([(i, "w " * 10, [["a"], ["a", "b"], ["b"]][i % 3]) for i in range(300)], "doc_id long, text string, of array<string>")
    sized = mixing.sized(rows.withColumn("source", F.lit("")), F.col("of"))
    mix = mixing.plan_mix(sized, weights=(1, 3), share=0.5)
    aims = {s.source: s.target for s in mix.sources}
    assert aims == {"a": 500.0, "b": 1500.0}
    routed = mixing.flow({("a",): 1000, ("a", "b"): 1000, ("b",): 1000}, {"a": 500, "b": 1500})
    assert sum(f.get("b", 0) for f in routed.values()) == 1500 and sum(f.get("a", 0) for f in routed.values()) == 500
    assert max(sum(f.values()) for f in routed.values()) <= 1000  # b's words come from both patterns: nothing is taken twice
    taken = mixing.with_copies(sized, mix)
    assert taken.agg(F.sum(F.col("mix_size") * F.col("mix_copies"))).first()[0] == 2000 and taken.agg(F.max("mix_copies")).first()[0] == 1


def test_flow_of_parts_equals_the_joint_flow():
    import random

    dice = random.Random(3)
    cost = lambda p, got: sum(sum(2 * k - 1 for k in range(1, 4) for _ in range(max(0, min(p[n], sum(f.values()) - (k - 1) * p[n])))) for n, f in got.items())
    for _ in range(20):
        patterns = {}
        for s in range(6):
            patterns[(s,)] = dice.randint(1, 30)
        for a, b in ((0, 1), (2, 3)):
            patterns[a, b] = dice.randint(1, 30)
        quotas = {s: dice.randint(0, 60) for s in range(6)}
        apart, joint = mixing.flow(patterns, quotas), mixing._joint_flow(patterns, quotas, 3)
        assert sum(sum(f.values()) for f in apart.values()) == sum(sum(f.values()) for f in joint.values())
        assert cost(patterns, apart) == cost(patterns, joint)


def test_many_documents_are_narrowed_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    rows = mixing.sized(docs(spark).unionByName(spark.createDataFrame([(9999, "w w w", "a", "x")] * 300, "doc_id long, text string, source string, size string")))
    mix = mixing.plan_mix(rows)
    found = mixing.with_copies(rows, mix)
    taken = {r["source"]: r["t"] for r in found.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("t")).collect()}
    for s in mix.sources:
        assert abs(taken[s.source] - s.target) <= 0.05 * s.target + 20, s
    assert found.where("mix_copies > 3").count() == 0 and found.where("doc_id = 9999").select("mix_copies").distinct().count() == 1


def test_every_part_goes_through_the_flow_in_tasks(spark):
    """Sources that share no document are parts of one pattern each; they take what the same flow gives them."""
    patterns = [("1", ("a",), 100), ("2", ("a", "b"), 100), ("3", ("b",), 50), ("4", ("c",), 40), ("5", ("d",), 0), ("6", (None,), 7)]
    quotas = {"a": 150, "b": 300, "c": 90, "d": 0, None: 30}
    assert sorted(Counter(mixing.connected([n for _, n, _ in patterns], quotas).values()).values()) == [1, 1, 1, 3]
    want = {t: divmod(sum(f.values()), size) if size else (0, 0) for (t, n, size), f in zip(patterns, mixing.flow({n: s for _, n, s in patterns}, quotas).values(), strict=True)}
    found = mixing.routed(spark, patterns, quotas, 3)
    assert {r["mix_pattern"]: (r["mix_passes"], r["mix_limit"]) for r in found.collect()} == want
    assert want["4"] == (2, 10) and want["6"] == (3, 0)
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().toString()


def test_columns_named_like_the_operators_own_stay(spark):
    table = docs(spark).withColumns({"mix_size": F.lit("kept"), "mix_row": F.lit(3), "mix_copies": F.col("text"), "mix_n": F.lit(None).cast("int")})
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns and mixed.where("mix_size <> 'kept' or mix_row <> 3 or mix_n is not null").count() == 0
    assert mixed.count() == mixing.mix_documents(docs(spark)).count()
