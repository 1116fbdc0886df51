from __future__ import annotations

import random

import corpus_pipeline as pipeline
from pulsegrid.llm import registry
from pulsegrid.llm.shared import materialize

DICE = random.Random(4)
WORDS = ["".join(DICE.choice("abcdefgh") for _ in range(DICE.randint(2, 8))) for _ in range(900)]


def write(spark, path):
    docs, labels = [], []
    for i in range(400):
        t = [DICE.choice(WORDS) for _ in range(50)]
        if i % 10 == 0:
            t[3:6] = ["zorgo", "zorgix", "zorgat"]
        if i % 25 == 1:
            t[7] = "password=hunter2hunter2"
        docs.append((i, " ".join(t), "en", f"s{i % 4}", 0, "extra"))
        labels.append((i, 1, int(i % 10 == 0)))
    docs += [(1000 + i, docs[i][1] + " end", "en", "s1", 0, "extra") for i in range(1, 40, 2)] + [docs[2], (None, None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, gone string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    write(spark, tmp_path)
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), f"test-{name}")
        after[name] = docs
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in after.items()}
    toxic = {i for i in range(400) if i % 10 == 0}
    assert not toxic & set(ids["toxicity"]) and set(ids["toxicity"]) >= set(range(400)) - toxic
    assert sorted(x for x in ids["near_duplicates"] if x is not None) == sorted(set(range(400)) - toxic)  # near copies and the repeated row are gone
    assert sorted(map(str, ids["secrets"])) == sorted(map(str, ids["near_duplicates"]))
    texts = [r["text"] for r in after["secrets"].select("text").collect() if r["text"]]
    assert not any("hunter2" in t for t in texts) and sum("[SECRET]" in t for t in texts) == len([i for i in range(400) if i % 25 == 1 and i not in toxic])
    assert set(ids["mixing"]) <= set(ids["secrets"]) and len(ids["mixing"]) > len(set(ids["mixing"]))
    assert sorted(map(str, ids["packing"])) == sorted(map(str, ids["mixing"]))
    assert pipeline.run(spark, str(tmp_path)).count() == len(ids["packing"])


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.queries())
    assert numbers == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_near_duplicate_stage_loses_no_unlike_text(spark):
    dice = random.Random(9)
    long = " ".join(dice.choice(WORDS) for _ in range(99))
    near = long.replace(long.split(" ")[50], "otherwise", 1)
    other = " ".join(dice.choice(WORDS) for _ in range(40))
    rows = [(3, long), (5, long), (5, other), (None, near), (None, near), (None, other + " x y z w v u t s r q p o n m"), (8, ""), (8, ""), (None, None), (9, other + " z"), (5, other)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect())
    assert left == sorted([("3", long), ("5", other), ("None", rows[5][1]), ("8", ""), ("8", ""), ("None", "")])


def test_an_empty_table_goes_through_every_stage(spark, tmp_path):
    write(spark, tmp_path / "full")
    none = spark.read.parquet(f"{tmp_path}/full/documents.parquet").limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    found = pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns)
