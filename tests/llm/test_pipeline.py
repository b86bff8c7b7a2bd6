import corpus_pipeline
from spanforge.llm import registry, suffix_dedup

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    assert before > kept[0] > kept[1] >= kept[2] == kept[3] and kept[4] >= kept[3]
    ids = spark.read.parquet(f"{tmp_path}/repeated_passages")
    assert {r[0] for r in ids.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert ids.where("n_chars <> length(text)").count() == 0


def test_repeated_passages_are_cut(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    draw = lambda n: "".join(rng.choice(list("abcdefgé "), n))
    passage, head = draw(150), draw(80)
    rows = [(1, head + passage, "en", "s", 230), (2, passage + "tail", "en", "s", 154), (None, "short", None, None, 5), (4, None, "en", "s", 0), (5, head + passage, "x", "y", 230), (5, head + passage, "x", "y", 230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted((r.doc_id or 0, r.text, r.n_chars) for r in suffix_dedup.without_repeats(spark, docs).collect() if r.text is not None)
    assert found == [(0, "short", 5), (1, head + passage, 230), (2, "tail", 4), (5, "", 0), (5, "", 0)]
    assert suffix_dedup.without_repeats(spark, docs).where("text is null").count() == 1
    assert suffix_dedup.without_repeats(spark, docs.limit(0)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
