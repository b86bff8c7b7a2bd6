from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from spanforge.llm import common
from spanforge.llm import near_dedup as nd


def _files(df):
    return [Path(urlparse(f).path) for f in df.inputFiles()]


def test_staged_tables_have_no_files_beside_them(spark):
    df = spark.range(0, 1000, 1, 4).withColumns({"text": F.repeat(F.col("id").cast("string"), 50), "a": F.array("id", F.lit(None))})
    kept = common.staged(df, "plain")
    assert sorted(kept.collect()) == sorted(df.collect())
    folder = _files(kept)[0].parent
    assert len(_files(kept)) == 4 and {f.name for f in folder.iterdir()} == {f.name for f in _files(kept)} | {"_SUCCESS"}
    common.drop_staged(kept)
    assert not folder.exists()


def test_damage_to_a_staged_table_is_found(spark):
    kept = common.staged(spark.range(0, 5000, 1, 1).withColumn("x", F.rand(1)), "damaged")
    (file,) = _files(kept)
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        kept.agg(F.sum("x"), F.sum("id")).collect()


def test_small_tables_of_near_dedup_go_to_few_files(spark, monkeypatch):
    """Where partitions aren't merged, a table of some hundred rows was still written as one file for each of them."""
    files, real = {}, nd.staged

    def counted(df, name, number=None):
        out = real(df, name, number)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(nd, "staged", counted)
    texts = [" ".join(f"w{k // 3}x{j}" for j in range(60)) + f" end{k % 3}" for k in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {tuple(r) for r in nd.classes(docs).join(docs.select(nd.text_key(F.col("text")).alias("key"), "doc_id"), "key").select("doc_id", "class_id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {(k, k - k % 3) for k in range(600)}
    assert max(files["signatures"]) > 1 and {n for name in ("members", "candidates", "links") for n in files[name]} == {1}
