"""The pipeline's stages one after the other, against their operators by hand."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm_operators import docs, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 12)
    texts = [prose(rng, 60) for _ in range(1200)]
    texts[1] = texts[0]
    texts[2] = texts[0] + " tail"
    texts[3] = texts[3] + " " + item
    texts[4] = texts[4] + " password=hunter22"
    for k in range(5, 405):
        texts[k] = texts[k] + " vile"
    texts += [None, ""]
    d = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    d.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, int(5 <= k < 405)) for k in range(1200)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"
    now, kept = d, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == d.columns
        now.write.parquet(f"{sf}/{name.replace(' ', '_')}")
        now = spark.read.parquet(f"{sf}/{name.replace(' ', '_')}")
        kept.append({r.doc_id for r in now.collect()})
    assert not kept[0] & set(range(5, 405)) and {0, 1, 2, 3, 4, 1200, 1201} <= kept[0]
    assert kept[1] == kept[0] - {1, 2}
    assert kept[2] == kept[1] - {3} and kept[3] == kept[2]
    assert now.where("doc_id = 4").first().text.endswith(" [REDACTED]")
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == kept[3]
    assert out.where(F.col("offset") + F.col("length") > 4096).count() == 0


@pytest.mark.parametrize("rate", [0.1, 0.5])
def test_only_toxic_words_are_toxic(spark, tmp_path, rate):
    """Null, empty and unknown texts stay, whatever the labels' rate."""
    rng = random.Random(int(rate * 10))
    texts = [prose(rng, 40) + (" vile" if k < 600 * rate else "") for k in range(600)] + [None, "", "zzz qqq", " \n "]
    d = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    sf = f"file://{tmp_path}"
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k < 600 * rate)) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, d, sf).collect()}
    clean = set(range(int(600 * rate), 600))
    assert {600, 601, 602, 603} <= kept and not kept & set(range(int(600 * rate)))
    assert len(kept & clean) >= 0.99 * len(clean)  # a model's error, not a rule's


def test_pipeline_without_rows(spark, tmp_path):
    """No labels and no benchmark reject nothing; no documents give no sequences."""
    rng = random.Random(31)
    sf = f"file://{tmp_path}"
    d = docs(spark, [prose(rng, 30) for _ in range(20)] + [None]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, df in (("documents", d), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{sf}/{name}.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(range(21))
    (tmp_path / "none").mkdir()
    d.limit(0).write.parquet(f"{sf}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{sf}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{sf}/none").count() == 0
