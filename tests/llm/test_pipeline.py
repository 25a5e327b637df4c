"""The pipeline's stages, each on all that the one before kept."""

import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import decontam, toxicity
from lociflow.llm.shared import materialise
from tests.llm.test_nearcopies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES[:4]:
        before = docs
        docs = materialise(stage(spark, docs, SF), "stage")
        kept.append((before, docs))
        assert docs.columns == columns and docs.join(before, columns[0], "left_anti").count() == 0 and docs.count() > 0
    one, two = kept[1]
    assert {r[0] for r in two.select("doc_id").collect()} == brute_kept({r["doc_id"]: r["text"] for r in one.collect()})
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.overlaps(kept[2][1], bench).count() == 0
    labels = toxicity.label_columns(spark.read.parquet(f"{SF}/labels.parquet")).filter("toxic = 1").select("doc_id")
    gone = kept[0][0].join(kept[0][1], "doc_id", "left_anti")
    assert gone.join(labels, "doc_id", "left_semi").count() >= 0.7 * kept[0][0].join(labels, "doc_id", "left_semi").count()
    p = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(p), 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = tok.encode(r["text"], add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in pipeline.STAGES[4][1](spark, docs, SF).collect()) == want


def test_mixing_draws_by_probability(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"), F.lit("en").alias("lang"), F.lit(13).cast("long").alias("n_chars"))
    out = pipeline.sample_mix(spark, docs, SF)
    by = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert by["rare"] == 2000 and abs(by["hot"] - 8000) < 250  # the rare source gives all it has, the other the rest of the budget


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "Some words of one text", "en", "a", 22), (3, "Some words of one text", "en", "a", 22), (4, "x " * 50_000, "de", "b", 100_000), (None, "A text without an id", "en", None, 20)]


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    """Nulls in every column, empty and very long texts, repeated rows, empty tables; each stage keeps clean documents."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, SF)
    n = {"toxicity": 6, "simhash near-dedup": 4, "benchmark decontamination": 6, "token-id output": 5}.get(name)
    assert out.count() == n if n else out.count() <= 6
    assert name == "token-id output" or out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0
