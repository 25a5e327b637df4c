"""A corpus pipeline of five stages over ``documents``; its queries count as part of ``lociflow.llm``.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet in the shared folder and read again as the next one's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import decontam, mixing, nearcopies, records, toxicity
from lociflow.llm.queries import MIX
from lociflow.llm.shared import delete, materialise, scratch, scratch_path, shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, toxicity.label_columns(labels), toxicity.CATEGORIES)
    return chain.score(docs).filter(F.col("p_toxic") < toxicity.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return nearcopies.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities that are raked to source, language and topic targets."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}
    return mixing.mix(docs, dims, MIX, mixing.token_count(F.col("text"))).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all documents left, read back as (doc_id, start, n_tokens, ids_crc32)."""
    import public_tokenizers

    with scratch(spark):
        folder = scratch_path(spark, "token-records")
        records.write_token_records(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
        return materialise(records.read_token_records(spark, folder), "token-digests", keep=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", sample_mix),
    ("token-id output", write_tokens),
]

#: The first, second and last stage are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; a stage's table goes when the next one's is written, and only the last stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
