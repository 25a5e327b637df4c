"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import decontam, langid, licenses, linededup, media, merkle, mixing, records, sharding, simhash, surrogate, toxicity, variants
from lociflow.llm.shared import materialise, scratch, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a FLAC stream, read back as PCM blocks; null texts are empty, one row for each row of ``documents``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return media.media_digest(media.encode_flac(docs))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every whole text; texts without a known sentence, null and empty ones included, give no row."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learnt from the rows that are not held out; null texts and texts without letters are ``und``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out("doc_id")))
    out = langid.predict(docs, model)
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the three-line windows that an earlier place has; null texts stay null, one row for each row of ``documents``."""
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold part of a benchmark item, with the best window; others, null and empty ones included, give no row."""
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for every whole text; null and empty texts are scored as texts without words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, toxicity.label_columns(_table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    return chain.score(docs).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("toxic"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, starts and checksums read back from the record files of all texts; null texts are empty, rows without an id are left out."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    with scratch(spark):
        folder = scratch_path(spark, "token-records")
        records.write_token_records(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
        return materialise(records.read_token_records(spark, folder), "token-digests", keep=True)


def op8_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to source, language and topic targets; null values of a dimension are ``unknown``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"), mixing.topic(F.col("text")).alias("topic"), mixing.token_count(F.col("text")).alias("n_tokens"))
    out = mixing.mix(docs, {d: F.col(d) for d in MIX}, MIX, F.col("n_tokens"))
    return out.withColumn("probability", F.round("probability", 6))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by surrogates; null texts stay null, one row for each row of ``documents``."""
    return surrogate.anonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="lociflow")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all whole texts with their frequent neighbour and its last one; null and empty texts have no words."""
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, whole texts shuffled; a null text has size 1, one row for each row of ``documents``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    with scratch(spark):
        sent = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))
        out = sent.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
        return materialise(out, "shards", keep=True)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and tamper check of every document, by source; null fields are ``-``, one row for each row of ``documents``."""
    return merkle.manifest(_table(spark, sf_dir, "documents"))


#: Targets of the mix: equal sources, given shares of two languages (the others divide the rest as they are), tempered topics.
MIX = {"source": 0.0, "lang": {"en": 0.4, "de": 0.25}, "topic": 0.5}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_flac_media, op2_license_scan, op3_language_id, op4_line_dedup, op5_benchmark_decontamination, op6_toxicity, op7_token_records, op8_mixing_weights, op9_pii_surrogates, op10_simhash_near_dedup, op11_spelling_variants, op12_hypergeometric_shards, op13_merkle_manifest)
}

ORACLES: dict[str, str] = {"op2_license_scan": licenses.oracle_sql(), "op4_line_dedup": linededup.oracle_sql(), "op8_mixing_weights": mixing.oracle_sql(MIX), "op11_spelling_variants": variants.oracle_sql(), "op13_merkle_manifest": merkle.oracle_sql()}
