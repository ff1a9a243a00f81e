"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, language_id, media_columns, merkle, minhash, ngram_quality, source_mix, spelling, suffix_dedup, toxicity, url_rules, warc
from .common import shared_dir, short_batches, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op3_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.quality_report(table(spark, sf_dir, "documents"), ngram_quality.trusted_of(table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_features(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/media-{uuid.uuid4().hex}")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_rows(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _bounded(f):
    """f in a session with short Arrow batches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(short_batches(spark), sf_dir)

    return query


def queries() -> dict:
    return {f.__name__: _bounded(f) for f in (op1_decontaminate, op2_suffix_dedup, op3_ngram_quality, op4_language_id, op5_url_rules, op6_media_columns, op7_toxicity, op8_source_mix, op9_warc, op10_jaccard_join, op11_spelling_variants, op12_minhash_dedup, op13_merkle_manifest, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op5_url_rules": url_rules.ORACLE,
        "op8_source_mix": source_mix.ORACLE,
        "op9_warc": warc.ORACLE,
        "op10_jaccard_join": jaccard_join.ORACLE,
        "op11_spelling_variants": spelling.ORACLE,
        "op12_minhash_dedup": minhash.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
