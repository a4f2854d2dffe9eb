"""The operators' queries over whole tables with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import contamination, language, licenses, near_text, near_vectors, packing, private, records, urls, warc
from chunkloom.sources.tables import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(_table(spark, sf_dir, "pages"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_records(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identified(docs, language.fit(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.findings(_table(spark, sf_dir, "documents"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_minhash_near_dedup, op2_embedding_near_dedup, op3_url_filter, op4_token_records, op5_license_scan, op6_packing, op7_language_id, op8_decontamination, op9_pii, op10_warc_index, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_near_dedup": near_vectors.ORACLE,
        "op3_url_filter": urls.oracle(),
        "op8_decontamination": contamination.ORACLE,
        "op10_warc_index": f"""
            SELECT page_id, url, urlkey, length(html) AS html_chars, md5(html) AS html_md5
            FROM (SELECT page_id, url, html, {warc.ORACLE_KEY} AS urlkey FROM pages) WHERE urlkey IS NOT NULL""",
    }
