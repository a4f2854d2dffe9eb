"""From documents to training windows: five stages, each on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each stage's table to the session's shared
folder as Parquet and reads it again as the next one's docs.  A stage's table, and whatever tables the stage made on its way, go
when they are used up; what stays is the last one's, whose windows hold their tokens and need nothing else.  All stages but the last return the columns of
documents.  Nulls in any column, empty tables, repeated rows and extra columns are allowed, see each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import contamination, language, near_text, packing, private
from chunkloom.sources.tables import forget, importable, place, scratch, spread

#: The stages' decisions (learned languages, approximate search, redaction, packing) can't be expressed in SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the labelled languages; the model is fitted on a bounded sample of docs."""
    return language.accepted(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_text.without_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item of the benchmark."""
    return contamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts placeholders in place of personal data; all documents stay."""
    return private.redacted(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of near-equal numbers of tokens that hold every token of every document."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact_private),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs, old = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), ()
    for name, stage in STAGES:
        at = place(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(at)
        docs = spark.read.schema(made.schema).parquet(at)
        forget(*old)
        old = (docs,)
    return docs
