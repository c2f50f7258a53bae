"""From raw documents to packed sequences: language ID, line dedup, near-duplicate join, secret scan, packing.

Each stage gets a DataFrame with the columns of ``documents`` and keeps them, but for the last, which lists where
each piece of each document is packed. A stage that changes a text sets ``n_chars`` to its length. Rows are not
changed otherwise.

Defined results: a null or empty text has no letter and is rejected by the first stage; rows that repeat are rows of their own,
but near duplicates leave only rows with the smallest id; extra columns pass through whatever their names; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import language_id, line_dedup, ngram_join, packing, secret_scan
from tidewatch.llm.tables import drop, release, scratch, written_at

#: A document whose language is less certain than this is rejected, as is one without a letter.
LEAST_SCORE = 0.3


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the rest (no letter, null, or too uncertain) goes."""
    found = language_id.scored_rows(docs)
    sure = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)
    return found.where(sure).select("kept.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their common lines; one that was nothing else stays, with an empty text."""
    found = line_dedup.deduped_rows(docs)
    columns = [F.col("line_dedup.kept").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return _resized(found.select(*columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; rows that repeat an id with it stay."""
    groups = ngram_join.similarity_components(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return _resized(secret_scan.redact_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table.

    Each result is written and read again. What a stage has staged on its way is dropped then, and so is the result before.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            path = written_at(result, name)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            drop(spark, before)
        before = path
        release(spark)
    return docs
