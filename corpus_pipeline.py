"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.

In every stage a document is a row, whatever its doc_id: null and repeated ids
are no special case.  Null, empty and very long texts are as the stages say,
null in any other column has no effect, an empty table gives an empty one, and
further columns of docs, whatever their names, are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, jaccard_join, piece_bpe, quality, secret_scan
from logloom.llm.runtime import shared_dir, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, trained on labels, rejects.

    A row is judged by its whole text alone, so repeated texts stay or go
    together; null and empty texts are judged by the model's bias.  Without
    labels all stay.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the least doc_id.

    Null ids come last, and of rows with one id that with the least hash stays;
    of equal rows any one.  Rows without words (null, empty, blank) link with
    nothing and all stay.
    """
    return jaccard_join.first_rows(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    Null and empty texts hold none; without benchmark items all stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text by a mark; n_chars follows where the text changes.  No row goes; a null text stays null."""
    return secret_scan.redacted(docs).select(*COLUMNS)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.  One row for each row; a null text counts as empty, which has the end id alone."""
    return piece_bpe.report(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("sentencepiece", tokenization),
]

#: Learning and encoding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; results between them go through the shared folder."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
