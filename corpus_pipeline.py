"""Corpus pipeline: stages applied to ``documents``, each written and read again.

1. documents that the quality classifier rejects go;
2. of each group of near-duplicates (five-word shingles with a Jaccard similarity
   of 0.8 or more, found by SimHash and shared heads) one document stays;
3. what strings of 400 bytes, or of 50 words, that occur again cover is cut out of the texts;
4. secrets are replaced by the names of their kinds;
5. what is left is packed in windows of 1024 ids.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import packing, quality, secrets, simhash, suffix
from citeloom.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels.quality``, accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", quality.fold("doc_id", 3) != 1)
    return quality.score(docs, model).filter("quality_score >= 0.5").drop("quality_score")


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates."""
    return simhash.first_of_each(docs, shingle=5, similarity=Fraction(4, 5))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 400 bytes or 50 words that also occur elsewhere, cut at whole characters."""
    columns = docs.columns
    found = suffix.strip(docs, 400, whole_characters=True, words=50).withColumn("text", F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8")))
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by the name of its kind."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, placed in windows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", keep_first_of_near_copies),
    ("suffix_array_dedup", cut_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
