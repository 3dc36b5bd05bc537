"""The corpus operators' queries, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from citeloom.llm import ann, bpe, chat, conversation, decontaminate, egojoin, lm, packing, quality, secrets, simhash, spelling, suffix
from citeloom.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ``embeddings`` that chain by cosine 0.9 or more."""
    return egojoin.group(table(spark, sf_dir, "embeddings"), 0.9)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` in sequences of at most 1024 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of ``embeddings`` found for each row whose id is divisible by 50."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as a linked, validated and serialised tool message."""
    return chat.link(chat.from_turns(table(spark, sf_dir, "conversations")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` to ids and back, by the ranks of a public vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts of ``documents`` whose fingerprints chain by 2 or fewer differing bits."""
    found = simhash.group(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents``, learnt from two folds of ``labels.quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = quality.fold("doc_id", 3)
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", fold != 1)
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored by models learnt from four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality.fold("doc_id", 5) == 1
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = lm.score(docs, path, public_tokenizers.PATTERN, ~F.coalesce(held_out, F.lit(False)), every_id=True)
    return found.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of 400 bytes that occur again leave of every text of ``documents``, and what repeated strings of 50 words cover there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix.strip(docs, 400, words=50, apart=True)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_passage_bytes"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged by a checksum, with its faults and cheapest repair."""
    return conversation.repair(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` with the words one edit away and the form that they are a variant of."""
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` against all windows of ten words of ``benchmark``."""
    return decontaminate.digests(decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_packing": op3_packing,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_chat_format": op5_chat_format,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_quality": op8_quality,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.ORACLE}
