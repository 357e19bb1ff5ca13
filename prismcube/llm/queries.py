"""The queries of the ten operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: The public vocabulary file of operator 4.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import scan_contamination

    found = scan_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), MODEL, digests=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import verdicts

    return verdicts(table(spark, sf_dir, "documents")).drop("failed_rule")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_loss, read_turns

    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(turns).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("segments")).alias("loss"))
    said_by = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(said_by.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import suffix_array_dedup

    found = suffix_array_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify_language

    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, fit(docs))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs))


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_minhash": op3_minhash,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality_rules": op5_quality_rules,
        "op6_chat_format": op6_chat_format,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_language_id": op9_language_id,
        "op10_lm_score": op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
