"""The numbered queries over the corpus tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutworks.llm import chat_format, decontamination, hard_negatives, html_text, kneser_ney, license_scan, packing, phrases, quality_rules, sentencepiece_bpe, simhash, substring_dedup, warc
from boutworks.runtime import read_table

CHAT_TOKENIZER = chat_format.ChatTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(read_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(read_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(read_table(spark, sf_dir, "conversations"), CHAT_TOKENIZER)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(read_table(spark, sf_dir, "pages"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.report(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"), packing.tokenizer_of(PACKING_TOKENIZER))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it takes this module's parameters

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pipeline, op1_license_scan, op2_sentencepiece, op3_quality_rules, op4_html_text, op5_chat_format, op6_warc, op7_kneser_ney, op8_simhash, op9_decontamination, op10_substring_dedup, op11_hard_negatives, op12_packing, op13_phrases)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.SQL, "op5_chat_format": chat_format.SQL, "op6_warc": warc.SQL, "op9_decontamination": decontamination.SQL, "op10_substring_dedup": substring_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_phrases": phrases.SQL}
