"""Registered queries of this subpackage, each over its whole table, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from takeup.llm import (alignment, chat, decontamination, mixing, oracle, pieces, pii, quality_model, quality_rules,
                        resampling, secrets, simhash, url_rules, warc)
from takeup.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


#: A conversation whose texts are made of the template's own markup.
ODD_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op1_chat_formatting", oracle.CHAT)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_CONVERSATION, rows.schema)
    return chat.chat_report(rows.unionByName(odd))


@query("op2_mix_to_weights", oracle.MIX)
def mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


@query("op3_pii_surrogates")
def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read_table(spark, sf_dir, "documents"))


@query("op4_quality_rules", oracle.QUALITY)
def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_report(read_table(spark, sf_dir, "documents"))
    return rows.drop("n_lines")


@query("op5_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


@query("op6_url_rules")
def url_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op8_warc_round_trip", oracle.ARCHIVE)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages")).drop("error")


@query("op9_benchmark_decontamination", oracle.CONTAMINATION)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return rows.drop("_k1", "_k2")


@query("op10_simhash_near_duplicates")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                                      vocabulary("piece_bpe_32k.model"))


@query("op12_sentencepiece_round_trip")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op13_importance_resampling", oracle.RESAMPLING)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("n_words")
