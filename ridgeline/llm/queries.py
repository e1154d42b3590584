"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import spread

from .chat import chat_sql
from .common import table
from .mixing import mixing_sql
from .pages import pages_sql
from .suffixes import suffix_sql
from .twins import base_counts_sql, base_score_sql, payload_sql


def piece_model() -> str:
    """Place of the vocabulary, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_report

    return simhash_report(spread(table(spark, sf_dir, "documents")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_report

    return mixed_report(spread(table(spark, sf_dir, "documents")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup_report

    return dedup_report(spread(table(spark, sf_dir, "documents")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encoded

    return encoded(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), piece_model())


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scoring import score_report

    return score_report(spread(table(spark, sf_dir, "documents")))


def op4_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audio import media_report

    return media_report(spread(table(spark, sf_dir, "documents")))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_report

    return chat_report(table(spark, sf_dir, "conversations"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(spread(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_report

    return toxicity_report(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import page_report

    return page_report(spread(table(spark, sf_dir, "pages")))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3's rows."""
    return op3_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def audio_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4's rows."""
    return op4_telephony_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8's rows."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_source_mixing": op2_source_mixing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_telephony_audio": op4_telephony_audio,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_html_extraction": op10_html_extraction,
    "lm_base_scores": lm_base_scores,
    "audio_payloads": audio_payloads,
    "quality_base_counts": quality_base_counts,
}
ORACLES: dict[str, str] = {
    "op2_source_mixing": mixing_sql(),
    "op5_suffix_dedup": suffix_sql(),
    "op7_chat_formatting": chat_sql(),
    "op10_html_extraction": pages_sql(),
    "lm_base_scores": base_score_sql(),
    "audio_payloads": payload_sql(),
    "quality_base_counts": base_counts_sql(),
}
