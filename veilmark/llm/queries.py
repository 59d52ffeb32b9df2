"""The ten operators as queries over the whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm import bit_sliced, mixing, near_dedup, page_text, quality_classifier, quality_rules, repeats, sentence_pieces, surrogates, token_counts
from veilmark.llm.common import table

#: The tokenizer's file; its place is a parameter of the environment.
TOKENIZER = "piece_bpe_32k.model"


#: The secret of the surrogates; who knows it can test guesses, so real runs set their own.
KEY = os.environ.get("VEILMARK_KEY", "veilmark-test-key")


def model_file() -> str:
    if "VEILMARK_TOKENIZER" in os.environ:
        return os.environ["VEILMARK_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), model_file())


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_file())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"), KEY)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mixing, op2_sentence_pieces, op3_repeated_passages, op4_token_counts, op5_near_dedup, op6_quality_classifier, op7_surrogates, op8_exact_top_k, op9_page_text, op10_quality_rules)}

ORACLES: dict[str, str] = {"op1_source_mixing": mixing.SQL.format(columns="doc_id, text, lang, drawn.source, n_chars"), "op5_near_dedup": near_dedup.SQL, "op8_exact_top_k": bit_sliced.SQL}
