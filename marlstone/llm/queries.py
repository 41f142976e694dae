"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import (
    bestfit_packing,
    chat_formatting,
    exact_dedup,
    exact_topk,
    jaccard_join,
    language_id,
    quality_classifier,
    sentencepiece_codec,
    simhash_neardup,
    spelling_variants,
    suffix_tree_lm,
    url_filters,
)
from marlstone.sources.tables import table

try:
    import public_tokenizers
except ImportError:  # then the caller names the files
    public_tokenizers = None

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in $MARLSTONE_TOKENIZERS if set, else in the installed package."""
    folder = os.environ.get("MARLSTONE_TOKENIZERS")
    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.components_of(table(spark, sf_dir, "documents"))


def op3_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat_formatting.tool_records(table(spark, sf_dir, "conversations"))
    return chat_formatting.format_turns(records, chat_formatting.DIALOGUE)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece_codec.encode_and_decode(table(spark, sf_dir, "documents"), model)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"), spoil=True)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_simhash_neardup": op2_simhash_neardup,
    "op3_bestfit_packing": op3_bestfit_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_language_id": op6_language_id,
    "op7_url_filters": op7_url_filters,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_jaccard_join": op12_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op4_chat_formatting": chat_formatting.ORACLE_SQL,
    "op1_exact_topk": exact_topk.ORACLE_SQL,
    "op7_url_filters": url_filters.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_spelling_variants": spelling_variants.ORACLE_SQL,
    "op12_jaccard_join": jaccard_join.ORACLE_SQL,
}
