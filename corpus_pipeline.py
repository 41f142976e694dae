"""The corpus pipeline: each stage's documents are written and read again by the next.

Language ID drops texts that no model accepts; the quality classifier drops texts not likely to be
good; exact dedup and SimHash near-dedup (five-word shingles of similarity 0.8 or more) keep one
document of each group; packing returns the pieces of what is left, with their places in sequences.

Defined results: null, empty and letterless texts are rejected by the first stage. A null doc_id is
judged and packed like any other, and loses ties against one that is not null. Of repeated rows and of
equal texts one row stays. Texts of any length are read whole and packed whole, in pieces. An empty
table gives an empty result; without labels no document is likely to be good, so none stays. All
columns of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bestfit_packing, exact_dedup, language_id, quality_classifier, simhash_neardup
from marlstone.llm.queries import tokenizer_path
from marlstone.llm.runtime import materialize
from marlstone.sources.tables import table

#: The packing and the dedups have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_neardup.dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("exact_dedup", no_exact_copies),
    ("simhash_neardup", no_near_copies),
    ("bestfit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
