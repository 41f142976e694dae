"""The registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import answers, corpus_build, retrieval, streams
from marlstone.scratch import ship



def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(q) for name, q in (retrieval.QUERIES | corpus_build.QUERIES | answers.QUERIES | streams.QUERIES).items()}
ORACLES = retrieval.ORACLES | corpus_build.ORACLES | answers.ORACLES | streams.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all pages of the corpus."""
    return retrieval.bm25_topk(spark, sf_dir)
