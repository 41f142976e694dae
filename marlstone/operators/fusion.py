"""Reciprocal-rank fusion of a dense and a sparse hit list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import top_k

RRF_K = 60
MODES = ("dense", "sparse", "hybrid")


def fuse(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """query_id, rank, chunk_id, score, dense_score, sparse_score of hit lists (query_id, rank,
    chunk_id, score). Hits of one list that repeat add up; ties go to the dense list's order."""

    def leg(hits: DataFrame, name: str) -> DataFrame:
        return hits.groupBy("query_id", "chunk_id").agg(
            F.sum(1.0 / (rrf_k + F.col("rank"))).alias(f"{name}_part"), F.min("rank").alias(f"{name}_rank"), F.max_by("score", -F.col("rank")).alias(f"{name}_score")
        )

    both = leg(dense, "dense").join(leg(sparse, "sparse"), ["query_id", "chunk_id"], "full")
    zero = F.lit(0.0)
    scored = both.select(
        "query_id", "chunk_id", "dense_rank", "sparse_rank",
        F.round(F.coalesce("dense_part", zero) + F.coalesce("sparse_part", zero), 9).alias("score"),
        F.coalesce("dense_score", zero).alias("dense_score"),
        F.coalesce("sparse_score", zero).alias("sparse_score"),
    )
    order = [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")]
    return top_k(scored, ["query_id"], order, k).select("query_id", "rank", "chunk_id", "score", "dense_score", "sparse_score")


def retrieve(mode: str, dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """The hits of one mode; both legs hold the same k."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    if mode == "hybrid":
        return fuse(dense, sparse, k)
    return dense if mode == "dense" else sparse
