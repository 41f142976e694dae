"""Queries of search: term statistics, BM25, dense, fusion, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import bm25, dense, fusion
from marlstone.sources.corpus import PAGES_SQL, pages
from marlstone.sources.tables import table

TOP = 20
QUESTION = "the thing and thion of la der que"


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: each benchmark text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, embedding: every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def term_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(pages(spark, sf_dir)).terms


def corpus_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(pages(spark, sf_dir)).stats.withColumn("avgdl", F.round("avgdl", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pages(spark, sf_dir)
    asked = spark.createDataFrame([(0, QUESTION)], "query_id long, query string")
    return bm25.search(bm25.build(chunks), asked, chunks, TOP).drop("query_id")


def bm25_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = pages(spark, sf_dir)
    return bm25.search(bm25.build(chunks), benchmark_queries(spark, sf_dir), chunks, 5)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    asked = rows.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(rows, asked, 10)


def dense_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 10)


def rrf_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector query also asks for the document with its id."""
    chunks = pages(spark, sf_dir)
    asked = vector_queries(spark, sf_dir)
    worded = chunks.join(asked.select(F.col("query_id").alias("row_id")), "row_id").select(F.col("row_id").alias("query_id"), F.col("text").alias("query"))
    sparse = bm25.search(bm25.build(chunks), worded, chunks, TOP)
    near = dense.search(vectors(spark, sf_dir), asked, TOP)
    named = near.join(chunks.select(F.col("row_id").alias("vec_id"), "chunk_id"), "vec_id")
    return fusion.retrieve("hybrid", named, sparse, 10)


QUERIES = {f.__name__: f for f in (term_doc_freq, corpus_token_stats, bm25_topk, bm25_batch_topk, dense_topk, dense_batch_topk, rrf_hybrid_topk)}

TOKENS = "list_filter(regexp_extract_all(lower({}), '[A-Za-zА-Яа-яЁё0-9]+'), lambda t: length(t) >= 2)"
INDEX_SQL = f"""{PAGES_SQL}, tokenised AS (
  SELECT chunk_id, page_num, {TOKENS.format("text")} AS tokens FROM pages_view
), postings AS (
  SELECT chunk_id, token, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS token FROM tokenised) GROUP BY 1, 2
), terms AS (
  SELECT token, count(*) AS df FROM postings GROUP BY 1
), stats AS (
  SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl, sum(len(tokens))::BIGINT AS n_tokens FROM tokenised
)"""
SCORED_SQL = """query_terms AS (
  SELECT query_id, token, count(*) AS qcount FROM (SELECT query_id, unnest(tokens) AS token FROM asked) GROUP BY 1, 2
), scored AS (
  SELECT query_id, chunk_id, round(sum(qcount * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
         / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM query_terms JOIN postings USING (token) JOIN terms USING (token), stats GROUP BY 1, 2
), sparse_hits AS (
  SELECT query_id, chunk_id, page_num, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_num, chunk_id)::INTEGER AS rank
  FROM scored JOIN pages_view USING (chunk_id) WHERE score > 0
)"""
BENCHMARK_SQL = f"asked AS (SELECT item_id AS query_id, {TOKENS.format('text')} AS tokens FROM benchmark)"
DENSE_SQL = """norms AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), dense_scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM norms q, norms v WHERE {}
), dense_hits AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM dense_scored
)"""
HYBRID_SQL = f"""WITH {INDEX_SQL}, asked AS (
  SELECT row_id AS query_id, {TOKENS.format("text")} AS tokens
  FROM pages_view WHERE row_id % 100 = 0 AND row_id IN (SELECT vec_id FROM embeddings)
), {SCORED_SQL}, {DENSE_SQL.format("q.vec_id % 100 = 0")}, d AS (
  SELECT query_id, chunk_id, h.rank, h.score FROM dense_hits h JOIN pages_view p ON p.row_id = h.vec_id WHERE h.rank <= {TOP}
), s AS (SELECT query_id, chunk_id, rank, score FROM sparse_hits WHERE rank <= {TOP}
), fused AS (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dr, s.rank AS sr,
         round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score,
         coalesce(d.score, 0) AS dense_score, coalesce(s.score, 0) AS sparse_score
  FROM d FULL JOIN s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST)::INTEGER AS rank FROM fused
)
SELECT query_id, rank, chunk_id, score, dense_score, sparse_score FROM r WHERE rank <= 10"""

ORACLES = {
    "term_doc_freq": f"WITH {INDEX_SQL} SELECT token, df FROM terms",
    "corpus_token_stats": f"WITH {INDEX_SQL} SELECT n_docs, round(avgdl, 6) AS avgdl, n_tokens FROM stats",
    "bm25_topk": f"WITH {INDEX_SQL}, asked AS (SELECT 0 AS query_id, {TOKENS.format(repr(QUESTION))} AS tokens), {SCORED_SQL} SELECT rank, chunk_id, page_num, score FROM sparse_hits WHERE rank <= {TOP}",
    "bm25_batch_topk": f"WITH {INDEX_SQL}, {BENCHMARK_SQL}, {SCORED_SQL} SELECT query_id, rank, chunk_id, page_num, score FROM sparse_hits WHERE rank <= 5",
    "dense_topk": f"WITH {DENSE_SQL.format('q.vec_id = 0')} SELECT query_id, rank, vec_id, score FROM dense_hits WHERE rank <= 10",
    "dense_batch_topk": f"WITH {DENSE_SQL.format('q.vec_id % 100 = 0')} SELECT query_id, rank, vec_id, score FROM dense_hits WHERE rank <= 10",
    "rrf_hybrid_topk": HYBRID_SQL,
}
