"""The engine: build an index of a corpus once, then search it and ask it in batches of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.names import source_url
from marlstone.operators import answer, bm25, chunk, clean, dense, fusion, graph, models, registry
from marlstone.scratch import materialize, ship

MODES = (*fusion.MODES, "graph")


@dataclass
class Index:
    """Tables of a corpus. vectors (vec_id, embedding, chunk_id) may be missing: then only sparse
    search is possible. nodes is the chunk graph by runs of pages."""

    chunks: DataFrame
    terms: bm25.Bm25Index
    nodes: DataFrame
    vectors: DataFrame | None = None


def build_index(pages: DataFrame, vectors: DataFrame | None = None, files: DataFrame | None = None, min_ratio: float = clean.MIN_RATIO) -> Index:
    """From raw pages (doc_id, title, source_pdf, page_num, text): cleaned, cut into chunks, enriched
    from the registry `files`, with term statistics and the chunk graph."""
    ship(pages.sparkSession)
    lined = materialize(clean.page_lines(pages), "lines")
    texts = clean.cleaned(lined, clean.repeated_lines(lined, min_ratio)).select("doc_id", "page_num", "text")
    named = pages.select("doc_id", "title", "source_pdf", "page_num").join(texts, ["doc_id", "page_num"])
    return index_chunks(chunk.chunked(named), vectors, files)


def index_chunks(chunks: DataFrame, vectors: DataFrame | None = None, files: DataFrame | None = None) -> Index:
    """From ready chunks (doc_id, title, source_pdf, page_num, page_start, page_end, chunk_id, text):
    enriched from the registry `files`, with term statistics and the chunk graph."""
    ship(chunks.sparkSession)
    chunks = registry.points(chunks)
    if files is not None:
        chunks = registry.enrich(chunks, files)
    chunks = materialize(chunks, "chunks")
    index = bm25.build(chunks)
    index = bm25.Bm25Index(materialize(index.postings, "postings"), materialize(index.terms, "terms"), materialize(index.stats, "stats"), index.rows)
    narrow = chunks.select("doc_id", "page_num", "chunk_id")
    nodes = materialize(graph.runs(narrow), "nodes")
    return Index(chunks, index, nodes, vectors)


def save(index: Index, path: str) -> None:
    tables = {"chunks": index.chunks, "postings": index.terms.postings, "terms": index.terms.terms, "stats": index.terms.stats, "nodes": index.nodes}
    if index.vectors is not None:
        tables["vectors"] = index.vectors
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load(spark: SparkSession, path: str, with_vectors: bool = True) -> Index:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{path.rstrip('/')}/{name}")

    ship(spark)
    return Index(read("chunks"), bm25.Bm25Index(read("postings"), read("terms"), read("stats")), read("nodes"), read("vectors") if with_vectors else None)


def search(index: Index, queries: DataFrame, mode: str = "hybrid", k: int = 5) -> DataFrame:
    """query_id, rank, chunk_id, score and the chunk's columns, for queries (query_id, query, and
    embedding but for sparse search)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    if mode != "sparse" and index.vectors is None:
        raise ValueError(f"{mode} search needs vectors")
    sparse = near = None
    if mode in ("sparse", "hybrid"):
        sparse = bm25.search(index.terms, queries, index.chunks, k).select("query_id", "rank", "chunk_id", "score")
    if mode != "sparse":
        found = dense.search(index.vectors, queries, k)
        near = found.join(index.vectors.select("vec_id", "chunk_id"), "vec_id").select("query_id", "rank", "chunk_id", "score")
    hits = graph.expand_runs(near, index.nodes, k) if mode == "graph" else fusion.retrieve(mode, near, sparse, k)
    return hits.join(index.chunks, "chunk_id")


def ask(index: Index, questions: DataFrame, mode: str = "hybrid", k: int = 5, answer_fn: answer.AnswerFn = answer.first_sentences, strict: bool = True, base_url: str | None = None, sign: models.SignFn | None = None) -> DataFrame:
    """query_id, answer, sources, retrieved for questions (query_id, query, embedding). Links to sources
    begin with base_url, or are signed by the caller's function."""
    hits = search(index, questions, mode, k)
    have = set(hits.columns)
    bucket, key, source = (F.col(c) if c in have else F.lit(None).cast("string") for c in ("s3_bucket", "s3_key", "source"))
    if sign and {"s3_bucket", "s3_key"} <= have:
        linked = materialize(models.signed_links(hits, sign), "hits")
    else:
        linked = materialize(hits.withColumn("url", source_url(base_url, bucket, key, source, F.col("page_start"))), "hits")
    return answer.envelopes(questions.select("query_id", F.col("query").alias("question")), linked, answer_fn, strict)
