"""The documents table as a corpus: a source is a book, its documents in order are the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.ranking import ranked
from marlstone.scratch import hinted, materialize, spread
from marlstone.sources.tables import table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, source_pdf, page_num, chunk_id, text, row_id of every document."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("text"), "source"))
    # Only sources and ids are shuffled to be numbered; texts meet the numbers in a join that is a
    # broadcast as long as the numbers' counted size allows it.
    ids = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("row_id"))
    numbers = hinted(materialize(ranked(ids, ["source"], ["row_id"], "page_num"), "numbers"), 64)
    return docs.join(numbers, ["source", "row_id"]).select(
        F.col("source").alias("doc_id"),
        F.col("source").alias("title"),
        F.concat("source", F.lit(".pdf")).alias("source_pdf"),
        "page_num",
        F.format_string("%s_p%04d_c%03d", "source", "page_num", F.lit(1)).alias("chunk_id"),
        "text",
        "row_id",
    )


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each page as chunks: doc_id, page_num, chunk_index, chunk_id, text."""
    lines = F.posexplode(F.split("text", "\n")).alias("at", "line")
    return (
        pages(spark, sf_dir)
        .select("doc_id", "title", "source_pdf", "page_num", lines)
        .select(
            "doc_id", "title", "source_pdf", "page_num",
            (F.col("at") + 1).alias("chunk_index"),
            F.format_string("%s_p%04d_c%03d", "doc_id", "page_num", F.col("at") + 1).alias("chunk_id"),
            F.col("line").alias("text"),
        )
    )


#: The same views for DuckDB; each query's SQL begins with what it needs of them.
PAGES_SQL = """pages_view AS (
  SELECT source AS doc_id, source AS title, source || '.pdf' AS source_pdf, doc_id AS row_id, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS page_num,
         printf('%s_p%04d_c001', source, row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS chunk_id
  FROM documents
)"""
LINES_SQL = """split_lines AS (
  SELECT doc_id, page_num, string_split(text, chr(10)) AS parts FROM pages_view
), lines_view AS (
  SELECT doc_id, page_num, i AS chunk_index, printf('%s_p%04d_c%03d', doc_id, page_num, i) AS chunk_id, parts[i] AS text
  FROM split_lines, generate_series(1, len(parts)) AS g(i)
)"""
