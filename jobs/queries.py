"""The jobs as registered queries, with their SQL: each runs twice into one new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs.ingest_passages import ingest_passages
from jobs.prepare_corpus import prepare_corpus
from marlstone.plans.corpus_build import CHUNKS_SQL, CLEANED_SQL, LINED_SQL, RATIO, REPEATED_SQL
from marlstone.scratch import new_path
from marlstone.sources.corpus import PAGES_SQL


def job1_ingest_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_path(spark, "passages")
    for _ in range(2):  # the second run finds nothing new
        held = ingest_passages(spark, f"{sf_dir}/documents*.parquet", store, f"{store}-checkpoint")
    return held.drop("batch", "shard")


def job2_prepare_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = new_path(spark, "corpus")
    for _ in range(2):
        held = prepare_corpus(spark, f"{sf_dir}/documents.parquet", corpus, min_ratio=RATIO)
    return held


QUERIES = {f.__name__: f for f in (job1_ingest_passages, job2_prepare_corpus)}

_TEXTS_SQL = "pages_view AS (SELECT DISTINCT sha256(coalesce(text, '')) AS doc_id, 1 AS page_num, coalesce(text, '') AS text FROM documents)"
_OWN_CHUNKS = CHUNKS_SQL.removeprefix(PAGES_SQL)
ORACLES = {
    "job1_ingest_passages": f"""WITH {_TEXTS_SQL}{_OWN_CHUNKS} SELECT printf('%s_%04d', left(doc_id, 16), chunk_index) AS passage_id,
      doc_id AS sha256, chunk_index, text, chars FROM chunk_rows""",
    "job2_prepare_corpus": f"""WITH {LINED_SQL}, {REPEATED_SQL}, {CLEANED_SQL}{_OWN_CHUNKS.replace("FROM pages_view", "FROM cleaned", 1)}
      SELECT page_num, chunk_index, chunk_id, text, chars, doc_id FROM chunk_rows""",
}
