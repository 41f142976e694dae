"""Queries that run a stream to its end, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.scratch import new_path
from marlstone.sources.tables import table
from marlstone.streaming.ingest import dedupe_into


def stream_new_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of distinct texts, ingested as a stream of files."""
    docs = table(spark, sf_dir, "documents")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    home = new_path(spark, "stream")
    # A pattern, as a stream takes a single file by no other kind of path.
    dedupe_into(spark, f"{sf_dir}/documents*.parquet", types, f"{home}/out", f"{home}/state").awaitTermination()
    return spark.read.parquet(f"{home}/out").select("sha256")


QUERIES = {"stream_new_texts": stream_new_texts}
ORACLES = {"stream_new_texts": "SELECT DISTINCT sha256(coalesce(text, '')) AS sha256 FROM documents"}
