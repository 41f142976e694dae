"""The registry of source files, and what it adds to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.names import basename, point_id, registry_key

#: A registry of at most this many rows is broadcast.
BROADCAST_ROWS = 200_000


def latest(registry: DataFrame) -> DataFrame:
    """One row of registry (filename, doc_id, s3_bucket, s3_key, source, line) for each key: the last."""
    named = registry.where("trim(coalesce(filename, '')) <> ''").withColumn("key", registry_key(F.col("filename")))
    last = named.groupBy("key").agg(F.max_by(F.struct("filename", "doc_id", "s3_bucket", "s3_key", "source"), "line").alias("r"))
    return last.select("key", basename(F.col("r.filename")).alias("registry_filename"), F.col("r.doc_id").alias("registry_doc_id"), "r.s3_bucket", "r.s3_key", "r.source")


def enrich(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """chunks (source_pdf, ...) with registry_doc_id, s3_bucket, s3_key, source where the registry has
    the file."""
    rows = latest(registry)
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    # Keys are made for distinct names, not for each chunk.
    names = chunks.select("source_pdf").distinct().withColumn("key", registry_key(F.col("source_pdf")))
    known = names.join(rows, "key").drop("key")
    return chunks.join(known, "source_pdf", "left")


def points(chunks: DataFrame) -> DataFrame:
    """chunks with the stable id of their vector."""
    return chunks.withColumn("point_id", point_id(basename(F.col("source_pdf")), F.col("chunk_id")))


def new_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """files (sha256, ...) that the registry does not have, one row for each digest."""
    return files.dropDuplicates(["sha256"]).join(registry.select("sha256").where("sha256 is not null").distinct(), "sha256", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
