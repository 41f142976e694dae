"""Ingest documents into a passage store, as they come: a stream over files, each text cut once.

    python -m jobs.ingest_passages jobs/config/ingest_passages.json [documents=... store=...]

Each run takes the files that no run has taken before (the stream's checkpoint knows them), in batches
of some files. Of a batch, all rows are entered in the registry (doc_id, source, sha256 of the text), and
the texts that no earlier batch has brought are cut into passages. A passage is named by its text's digest,
so the store is the same whichever of several equal texts came first.

Both tables are partitioned by batch, and a batch looks only at what earlier ones entered: one that is
run again after a failure replaces its own partitions with the same rows. The registry takes the place of
a stream's state: nothing is held in memory between batches, and it is joined by the digest.

Store and checkpoint belong together: the checkpoint is kept in the store unless it is given.

Defined results: a null or blank text is entered and has no passages; equal texts of a batch are cut once; a
file that is read again under another name brings nothing new; no new file, no change. Other columns of
the documents are not read.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import conf, main
from marlstone.operators import chunk
from marlstone.scratch import ship

log = logging.getLogger("ingest_passages")

DOCUMENTS = "doc_id long, text string, source string"
REGISTRY = "doc_id long, source string, sha256 string, batch long"
PASSAGES = "passage_id string, sha256 string, chunk_index int, text string, chars int, batch long, shard string"


def passages(texts: DataFrame, size: int) -> DataFrame:
    """passage_id, sha256, chunk_index, text, chars of texts (sha256, text)."""
    pages = texts.select(F.col("sha256").alias("doc_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source_pdf"), F.lit(1).alias("page_num"), "text")
    cut = chunk.chunked(pages, size)
    return cut.select(F.format_string("%s_%04d", F.left("doc_id", F.lit(16)), "chunk_index").alias("passage_id"), F.col("doc_id").alias("sha256"), "chunk_index", "text", "chars")


def entered(spark: SparkSession, store: str, before: int) -> DataFrame:
    """The digests that batches before this one have entered."""
    if not before:
        return spark.createDataFrame([], "sha256 string")
    registry = spark.read.schema(REGISTRY).parquet(f"{store}/registry")
    return registry.where(F.col("batch") < before).select("sha256").distinct()


def take(spark: SparkSession, rows: DataFrame, number: int, store: str, size: int) -> None:
    """One batch: its passages, then its entries."""
    rows = rows.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sha256", F.sha2("text", 256)).withColumn("batch", F.lit(number).cast("long"))
    with conf(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        fresh = rows.dropDuplicates(["sha256"]).join(entered(spark, store, number), "sha256", "left_anti")
        cut = passages(fresh.select("sha256", "text"), size)
        cut = cut.withColumn("batch", F.lit(number).cast("long")).withColumn("shard", F.left("sha256", F.lit(1)))
        cut.repartition("shard").write.mode("overwrite").partitionBy("batch", "shard").parquet(f"{store}/passages")
        rows.select("doc_id", "source", "sha256", "batch").write.mode("overwrite").partitionBy("batch").parquet(f"{store}/registry")


def ingest_passages(spark: SparkSession, documents: str, store: str, checkpoint: str | None = None, files_per_batch: int | str = 1000, size: int | str = chunk.SIZE) -> DataFrame:
    """Take what is new in documents (a folder or pattern of Parquet files) into the store; its passages."""
    ship(spark)
    store = store.rstrip("/")
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", int(files_per_batch)).parquet(documents)
    query = (
        stream.writeStream.foreachBatch(lambda rows, number: take(rows.sparkSession, rows, number, store, int(size)))
        .option("checkpointLocation", checkpoint or f"{store}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    registry = spark.read.schema(REGISTRY).parquet(f"{store}/registry")
    held = spark.read.schema(PASSAGES).parquet(f"{store}/passages")
    for kind, table in (("rows read", registry), ("passages written", held)):
        counts = table.where(F.col("batch").isin(done)).groupBy("batch").count().orderBy("batch").collect()
        log.info("%s: %s %s", documents if table is registry else store, kind, {r.batch: r["count"] for r in counts} or "none, as nothing is new")
    return held


if __name__ == "__main__":
    main(ingest_passages, __doc__)
