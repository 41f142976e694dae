"""Incremental ingestion: new files once, and documents replaced as they come again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.sources.writers import write_by_document


def new_texts(stream: DataFrame) -> DataFrame:
    """The rows of a stream (doc_id, text) whose text has not come before."""
    return stream.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["sha256"])


def dedupe_into(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Append what is new in a folder of Parquet files; run again, it takes up where it stopped."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    return new_texts(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()


def replace_documents(stream: DataFrame, target: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Each batch replaces the documents that it has in a table partitioned by document."""

    def put(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            write_by_document(batch, target, key)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
