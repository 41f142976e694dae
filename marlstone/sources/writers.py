"""Sinks: partitioned tables, replaced by document, and the JSON and CSV files of a run."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import registry
from marlstone.scratch import materialize
from marlstone.sources import readers


def write_by_document(df: DataFrame, path: str, key: str = "doc_id") -> None:
    """Replace the documents that df has, and leave the others as they are."""
    df.repartition(F.col(key), F.pmod(F.xxhash64(*df.columns[:2]), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages in the order of documents and page numbers, each document in few files."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    pages.repartitionByRange(n, "doc_id", "page_num").sortWithinPartitions("doc_id", "page_num").write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks in the order of their files, and in a file of pages, places and ids; what is missing is 0."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [F.col("source_pdf"), F.coalesce("page_start", "page_num", F.lit(0)), F.coalesce("chunk_index", F.lit(0)), F.col("chunk_id")]
    chunks.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str, column: str = "line") -> None:
    """A report of some lines, as one file."""
    lines.select(column).coalesce(1).write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of a report (doc_id, at, line) in the order of documents and lines, over ordered files."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    lines.repartitionByRange(n, "doc_id", "at").sortWithinPartitions("doc_id", "at").select("line").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append to a log: a registry, a list of searches or answers."""
    df.withColumn("ts_utc", utc_now()).write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """All fields quoted. Spark writes no byte-order mark."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_manifest(spark: SparkSession, folder: str, name: str, config: dict[str, str]) -> str:
    """One JSON object with the settings of a run; returns its path."""
    now = datetime.now(UTC)
    path = f"{folder.rstrip('/')}/manifests/{name}-{now:%Y%m%d-%H%M%S}"
    row = spark.createDataFrame([(now.isoformat(), name, config)], "ts_utc string, name string, config map<string,string>")
    row.coalesce(1).write.mode("errorifexists").json(path)
    return path


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def with_object_keys(files: DataFrame) -> DataFrame:
    """Where a file's content goes: by its digest."""
    return files.withColumn("s3_key", F.concat(F.lit("raw/"), "sha256", F.coalesce(F.nullif("suffix", F.lit("")), F.lit(".bin"))))


def upload_sources(spark: SparkSession, folder: str, objects: str, registry_path: str, bucket: str) -> int:
    """Copy the files of a folder that the registry does not have to `objects`, by their digests, and
    append them to the registry; returns how many are new. Files are copied by the tasks."""
    known = registry.new_files(with_object_keys(readers.read_files(spark, folder)), readers.read_registry(spark, registry_path))
    new = materialize(known, "new_files")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.sha2("content", 256).alias("sha256"), "content")
    keyed = contents.dropDuplicates(["sha256"]).join(new.select("sha256", "s3_key"), "sha256")
    if objects:
        # One folder for each object, as Spark's writers make folders.
        keyed.select("s3_key", "content").write.mode("append").partitionBy("s3_key").parquet(f"{objects.rstrip('/')}/{bucket}")
    rows = new.select(F.col("sha256").alias("doc_id"), "filename", "sha256", "bytes", "mime", F.lit(bucket).alias("s3_bucket"), "s3_key", F.lit("local_upload").alias("source"))
    n = rows.count()
    if n:
        append_json(rows, registry_path)
    return n


VECTOR = "point_id string, source_pdf string, chunk_id string, embedding array<float>"


def create_index_table(spark: SparkSession, path: str, dims: int, recreate: bool = False) -> None:
    """An empty table of vectors, which remembers their length."""
    spark.createDataFrame([], VECTOR).write.mode("overwrite" if recreate else "ignore").parquet(f"{path.rstrip('/')}/vectors")
    spark.createDataFrame([(dims,)], "dims int").coalesce(1).write.mode("overwrite" if recreate else "ignore").json(f"{path.rstrip('/')}/schema")


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append to an index table; a vector of another length than the table's stops the job."""
    spark = vectors.sparkSession
    dims = spark.read.schema("dims int").json(f"{path.rstrip('/')}/schema").first()["dims"]
    wrong = F.raise_error(F.concat(F.lit("no vector of length "), F.lit(str(dims)), F.lit(": "), F.coalesce("chunk_id", F.lit("?")))).cast("array<float>")
    checked = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(wrong)
    names = [x.split()[0] for x in VECTOR.split(", ")]
    vectors.withColumn("embedding", checked).select(*names).write.mode("append").parquet(f"{path.rstrip('/')}/vectors")


def drop_index_table(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
