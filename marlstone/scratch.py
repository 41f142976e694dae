"""What a session needs on a cluster: this package on the executors, and tables that cut lineage in
the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._marlstone_shipped = True


#: A DataFrame is broadcast only if it has been counted and is at most this large.
BROADCAST_BYTES = 48 << 20


def hinted(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """df, which must be a written table, with a broadcast hint if its counted size allows it."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """A table's rows over as many partitions as tasks run at once, if its scan has fewer, or if one of the scan's
    holds far more than its share, as a file of few row groups has; others are left as they are. Rows are
    dealt by a hash, which needs no sort."""
    n, has = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if has >= n:
        sizes = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()  # of no column
        if (sizes["most"] or 0) * n <= 2 * (sizes["n"] or 0):
            return df
    return df.repartition(max(n, has), F.xxhash64(*df.columns))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in a local session that has none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(sc, "_marlstone_scratch", None)
        if not folder:
            folder = sc._marlstone_scratch = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
    return folder


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/marlstone/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path of this application's own in the shared folder."""
    return f"{_home(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost
    executor costs no more than the tasks that it ran. Files stay until clear() or until the folder
    is emptied, as results that have not been written yet may read them."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table that materialize wrote, when nothing will read it any more: in loops."""
    spark = df.sparkSession
    home = _home(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/marlstone/" in folder and folder.split("/marlstone/", 1)[1].startswith(home.split("/marlstone/", 1)[1]):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver's JVM find what nothing refers to any more, so that Spark deletes the shuffle files
    of finished steps before the next ones write theirs."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> bool:
    """Delete what this application has written in the shared folder, once its results are written."""
    home = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    return bool(home.getFileSystem(spark._jsc.hadoopConfiguration()).delete(home, True))
