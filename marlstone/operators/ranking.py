"""Ranks within groups of any size, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.scratch import materialize


ROWS_OF_A_TASK = 500_000


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with its 1-based rank within keys by order. Groups are ranked in ranges, whose sizes give
    each range its offset, so no task needs a whole group. Pass narrow rows: they are counted and written.
    So few rows that one task could hold them all need no ranges."""
    if df.count() <= ROWS_OF_A_TASK:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("int"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = materialize(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    local = F.row_number().over(W.partitionBy("_range", *keys).orderBy(*order))
    joined = placed.withColumn("_local", local).join(offsets, ["_range", *keys])
    return joined.select(*df.columns, (F.col("_local") + F.col("_offset")).cast("int").alias(name))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group by order, ranked from 1; Spark limits groups before it shuffles."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k)
