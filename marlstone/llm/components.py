"""Connected components of links between 64-bit keys, without a task or driver that sees them all.

Links point from a key to a smaller one. A round makes every key point to the least of its
parents, its other parents to that least one, and then each key to its parent's parent, so that
long chains halve. Keys that many links point to are never a grouping key before their links have
been made distinct, and joins on them have a side that is unique by key, so Spark can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import drop, materialize

MOST_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """key, root for every key of links (key, parent; parent < key) that is not a root itself;
    root is the least key of its component."""
    links = materialize(links.where("parent < key").distinct(), "links")
    for _ in range(MOST_ROUNDS):
        least = links.groupBy("key").agg(F.min("parent").alias("least"), F.max("parent").alias("most"))
        least = materialize(least, "least")
        # Other parents of a key point to its least parent.
        several = least.where("most > least").select("key", "least")
        up = (
            links.join(several, "key")
            .where("parent > least")
            .select(F.col("parent").alias("key"), F.col("least").alias("parent"))
            .distinct()
        )
        direct = least.select("key", F.col("least").alias("parent"))
        # Each key points to the parent of its parent.
        grand = least.select(F.col("key").alias("parent"), F.col("least").alias("grand"))
        jumped = direct.join(grand, "parent", "left").select("key", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
        jumped = materialize(jumped, "jumped")
        up = materialize(up, "up")
        if not jumped.where("moved").limit(1).count() and not up.limit(1).count():
            for table in (links, jumped, up):
                drop(table)
            return direct.select("key", F.col("parent").alias("root"))
        old = (links, least, jumped, up)
        links = materialize(jumped.select("key", "parent").unionByName(up).distinct(), "links")
        for table in old:  # nothing reads a round's tables once the next links are written
            drop(table)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
