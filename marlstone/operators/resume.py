"""Answers that outlive a failing model and a lost job: calls with bounded retries, and a ledger of what
has been answered, so that a run that is started again asks only what is left.

The ledger is a Parquet table, written by appending a batch of questions at a time. Its key is a digest of
the question, so a question that several rows put is asked once. A batch that was lost before it was
written is asked again, others aren't; one that was written in part counts for what is there.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import top_k
from marlstone.scratch import materialize
from marlstone.sources.readers import exists

#: (question_id, question, attempt) -> rows with question_id and status, and whatever else is answered
AskFn = Callable[[DataFrame], DataFrame]

#: States of a question that is asked again.
FAILED = ("timeout", "cli_error", "error")


@dataclass(frozen=True)
class Retry:
    """How a call is tried again: errors of these kinds, after waits that double up to the longest one,
    each drawn between half and all of it, so that tasks don't return together. Other errors are raised at
    once. per_second bounds the calls that a task makes in a second."""

    attempts: int = 4
    first_wait: float = 0.5
    longest_wait: float = 30.0
    kinds: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError)
    per_second: float | None = None


def retried(call: Callable, retry: Retry = Retry()) -> Callable:
    """call, tried again as retry says; the last error is raised."""
    last = [float("-inf")]

    def again(*given, **named):
        for attempt in range(1, retry.attempts + 1):
            if retry.per_second:
                time.sleep(max(0.0, last[0] + 1 / retry.per_second - time.monotonic()))
                last[0] = time.monotonic()
            try:
                return call(*given, **named)
            except retry.kinds:
                if attempt == retry.attempts:
                    raise
                wait = min(retry.longest_wait, retry.first_wait * 2 ** (attempt - 1))
                time.sleep(wait * random.uniform(0.5, 1.0))

    return again


def answered(questions: DataFrame, ask: AskFn, ledger: str, batch_questions: int = 1000, attempts: int = 3, failed: tuple[str, ...] = FAILED) -> DataFrame:
    """question_id, key, attempt and what ask gives, for each row of questions (question_id, question), from
    the ledger at that path, which is filled first.

    ask is given about batch_questions at a time, keys standing for ids. A question that ends in a state of
    `failed`, or that ask gives no row for, is asked up to `attempts` times in all, over all runs that
    share the ledger; of its rows the first good one counts, else the last. Where ask gave none, status is
    null. A null question counts as empty. Rows that repeat are kept; an empty table gives an empty result."""
    spark = questions.sparkSession
    text = F.coalesce(F.col("question").cast("string"), F.lit(""))
    rows = materialize(questions.select(F.col("question_id").cast("string").alias("question_id"), text.alias("question")).withColumn("key", F.sha2("question", 256)), "questions")
    # A question's text is its key's: any of equal ones.
    distinct = materialize(rows.select("key", "question").distinct().withColumn("attempt", F.lit(0)), "distinct")
    good = ~F.coalesce(F.col("status").isin(*failed), F.lit(True))

    def told(part: DataFrame) -> DataFrame:
        """A row for each question of part at least."""
        said = ask(part.select(F.col("key").alias("question_id"), "question", "attempt"))
        return part.select("key", "attempt").join(said.drop("attempt").withColumnRenamed("question_id", "key"), "key", "left")

    # Read with what will be written: a run that was lost at once leaves a folder without files.
    written = spark.read.schema(told(distinct.where("false")).schema)
    for _ in range(attempts):
        left = distinct
        if exists(spark, ledger):
            state = written.parquet(ledger).groupBy("key").agg(F.max("attempt").alias("tried"), F.bool_or(good).alias("done"))
            left = distinct.drop("attempt").join(state, "key", "left").where(~F.coalesce("done", F.lit(False)) & (F.coalesce("tried", F.lit(0)) < attempts))
            left = left.select("key", "question", F.coalesce("tried", F.lit(0)).alias("attempt"))
        left = materialize(left.withColumn("attempt", (F.col("attempt") + 1).cast("int")), "pending")
        n = left.count()
        if not n:
            break
        batches = -(-n // batch_questions)
        for batch in range(batches):  # driven by counts alone; no row comes to the driver
            told(left.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == batch)).write.mode("append").parquet(ledger)
    found = (written.parquet(ledger) if exists(spark, ledger) else told(distinct.where("false"))).withColumn("_good", good)
    place = F.when(F.col("_good"), F.col("attempt")).otherwise(-F.col("attempt"))
    best = top_k(found, ["key"], [F.desc("_good"), place.asc()], 1, "_rank").drop("_good", "_rank")
    # Unique by key and written, so that a question that very many rows put can be split.
    return rows.select("question_id", "key").join(materialize(best, "answers"), "key")
