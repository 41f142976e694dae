"""Citations: each sentence of an answer gets the chunk that matches it best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.text import CITATION, answer_sentences, match_text, match_tokens, squeezed, stripped

LEAST_SCORE, WHOLE_SENTENCE = 0.18, 0.25


def is_valid(answer: Column, n_sources: Column) -> Column:
    """Whether any citation of the answer is that of a source."""
    return F.exists(numbers(answer), lambda x: (x >= 1) & (x <= n_sources))


def numbers(answer: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def sentences(answers: DataFrame) -> DataFrame:
    """query_id, at, sentence, plain (normalised) of answers (query_id, answer); blank ones drop out."""
    rows = answers.select("query_id", F.posexplode(answer_sentences(F.col("answer"))).alias("at", "sentence"))
    return rows.withColumn("plain", match_text(F.col("sentence"))).where("plain <> ''")


def best_chunks(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, at, sentence, idx, score: the best of the query's chunks (query_id, idx, text) for
    each sentence; the first of equals, null below LEAST_SCORE."""
    said = sentences(answers).withColumn("tokens", match_tokens(F.col("plain")))
    held = chunks.select("query_id", "idx", match_text(F.col("text")).alias("chunk")).withColumn("chunk_tokens", match_tokens(F.col("chunk")))
    pairs = said.where(F.size("tokens") > 0).join(held.where(F.size("chunk_tokens") > 0), "query_id")
    overlap = F.size(F.array_intersect("tokens", "chunk_tokens")) / F.size("tokens")
    score = F.round(overlap + F.when(F.contains("chunk", "plain"), WHOLE_SENTENCE).otherwise(0.0), 9)
    best = pairs.select("query_id", "at", score.alias("score"), "idx").where("score > 0").groupBy("query_id", "at").agg(F.max(F.struct("score", (-F.col("idx")).alias("first"))).alias("best"))
    best = best.where(F.col("best.score") >= LEAST_SCORE).select("query_id", "at", (-F.col("best.first")).alias("idx"), F.col("best.score").alias("score"))
    return said.join(best, ["query_id", "at"], "left").select("query_id", "at", "sentence", "idx", "score")


def assign(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, answer (with a citation behind each run of sentences of one chunk), used (the chunks
    in order of appearance)."""
    rows = best_chunks(answers, chunks)
    w = W.partitionBy("query_id").orderBy("at")  # the sentences of one answer
    starts = (F.row_number().over(w) == 1) | ~F.lag("idx").over(w).eqNullSafe(F.col("idx"))
    runs = rows.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(w))
    listed = F.array_sort(F.collect_list(F.struct("at", "sentence")))
    block = F.array_join(F.transform(listed, lambda x: x["sentence"]), " ")
    block = squeezed(F.regexp_replace(F.regexp_replace(block, CITATION, ""), r"(?U)\s+([.,!?;:])", "$1"))
    blocks = runs.groupBy("query_id", "run").agg(block.alias("block"), F.first("idx").alias("idx"))
    cited = F.when(F.col("idx").isNull(), F.col("block")).otherwise(F.concat("block", F.lit(" ["), F.col("idx") + 1, F.lit("]")))
    parts = F.array_sort(F.collect_list(F.struct("run", cited.alias("text"), "idx")))
    whole = blocks.groupBy("query_id").agg(parts.alias("parts"))
    texts = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    used = F.array_distinct(F.transform(F.filter("parts", lambda p: p["idx"].isNotNull()), lambda p: p["idx"]))
    joined = whole.select("query_id", stripped(texts).alias("answer"), used.alias("used"))
    empty = F.array().cast("array<int>")
    return answers.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(F.col("used").cast("array<int>"), empty).alias("used"))


def renumber(answer: Column, n_sources: Column) -> tuple[Column, Column]:
    """The answer with citations numbered by first appearance (others removed, clusters sorted and
    made distinct), and the old numbers less one in that order. Unchanged without a valid citation."""
    text = F.coalesce(answer, F.lit(""))
    order = F.array_distinct(F.filter(numbers(text), lambda x: (x >= 1) & (x <= n_sources)))
    # Text and citations alternate: a cluster is a run of citations with nothing between them.
    gaps = F.split(text, r"(?:\[\d+\])+", -1)
    clusters = F.regexp_extract_all(text, F.lit(r"(?:\[\d+\])+"), F.lit(0))

    def renamed(cluster: Column) -> Column:
        new = F.filter(F.transform(numbers(cluster), lambda x: F.array_position(order, x)), lambda x: x > 0)
        several = F.size(new) > 1
        tidy = F.when(several, F.array_sort(F.array_distinct(new))).otherwise(new)
        return F.array_join(F.transform(tidy, lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "")

    pairs = F.zip_with(gaps, F.transform(clusters, renamed), lambda g, c: F.concat(g, F.coalesce(c, F.lit(""))))
    changed = squeezed(F.array_join(pairs, ""))
    return F.when(F.size(order) == 0, text).otherwise(changed), F.transform(order, lambda x: (x - 1).cast("int"))
