"""Prepare a corpus for search: clean its pages, cut them into chunks, and report on each source.

    python -m jobs.prepare_corpus jobs/config/prepare_corpus.json [documents=... corpus=... sources=a,b]

A source is a book and its documents are the pages. Headers and footers that its pages repeat are taken
out. Written are, each partitioned by source: `pages` (the cleaned pages), `chunks`, and `report` (quality
and counts of each source, as JSON). Only the partitions of the sources that were read are replaced, when
all their rows have been written; run again, the job leaves the same rows. With `sources` it reads those alone.

Defined results: a null text is an empty page, which has no chunks; a document without a source belongs to
none and is left out; a source whose pages are all empty has a report and no chunks, and chunks that it had
in an earlier run go. Other columns of the documents are not read.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import conf, main
from marlstone.operators import chunk, clean, qc
from marlstone.operators.ranking import ranked
from marlstone.scratch import hinted, materialize, ship, spread

log = logging.getLogger("prepare_corpus")

CHUNKS = "page_num int, chunk_index int, chunk_id string, text string, chars int, doc_id string"


PAGES = "page_num int, text string, raw_chars long, cleaned_chars long, dropped_lines long, doc_id string"
#: Parts of a source, which tasks share and which become files.
SHARDS = 16


def seen(docs: DataFrame) -> DataFrame:
    """doc_id (the source), row_id, lines (of the two zones of the page), shown of docs; narrow, and written."""
    rows = qc.shown(clean.page_lines(spread(docs)), qc.SHORT_PREVIEW)
    return materialize(rows.select("doc_id", "row_id", clean.zone_lines(F.col("lines")).alias("lines"), "shown"), "seen")


def numbered(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc_id, page_num, text of docs, dealt out by the sources' shards. Texts are shuffled once: the numbers, if they
    are no broadcast, are dealt out the same way (see conf() below)."""
    keys = ["doc_id", "shard"]
    shard = F.pmod(F.xxhash64("row_id"), F.lit(SHARDS)).alias("shard")
    small = hinted(numbers, 64)
    dealt = docs.select("*", shard).repartition(*keys)
    held = small.select("*", shard) if small is not numbers else numbers.select("*", shard).repartition(*keys).hint("shuffle_hash")
    return dealt.join(held, [*keys, "row_id"]).select("doc_id", "page_num", "text")


def replace(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Put the partitions (doc_id) that df has in place of those that are there. Each task of df should hold the rows
    of few."""
    df.write.mode("overwrite").partitionBy("doc_id").format(form).save(path)


def prepare_corpus(spark: SparkSession, documents: str, corpus: str, sources: str | None = None, min_ratio: float | str = clean.MIN_RATIO, size: int | str = chunk.SIZE) -> DataFrame:
    """Write pages, chunks and reports of the documents (Parquet) into the folder corpus; its chunks. Texts are read
    twice, shuffled once by source, and written as pages and as chunks of these alone."""
    ship(spark)
    corpus = corpus.rstrip("/")
    docs = spark.read.parquet(documents).where("source is not null").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    if sources:
        docs = docs.where(F.col("doc_id").isin(sources.split(",")))
    numbers = materialize(ranked(docs.select("doc_id", "row_id"), ["doc_id"], ["row_id"], "page_num"), "numbers")
    narrow = seen(docs)
    status = qc.rated(narrow.select("doc_id", "row_id", "shown").join(hinted(numbers, 64), ["doc_id", "row_id"])).select("doc_id", "status", "first_text_page")
    status = materialize(status, "status")
    settings = {"spark__sql__sources__partitionOverwriteMode": "dynamic", "spark__sql__requireAllClusterKeysForCoPartition": "false"}
    with conf(spark, **settings):
        cleaned = clean.cleaned(clean.page_lines(numbered(docs, numbers)), clean.repeated_lines(narrow, float(min_ratio)))
        replace(cleaned.select("page_num", "text", "raw_chars", "cleaned_chars", "dropped_lines", "doc_id"), f"{corpus}/pages")
        # The pages as they have been written, of the sources that were read; an empty name's folder reads as null.
        written = spark.read.schema(PAGES).parquet(f"{corpus}/pages").withColumn("doc_id", F.coalesce("doc_id", F.lit("")))
        written = written.join(hinted(status, 64).select("doc_id"), "doc_id", "left_semi")
        named = written.select("doc_id", F.col("doc_id").alias("title"), F.col("doc_id").alias("source_pdf"), "page_num", "text")
        chunks = chunk.chunked(named, int(size)).select("page_num", "chunk_index", "chunk_id", "text", "chars", "doc_id")
        # A source without chunks gets one empty row, which replaces what an earlier run left.
        some = written.where(F.btrim("text", F.lit(chunk.BLANK)) != "").select("doc_id").distinct()
        none = status.join(some, "doc_id", "left_anti").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema if f.name != "doc_id"], "doc_id")
        replace(chunks.unionByName(none), f"{corpus}/chunks")
        held = spark.read.schema(CHUNKS).parquet(f"{corpus}/chunks").where("chunk_id is not null")
        counted = held.groupBy(F.coalesce("doc_id", F.lit("")).alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"))
        report = clean.report(written).join(status, "doc_id").join(counted, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        report = materialize(report, "report")
        replace(report.repartition("doc_id"), f"{corpus}/report", "json")
    totals = report.agg(F.count(F.lit(1)).alias("s"), F.sum("total_pages").alias("p"), F.sum("chunks").alias("c")).first()
    log.info("%s pages of %s sources read from %s; %s chunks written to %s", totals.p or 0, totals.s, documents, totals.c or 0, corpus)
    return held


if __name__ == "__main__":
    main(prepare_corpus, __doc__)
