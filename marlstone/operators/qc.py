"""Quality control of page texts by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import page_breaks, preview
from marlstone.scratch import hinted, materialize

SHORT_PREVIEW = 30


def shown(pages: DataFrame, preview_chars: int = 200) -> DataFrame:
    """pages without text, with what a preview shows of it: null if there is none."""
    text = page_breaks(F.col("text"))
    rows = pages.withColumn("clean", text)
    return rows.withColumn("shown", F.when(F.col("clean") != "", preview(F.col("clean"), preview_chars))).drop("text", "clean")


def status(pages: DataFrame, preview_chars: int = 200) -> DataFrame:
    """doc_id, status, total_pages, text_pages, empty_pages, first_text_page, preview."""
    return rated(shown(pages.select("doc_id", "page_num", "text"), preview_chars))


def rated(rows: DataFrame) -> DataFrame:
    """As status, of rows (doc_id, page_num, shown), whose previews have SHORT_PREVIEW characters at least."""
    some = F.col("shown").isNotNull()
    counts = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(some).alias("text_pages"),
        F.count_if(~some).alias("empty_pages"),
        F.min(F.when(some, F.col("page_num"))).alias("first_text_page"),
        F.min_by("shown", F.when(some, F.col("page_num"))).alias("preview"),
    )
    empty = F.col("empty_pages") / F.col("total_pages")
    rating = (
        F.when(F.col("text_pages") == 0, "bad")
        .when(F.length(F.coalesce("preview", F.lit(""))) < SHORT_PREVIEW, "acceptable")
        .when(empty > 0.5, "bad")
        .when(empty > 0.2, "acceptable")
        .otherwise("good")
    )
    return counts.select("doc_id", rating.alias("status"), "total_pages", "text_pages", "empty_pages", F.col("first_text_page").cast("int"), F.coalesce("preview", F.lit("")).alias("preview"))


def samples(pages: DataFrame, preview_chars: int = 400) -> DataFrame:
    """doc_id, total_pages, the first page with text at the beginning (10 pages), in the middle (5 on
    either side) and at the end (10), its text, and a verdict."""
    # Numbers first, so that only pages of the three bands carry their text on.
    sizes = materialize(pages.where("doc_id is not null").groupBy("doc_id").agg(F.max("page_num").alias("total_pages")), "sizes")
    i, n = F.col("page_num") - 1, F.col("total_pages")
    middle = F.floor(n / 2)
    bands = {"begin": i < 10, "mid": (i >= middle - 5) & (i < middle + 5), "end": i >= n - 10}
    rows = pages.select("doc_id", "page_num", page_breaks(F.col("text")).alias("clean")).join(hinted(sizes, 64), "doc_id")
    rows = rows.where((bands["begin"] | bands["mid"] | bands["end"]) & (F.col("clean") != ""))
    rows = rows.select("doc_id", "page_num", "total_pages", preview(F.col("clean"), preview_chars).alias("shown"))
    found = []
    for name, here in bands.items():
        found += [F.min(F.when(here, F.col("page_num"))).alias(f"{name}_page"), F.min(F.when(here, F.struct("page_num", "shown")))["shown"].alias(f"{name}_text")]
    out = sizes.join(rows.groupBy("doc_id").agg(*found), "doc_id", "left")
    begin, mid, end = (F.col(f"{b}_page").isNotNull() for b in bands)
    verdict = F.when(begin & mid & end, "everywhere").when(begin & mid, "check the end").when(mid | end, "unstable").otherwise("poor")
    return out.withColumn("verdict", verdict)
