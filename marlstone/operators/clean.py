"""Page cleaning: useful lines, repeated headers and footers, tidy text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import clean_lines, stripped, tidy_punctuation
from marlstone.scratch import hinted, materialize

ZONE = 3
MIN_RATIO, MIN_REPEATS = 0.30, 3
LONGEST, SHORTEST = 180, 3


def page_lines(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_num, text) with the array lines."""
    return pages.withColumn("lines", clean_lines(F.col("text")))


def _zone_keys(zone: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(zone, F.lower), lambda x: F.length(x) <= LONGEST))


def _bottom(lines: Column) -> Column:
    return F.slice(lines, F.greatest(F.size(lines) - (ZONE - 1), F.lit(1)), ZONE)


def zone_lines(lines: Column) -> Column:
    """The lines of the two zones, which are all that repeated_lines looks at; empty those that are too long for it."""
    zones = F.when(F.size(lines) > 2 * ZONE, F.concat(F.slice(lines, 1, ZONE), _bottom(lines))).otherwise(lines)
    return F.transform(zones, lambda x: F.when(F.length(F.lower(x)) <= LONGEST, x).otherwise(""))


def repeated_lines(lined: DataFrame, min_ratio: float = MIN_RATIO, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, line, kind (header or footer), top_count, bottom_count. Pages without lines count."""
    sizes = lined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    zones = F.array(
        F.struct(F.lit(1).alias("top"), _zone_keys(F.slice("lines", 1, ZONE)).alias("keys")),
        F.struct(F.lit(0).alias("top"), _zone_keys(_bottom(F.col("lines"))).alias("keys")),
    )
    keys = lined.select("doc_id", F.explode(zones).alias("z")).select("doc_id", "z.top", F.explode("z.keys").alias("line"))
    counts = keys.where(F.length("line") >= SHORTEST).groupBy("doc_id", "line").agg(F.sum("top").alias("top_count"), F.sum(1 - F.col("top")).alias("bottom_count"))
    threshold = F.greatest(F.lit(min_repeats), F.ceil(F.col("pages") * F.lit(min_ratio)))
    top, bottom = F.col("top_count"), F.col("bottom_count")
    kind = F.when((top >= threshold) & (top > bottom), "header").when((bottom >= threshold) & (bottom > top), "footer")
    return counts.join(sizes, "doc_id").withColumn("kind", kind).where("kind is not null").select("doc_id", "line", "kind", "top_count", "bottom_count")


def cleaned(lined: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, page_num, text, raw_chars, cleaned_chars, dropped_lines of each page."""
    by_doc = repeated.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("kind") == "header", F.col("line"))).alias("headers"), F.collect_list(F.when(F.col("kind") == "footer", F.col("line"))).alias("footers")
    )
    # Written and counted, so that a large document's pages can be split in the join.
    by_doc = hinted(materialize(by_doc, "repeated"), 1024)
    none = F.array().cast("array<string>")
    joined = lined.join(by_doc, "doc_id", "left").withColumns({"headers": F.coalesce("headers", none), "footers": F.coalesce("footers", none), "n": F.size("lines")})

    def stays(x: Column, i: Column) -> Column:
        top, bottom = i < ZONE, i >= F.col("n") - ZONE
        return ~((top & F.array_contains(F.col("headers"), F.lower(x))) | (bottom & F.array_contains(F.col("footers"), F.lower(x))))

    # Only the lines of the two zones are looked at; where none repeats, none at all.
    kept = F.when((F.size("headers") > 0) | (F.size("footers") > 0), F.filter("lines", stays)).otherwise(F.col("lines"))
    rows = joined.withColumn("kept", kept)
    text = stripped(tidy_punctuation(F.array_join("kept", "\n")))
    return rows.select("doc_id", "page_num", text.alias("text"), F.length("text").cast("long").alias("raw_chars"), (F.col("n") - F.size("kept")).cast("long").alias("dropped_lines")).select(
        "*", F.length("text").cast("long").alias("cleaned_chars")
    )


def report(clean: DataFrame) -> DataFrame:
    """Counts of each document after cleaning."""
    return clean.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("cleaned_chars") > 0).alias("text_pages"),
        F.count_if(F.col("cleaned_chars") == 0).alias("empty_pages"),
        F.sum("raw_chars").alias("raw_chars"),
        F.sum("cleaned_chars").alias("cleaned_chars"),
        F.sum("dropped_lines").alias("dropped_lines"),
    )
