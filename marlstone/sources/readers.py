"""Readers of the JSON files of a corpus, with explicit schemas."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import media
from marlstone.functions.names import basename, slug
from marlstone.functions.text import first_filled, positive_int, stripped
from marlstone.scratch import hinted, materialize, ship

# The field names that files of different ages use.
PAGE_FIELDS = ("page_num", "page", "page_no", "page_number", "pdf_page")
TEXT_FIELDS = ("text", "cleaned_text", "page_text", "content")
SOURCE_FIELDS = ("source_pdf", "filename", "pdf_file", "pdf_name", "file", "source")
LISTS = ("pages", "items", "records")

CHUNK = "doc_id string, title string, source_pdf string, filename string, page_num string, page_start string, page_end string, chunk_index string, chunk_id string, text string"
GRAPH = "chunk_id string, doc_id string, title string, source_pdf string, page_start int, page_end int, neighbors array<string>"
REGISTRY = "ts_utc string, doc_id string, filename string, file string, sha256 string, bytes long, mime string, s3_bucket string, bucket string, s3_key string, key string, source string"
REFERENCE = "struct<source_filename:string,source_pages:array<int>,gold_answer:string>"
GOLD = (
    "question_id string, question string, question_type string, answerable boolean, book_anchor string, book_position string, coverage_type string, knowledge_type string, reasoning_type string, "
    "lexical_type string, alt_valid boolean, answer_type string, target_items array<string>, gold_answer string, source_filename string, source_pages array<int>, "
    f"primary_reference {REFERENCE}, alternative_references array<{REFERENCE}>, comment string, notes string"
)


def raw_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """value, _file, _line of the lines of a folder's files and of those below it, without BOMs and blank
    lines. _line is the line's number in its file, from 1. A large file is read in parts by several tasks:
    the lines of each part are counted first, which reads the files once more but moves only counts."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_row"))
    parts = text.select(*place).groupBy("_file", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("_file").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(parts.select("_file", "_part", (before + 1 - F.col("first")).alias("_start")), "parts")
    raw = text.select("value", *place).join(hinted(starts, 256), ["_file", "_part"])
    return raw.select(stripped(F.translate("value", "\ufeff", "")).alias("value"), "_file", (F.col("_row") + F.col("_start")).alias("_line")).where("value <> ''")


def json_lines(spark: SparkSession, path: str, schema: str, pattern: str = "*.jsonl", mode: str = "FAILFAST") -> DataFrame:
    """Rows of JSON lines. `_file` and `_line` say where a row is from. A line that is no JSON stops the job
    with its file and number, if the mode is FAILFAST; so does one of other types, without them."""
    lines, value = raw_lines(spark, path, pattern), F.col("value")
    if mode == "FAILFAST":
        wrong = F.concat("_file", F.lit(":"), F.col("_line").cast("string"), F.lit(": no JSON: "), F.left("value", F.lit(200)))
        value = F.when(F.get_json_object("value", "$").isNotNull(), value).otherwise(F.raise_error(wrong).cast("string"))
    return lines.select("_file", "_line", F.from_json(value, schema, {"mode": mode}).alias("r")).select("_file", "_line", "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold one object or a list of objects, read whole."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    return rows.select(F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_line"), *rows.columns)


_PAGE = "_file string, doc_id string, title string, source string, page string, text string"


def _flat_pages(value: str, file: str, line: int | None = None) -> Iterator[tuple]:
    """The pages of an object that may hold lists of pages, to any depth. What a page does not say of its
    document is that of the object around it."""
    try:
        todo = [(json.loads(value), {})]
    except ValueError as e:
        where = file if line is None else f"{file}:{line}"
        raise ValueError(f"{where}: {e}: {value[:200]}") from None
    while todo:
        found, around = todo.pop()
        if isinstance(found, list):
            todo += [(x, around) for x in reversed(found)]
        if not isinstance(found, dict):
            continue

        def filled(names: tuple[str, ...], found: dict = found) -> str | None:
            said = (str(found[n]).strip() for n in names if found.get(n) is not None)
            return next((x for x in said if x), None)

        own = {n: filled(f) or around.get(n) for n, f in (("doc_id", ("doc_id",)), ("title", ("title",)), ("source", SOURCE_FIELDS))}
        kids = next((found[n] for n in LISTS if isinstance(found.get(n), list)), None)
        if kids is None:
            numbers = (str(found[n]).strip() for n in PAGE_FIELDS if found.get(n) is not None)
            page = next((n for n in numbers if n.isdigit() and int(n) > 0), None)
            yield file, own["doc_id"], own["title"], own["source"], page, filled(TEXT_FIELDS)
        else:
            todo += [(x, own) for x in reversed(kids)]


def page_texts(objects: DataFrame) -> DataFrame:
    """doc_id, title, source_pdf, page_num, text of page objects (value as JSON, _file, and _line if they
    are lines). Pages without a number or text drop out; a value that is no JSON stops the job, which says where it is."""
    ship(objects.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PAGE.split(", ")]
        for b in batches:
            rows = [r for v, f, n in zip(*(b.column(c).to_pylist() for c in ("value", "_file", "_line")), strict=True) for r in _flat_pages(v, f, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * len(names), names)

    line = F.col("_line") if "_line" in objects.columns else F.lit(None)
    rows = objects.select("value", "_file", line.cast("long").alias("_line")).mapInArrow(run, _PAGE)
    stem = F.regexp_replace(basename(F.col("_file")), r"\.[^.]*$", "")
    source = F.coalesce("source", F.concat(stem, F.lit(".pdf")))
    name = F.regexp_replace(basename(source), r"\.[^.]*$", "")
    pages = rows.select(F.coalesce("doc_id", slug(name)).alias("doc_id"), F.coalesce("title", name).alias("title"), source.alias("source_pdf"), positive_int(F.col("page")).alias("page_num"), "text")
    return pages.where("page_num is not null and text is not null")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the JSON lines and JSON files of a folder. A folder without any stops the job."""
    lines = raw_lines(spark, path)
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    whole = whole.select(stripped(F.translate("value", "\ufeff", "")).alias("value"), F.col("_metadata.file_path").alias("_file")).where("value <> ''")
    if not lines.limit(1).count() and not whole.limit(1).count():
        raise FileNotFoundError(f"no JSON or JSONL in {path}")
    return page_texts(lines.unionByName(whole, allowMissingColumns=True))


#: content of a file -> the texts of its pages
ExtractFn = Callable[[bytes], list[str]]


def read_documents(spark: SparkSession, path: str, extract: ExtractFn, pattern: str = "*.pdf") -> DataFrame:
    """doc_id, title, source_pdf, page_num, text of every page of a folder's files, whose text the caller's
    function extracts. A file that it fails on has no pages; the others are not stopped."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("_file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("_file").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    texts = extract(content)
                except Exception as e:  # a broken file must not stop the others
                    print(f"{file}: {e}", file=sys.stderr)
                    texts = []
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], ["_file", "page_num", "text"])

    pages = files.mapInArrow(run, "_file string, page_num int, text string")
    name = basename(F.col("_file"))
    title = F.regexp_replace(name, r"\.[^.]*$", "")
    return pages.select(slug(title).alias("doc_id"), title.alias("title"), name.alias("source_pdf"), "page_num", "text")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with text; title, document and pages filled from the other fields where missing."""
    rows = json_lines(spark, path, CHUNK)
    source = first_filled(F.col("source_pdf"), F.col("filename"))
    name = basename(source)
    title = first_filled(F.col("title"), F.regexp_replace(name, r"\.[^.]*$", ""))
    page = positive_int(F.col("page_num"))
    return rows.where(stripped(F.coalesce("text", F.lit(""))) != "").select(
        first_filled(F.col("doc_id"), title).alias("doc_id"), title.alias("title"), name.alias("source_pdf"), page.alias("page_num"),
        F.coalesce(positive_int(F.col("page_start")), page).alias("page_start"), F.coalesce(positive_int(F.col("page_end")), page).alias("page_end"),
        positive_int(F.col("chunk_index")).alias("chunk_index"), first_filled(F.col("chunk_id")).alias("chunk_id"), "text", "_file", "_line",
    )


def graph_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks that a graph can be built of: those with an id and a document."""
    return chunks.where((stripped(F.coalesce("chunk_id", F.lit(""))) != "") & (stripped(F.coalesce("doc_id", F.lit(""))) != ""))


def last_by_id(chunks: DataFrame) -> DataFrame:
    """Of chunks with one id the last in the files; those without an id drop out."""
    place = W.partitionBy("chunk_id").orderBy(F.desc("_file"), F.desc("_line"))
    return chunks.where("chunk_id is not null").withColumn("_k", F.row_number().over(place)).where("_k = 1").drop("_k")


def require_sources(chunks: DataFrame) -> DataFrame:
    """For ingestion: a chunk without the name of its file stops the job."""
    named = F.when(F.col("source_pdf").isNotNull(), F.col("source_pdf")).otherwise(F.raise_error(F.concat(F.lit("no source of chunk "), F.coalesce("chunk_id", F.lit("?")))).cast("string"))
    return chunks.withColumn("source_pdf", named)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a registry, in the order of files and lines; none if there is no registry yet."""
    rows = json_lines(spark, path, REGISTRY, "*.{jsonl,json}") if exists(spark, path) else spark.createDataFrame([], f"_file string, _line long, {REGISTRY}")
    return rows.select(
        first_filled(F.col("filename"), F.col("file")).alias("filename"), "doc_id", "sha256", first_filled(F.col("s3_bucket"), F.col("bucket")).alias("s3_bucket"),
        first_filled(F.col("s3_key"), F.col("key")).alias("s3_key"), "source", F.struct("_file", "_line").alias("line"),
    )


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Nodes with an id; what is no list of neighbours counts as none, as do other fields of a wrong type."""
    rows = json_lines(spark, path, GRAPH, mode="PERMISSIVE").where(stripped(F.coalesce("chunk_id", F.lit(""))) != "")
    near = F.filter(F.coalesce("neighbors", F.array().cast("array<string>")), lambda x: F.coalesce(stripped(x), F.lit("")) != "")
    return rows.withColumn("neighbors", near).drop("_file", "_line")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions; older files name the primary reference at the top."""
    rows = json_lines(spark, path, GOLD)
    older = F.struct("source_filename", "source_pages", "gold_answer")
    return rows.withColumn("primary_reference", F.coalesce("primary_reference", older)).withColumn("answerable", F.coalesce("answerable", F.lit(False))).drop("_file", "_line")


def latest_file(spark: SparkSession, path: str, pattern: str = "baseline*.jsonl") -> str | None:
    """The file of a folder that was changed last, without analyses."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime").where("path not like '%.analysis.%'")
    row = files.agg(F.max_by("path", "modificationTime").alias("path")).first()
    return row["path"] if row else None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, sha256, bytes, mime of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = basename(F.col("path"))
    return rows.select(name.alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), media.mime(name).alias("mime"), F.lower(media.suffix(name)).alias("suffix"))
