"""Answers and sources out of the printed output of older runs, and messages cut to a length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.names import basename
from marlstone.functions.text import ANSI, REFUSAL, REFUSAL_ANSWER, line_ends, page_numbers, stripped

# The marks that printed output has.
ANSWER_MARK = r"(?iu)^\s*(?:answer|ответ)\s*:\s*(.*)$"
SOURCES_MARK = r"(?iu)^\s*(?:sources|источники|evidence|доказательства)\s*:\s*$"
SOURCE_START = r"^\s*(?:\[(\d+)\]|(\d+)[\].)])\s*(.*)$"
PAGE_WORDS = r"(?iu)(?:стр(?:аница|\.|)|page)\s*[:=]?\s*([\d,\s\-–—]+)"
PDF_NAME = r"""(?i)([^\s"<>'|]+\.pdf)\b"""

MESSAGE_LIMIT = 3900
_SOURCE = "array<struct<index:int,lines:array<string>>>"


def printed(c: Column) -> Column:
    """Without terminal codes, with plain line ends and single spaces."""
    c = line_ends(F.regexp_replace(F.coalesce(c, F.lit("")), ANSI, ""))
    return stripped(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def _first(lines: Column, pattern: str, after: Column) -> Column:
    """The place, from 1, of the first line behind `after` that matches; behind the last if none does."""
    places = F.filter(F.transform(lines, lambda x, i: F.when((i + 1 > after) & x.rlike(pattern), i + 1)), lambda p: p.isNotNull())
    return F.coalesce(F.try_element_at(places, F.lit(1)), F.size(lines) + 1)


def answer_text(output: Column) -> Column:
    """What stands between the answer's mark (or the beginning) and the sources' mark; the refusal, if
    the output holds it anywhere."""
    text = printed(output)
    lines = F.split(text, "\n")
    start = _first(lines, ANSWER_MARK, F.lit(0))
    marked = start <= F.size(lines)
    begin = F.when(marked, start).otherwise(1)
    end = _first(lines, SOURCES_MARK, begin - 1)
    body = F.slice(lines, begin, F.greatest(end - begin, F.lit(0)))
    inline = F.transform(body, lambda x: F.when(marked & x.rlike(ANSWER_MARK), F.nullif(stripped(F.regexp_extract(x, ANSWER_MARK, 1)), F.lit(""))).otherwise(x))
    joined = printed(F.array_join(F.array_compact(inline), "\n"))
    return F.when(F.contains(F.lower(text), F.lit(REFUSAL)), REFUSAL_ANSWER).otherwise(joined)


def source_lines(output: Column) -> Column:
    """The entries behind the sources' mark, each with its number and lines."""
    lines = F.split(printed(output), "\n")
    behind = F.slice(lines, _first(lines, SOURCES_MARK, F.lit(0)) + 1, F.size(lines))
    behind = F.filter(behind, lambda x: ~x.rlike(SOURCES_MARK))

    def add(found: Column, line: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(line, SOURCE_START, 1), F.lit("")), F.regexp_extract(line, SOURCE_START, 2)).cast("int")
        rest = stripped(F.regexp_extract(line, SOURCE_START, 3))
        begun = F.array(F.struct(number.alias("index"), F.when(rest == "", F.array().cast("array<string>")).otherwise(F.array(rest)).alias("lines")))
        last = F.element_at(found, -1)
        longer = F.array(F.struct(last["index"].alias("index"), F.concat(last["lines"], F.array(line)).alias("lines")))
        more = F.when(F.size(found) > 0, F.concat(F.slice(found, F.lit(1), F.size(found) - 1), longer)).otherwise(found)
        return F.when(line.rlike(SOURCE_START), F.concat(found, begun)).otherwise(more).cast(_SOURCE)

    return F.aggregate(behind, F.array().cast(_SOURCE), add)


def _field(raw: Column, name: str, following: str | None) -> Column:
    pattern = rf"(?is){name}=(.*?)\s+\|\s+{following}=" if following else rf"(?is){name}=(.*)\z"
    return F.nullif(stripped(F.regexp_extract(raw, pattern, 1)), F.lit(""))


def _numbers(tokens: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, page_numbers))))


def _mentioned(raw: Column) -> Column:
    """Page numbers in anchors and behind words for a page."""
    anchors = F.transform(F.regexp_extract_all(raw, F.lit(r"(?i)#page=(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    lists = F.regexp_extract_all(raw, F.lit(PAGE_WORDS), F.lit(1))
    tokens = F.filter(F.flatten(F.transform(lists, lambda x: F.split(x, r"[,\s]+"))), lambda x: x != "")
    return F.array_sort(F.array_union(anchors, _numbers(tokens)))


def parse(outputs: DataFrame) -> DataFrame:
    """question_id, model_answer, sources (index, title, raw, url, page_numbers, filename) of outputs
    (question_id, stdout)."""
    rows = outputs.select("question_id", answer_text(F.col("stdout")).alias("model_answer"), source_lines(F.col("stdout")).alias("entries"))
    one = rows.select("question_id", F.posexplode("entries").alias("at", "e")).select("question_id", "at", "e.index", "e.lines", printed(F.array_join("e.lines", "\n")).alias("raw"))
    raw = F.col("raw")
    url, pages = _field(raw, "url", None), _field(raw, "pages", "url")
    told = F.when(pages.isNotNull(), _numbers(F.split(pages, ","))).otherwise(F.array().cast("array<int>"))
    title = F.regexp_replace(F.coalesce(_field(raw, "title", "pages"), stripped(F.try_element_at("lines", F.lit(1))), F.lit("")), r"(?U)\s+", " ")

    def pdf(c: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(c, PDF_NAME, 1), r"[.,);\]]+\z", "")
        name = basename(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name))
        return F.when(F.lower(name).endswith(".pdf"), name)

    named = F.coalesce(_field(raw, "filename", "title"), pdf(raw), pdf(title), pdf(F.try_parse_url(url, F.lit("PATH"))))
    source = F.struct(
        "at", "index", title.alias("title"), raw.alias("raw"), url.alias("url"),
        F.when(F.size(told) > 0, told).otherwise(_mentioned(raw)).alias("page_numbers"), named.alias("filename"),
    )
    lists = one.groupBy("question_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    return rows.select("question_id", "model_answer").join(lists, "question_id", "left")


def cut_message(text: str, limit: int = MESSAGE_LIMIT) -> list[str]:
    """A text that fits is one part as it is. A longer one is cut at the last line break within the
    limit (not at its very beginning), or at the limit; parts lose the space at their ends."""
    at, end, parts = 0, len(text), []
    while end - at > limit:
        line_end = text.rfind("\n", at, at + limit)
        stop = line_end if line_end > at else at + limit
        parts.append(text[at:stop].strip())
        left = text[stop:end].strip()
        at = text.index(left, stop) if left else end
        end = at + len(left)
    return [*parts, text[at:end]] if end > at else parts


@F.pandas_udf(T.ArrayType(T.StringType()))
def message_parts(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: cut_message(t or ""))
