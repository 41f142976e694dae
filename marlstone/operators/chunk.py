"""Sentence-aware chunks. Greedy packing depends on order, so pages are cut in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import WHITE_SPACE
from marlstone.scratch import ship

SIZE, SHORT_TAIL = 900, 180
#: Bytes of text that a task cuts at once.
CUT_AT_ONCE = 1 << 20
#: A page has chunks if it has a character that is none of these.
BLANK = WHITE_SPACE + "\x1c\x1d\x1e\x1f"
FULL_ENOUGH, TAIL_ROOM = 0.6, 1.35
# Where texts may be cut.
SENTENCE_BREAK = re.compile(r'(?<=[.!?…])\s+(?=[A-ZА-ЯЁ0-9"«(])')
CLAUSE_BREAK = re.compile(r"(?<=[;:,])\s+")


def pack(parts: list[str], room: int) -> Iterator[str]:
    """Parts joined by spaces into runs of at most room characters; a longer part stands alone."""
    held: list[str] = []
    length = -1
    for p in parts:
        if held and length + 1 + len(p) > room:
            yield " ".join(held)
            held, length = [], -1
        held.append(p)
        length += 1 + len(p)
    if held:
        yield " ".join(held)


def by_words(text: str, room: int) -> list[str]:
    """Words packed into room; the end of a word longer than room is packed with what follows."""
    cut: list[str] = []
    for word in text.split():
        cut += [word[i : i + room] for i in range(0, len(word), room)]
    return list(pack(cut, room))


def fitted(sentence: str, room: int) -> list[str]:
    """A sentence in pieces of at most room: at clauses if it has any, else between words."""
    if len(sentence) <= room:
        return [sentence]
    clauses = [c for c in (x.strip() for x in CLAUSE_BREAK.split(sentence)) if c]
    if len(clauses) < 2:
        return by_words(sentence, room)
    small: list[str] = []
    out: list[str] = []
    for c in clauses:
        if len(c) <= room:
            small.append(c)
            continue
        out += pack(small, room)
        *whole, last = by_words(c, room)
        out += whole
        small = [last]  # the next clauses may still fit behind it
    return out + list(pack(small, room))


def paragraphs(text: str) -> list[str]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [p for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n", text)) if p]


def page_chunks(text: str, size: int = SIZE, short_tail: int = SHORT_TAIL) -> list[str]:
    """The chunks of a page: the page itself if it fits, else sentences packed to size. A paragraph's
    end closes a chunk that is full enough, and a short tail joins the chunk before it if it fits."""
    paras = paragraphs(text)
    whole = "\n\n".join(paras)
    if len(whole) <= size:
        return [whole] if whole else []
    chunks: list[str] = []
    open_part: list[str] = []
    for para in paras:
        pieces = [p for s in SENTENCE_BREAK.split(para) if s.strip() for p in fitted(s.strip(), size)]
        *done, last = pack(open_part + pieces, size)
        chunks += done
        open_part = [last]
        if len(last) >= int(FULL_ENOUGH * size):
            chunks.append(last)
            open_part = []
    chunks += open_part
    if len(chunks) > 1 and len(chunks[-1]) < short_tail and len(chunks[-2]) + 1 + len(chunks[-1]) <= int(TAIL_ROOM * size):
        tail = chunks.pop()
        chunks[-1] += " " + tail
    return chunks


def chunked(pages: DataFrame, size: int = SIZE, short_tail: int = SHORT_TAIL) -> DataFrame:
    """doc_id, title, source_pdf, page_num, page_start, page_end, chunk_index, chunk_id, text, chars of
    pages (doc_id, title, source_pdf, page_num, text)."""

    ship(pages.sparkSession)
    kept, at_once = ("doc_id", "title", "source_pdf", "page_num"), CUT_AT_ONCE

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy()) // at_once
            cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):  # so that what is held doesn't grow with the batch
                part = b.slice(start, stop - start)
                lists = [page_chunks(t or "", size, short_tail) for t in part.column("text").to_pylist()]
                of = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), pa.int64())
                at = pa.array([i for x in lists for i in range(len(x))], pa.int32())
                cut_texts = pa.array([c for x in lists for c in x], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in kept), at, cut_texts], [*kept, "at", "chunk"])

    pages = pages.select(*kept, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema if f.name != "text")
    rows = pages.mapInArrow(cut, f"{kinds}, at int, chunk string")
    return rows.select(
        "doc_id", "title", "source_pdf", "page_num",
        F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"),
        (F.col("at") + 1).alias("chunk_index"),
        F.format_string("%s_p%04d_c%03d", "doc_id", "page_num", F.col("at") + 1).alias("chunk_id"),
        F.col("chunk").alias("text"), F.length("chunk").alias("chars"),
    )


def stats(chunks: DataFrame) -> DataFrame:
    """One row of totals."""
    return chunks.agg(
        F.countDistinct("doc_id").alias("total_docs"),
        F.countDistinct("doc_id", "page_num").alias("total_pages_with_text"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.min("chars").alias("chunk_chars_min"),
        F.max("chars").alias("chunk_chars_max"),
        F.round(F.avg("chars"), 2).alias("chunk_chars_avg"),
    )


def stats_by_doc(chunks: DataFrame) -> DataFrame:
    first = F.struct("page_num", "chunk_index")
    return chunks.groupBy("doc_id").agg(
        F.min_by("title", first).alias("title"), F.min_by("source_pdf", first).alias("source_pdf"), F.countDistinct("page_num").alias("pages_with_text"), F.count(F.lit(1)).alias("chunks")
    )
