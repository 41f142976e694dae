"""Text expressions as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and texts whose results must be those of the queries that exist.
IR_TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"
MATCH_TOKEN = "[A-Za-zА-Яа-яЁё0-9-]+"
CITATION = r"\[(\d+)\]"
ANSWER_SENTENCE = r"[^.!?]+[.!?]+|[^.!?]+$"
REFUSAL = "в источниках нет ответа"
REFUSAL_ANSWER = "В источниках нет ответа."
EDGE_PUNCTUATION = r""" .!?:;"'«»()[]{}"""
PAGE_NUMBER_LINE = r"^[\-\–\—\s]*\d{1,4}[\-\–\—\s]*$"
NOISE_LINE = r"^[\-\–\—\_\.\,\:\;\*\·\•\s]+$"
ANSI = "\x1b(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])"
#: Characters of the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HYPHEN_BREAK = "([A-Za-zА-Яа-яЁё])-\n([A-Za-zА-Яа-яЁё])"


def stripped(c: Column) -> Column:
    """Without white space at the ends (Spark's plain trim knows only the space)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeezed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def invisible_out(c: Column) -> Column:
    """NUL and no-break space become spaces; zero-width space and byte-order mark go."""
    return F.translate(c, "\x00\xa0​﻿", "  ")


def line_spaces(c: Column) -> Column:
    return stripped(F.regexp_replace(invisible_out(c), "[ \t]+", " "))


def line_ends(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def page_breaks(c: Column) -> Column:
    c = line_ends(invisible_out(c))
    return stripped(F.regexp_replace(c, "\n{3,}", "\n\n"))


def joined_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, HYPHEN_BREAK, "$1$2")


def is_noise(c: Column) -> Column:
    """Of a line whose spaces are normal."""
    return (c == "") | c.rlike(f"(?U){NOISE_LINE}|{PAGE_NUMBER_LINE}")


def clean_lines(text: Column) -> Column:
    """The useful lines of a raw page, as an array; their spaces are as line_spaces makes them."""
    spaced = F.regexp_replace(line_ends(invisible_out(joined_hyphens(text))), "[ \t]+", " ")
    return F.filter(F.transform(F.split(spaced, "\n"), stripped), lambda x: ~is_noise(x))


def tidy_punctuation(c: Column) -> Column:
    """Of lines joined by line breaks, none of which begins or ends with white space."""
    space = r"(?U)[\s&&[^\n]]+"
    c = F.regexp_replace(c, space + r"([,.;:!?)\]\}])", "$1")
    return F.regexp_replace(c, r"(?U)([(\[\{])[\s&&[^\n]]+", "$1")


def ir_tokens(text: Column) -> Column:
    """Tokens of two characters at least."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(IR_TOKEN[:-1] + "{2,}"), F.lit(0))


def match_text(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), CITATION, ""))


def match_tokens(c: Column) -> Column:
    """Distinct tokens of a text that has been through match_text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(MATCH_TOKEN), F.lit(0)), lambda t: F.length(t) >= 3))


def answer_sentences(c: Column) -> Column:
    found = F.regexp_extract_all(stripped(F.coalesce(c, F.lit(""))), F.lit(ANSWER_SENTENCE), F.lit(0))
    return F.filter(F.transform(found, stripped), lambda s: s != "")


def prose_sentences(c: Column) -> Column:
    """Sentences that end before a capital, a digit or an opening sign."""
    parts = F.split(squeezed(c), r"""(?U)(?<=[.!?…])\s+(?=[A-ZА-ЯЁ0-9"«(])""")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def without_edges(c: Column) -> Column:
    """Without punctuation and spaces at the ends."""
    return F.btrim(c, F.lit(EDGE_PUNCTUATION))


def refuses(answer: Column) -> Column:
    """At run time: an answer that holds the refusal."""
    return F.contains(without_edges(squeezed(F.lower(F.coalesce(answer, F.lit(""))))), F.lit(REFUSAL))


def is_refusal(answer: Column) -> Column:
    """In evaluation: an answer that is the refusal."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), ANSI, "")
    text = F.regexp_replace(line_ends(text), "[ \t]+", " ")
    return without_edges(stripped(F.lower(F.regexp_replace(text, "\n{3,}", "\n\n")))) == REFUSAL


def preview(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most)), F.lit("...")))


def shortened(c: Column, limit: int = 220) -> Column:
    c = squeezed(c)
    cut = F.regexp_replace(F.left(c, F.lit(limit - 1)), r"(?U)\s+\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def positive_int(c: Column) -> Column:
    """An integer above zero, else null."""
    n = F.try_cast(c, "int") if hasattr(F, "try_cast") else c.try_cast("int")
    return F.when(n > 0, n)


def first_filled(*columns: Column) -> Column:
    """The first column that is not null or blank, stripped."""
    return F.coalesce(*(F.nullif(stripped(c.cast("string")), F.lit("")) for c in columns))


def page_numbers(token: Column) -> Column:
    """"7", "3-5" or "3–5" as an array; long or falling ranges give their ends, others nothing."""
    t = F.translate(stripped(token), "–—", "--")
    a = F.regexp_extract(t, r"^(\d+)-(\d+)$", 1).try_cast("int")
    b = F.regexp_extract(t, r"^(\d+)-(\d+)$", 2).try_cast("int")
    single = F.regexp_extract(t, r"^(\d+)$", 1).try_cast("int")
    short = (a <= b) & (b - a <= 20)
    return (
        F.when(single.isNotNull(), F.array(single))
        .when(short, F.sequence(a, b))
        .when(a.isNotNull() & b.isNotNull(), F.array(a, b))
        .otherwise(F.array().cast("array<int>"))
    )
