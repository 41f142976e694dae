"""File names, identifiers and addresses."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import positive_int, squeezed, stripped


@F.pandas_udf(T.StringType())
def unaccented(names: pd.Series) -> pd.Series:
    """Decomposed, without marks. Spark has no such function; apply it to names, not to texts."""
    return names.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    return names.str.casefold()


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def registry_key(filename: Column) -> Column:
    """The key that file names of one document share."""
    plain = F.regexp_replace(stripped(F.lower(unaccented(basename(filename)))), r"\.pdf\z", "")
    return stripped(F.regexp_replace(plain, "(?i)[^a-zа-я0-9]+", " "))


def evaluation_key(filename: Column) -> Column:
    """As in answers: percent-decoded, without quotes, path, query and fragment; keeps the suffix."""
    c = F.try_url_decode(F.replace(F.coalesce(filename, F.lit("")), F.lit("+"), F.lit("%2B")))
    c = F.btrim(stripped(F.coalesce(c, filename)), F.lit("\"' "))
    c = F.substring_index(F.substring_index(F.translate(c, "\\", "/"), "#", 1), "?", 1)
    return F.coalesce(folded(squeezed(unaccented(basename(c)))), F.lit(""))


def slug(stem: Column) -> Column:
    c = F.regexp_replace(F.lower(stripped(stem)), r"(?U)[^\w\-]+", "_")
    c = F.btrim(F.regexp_replace(c, "_+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown_doc"))


def safe_filename(c: Column) -> Column:
    return squeezed(F.regexp_replace(c, r'[<>:"/\\|?*]+', "_"))


def point_id(filename: Column, chunk_id: Column) -> Column:
    """The first 64 bits of a digest, unsigned, as a decimal string."""
    return F.conv(F.left(F.sha1(F.concat(filename, F.lit(":"), chunk_id)), F.lit(16)), 16, 10)


def page_anchor(url: Column, page: Column) -> Column:
    p = positive_int(page)
    return F.when(p.isNull(), url).otherwise(F.concat(F.substring_index(url, "#", 1), F.lit("#page="), p.cast("string"), F.lit("&zoom=page-fit")))


def source_url(base: str | None, bucket: Column, key: Column, source: Column, page: Column) -> Column:
    """base/bucket/key with the key percent-encoded, or the raw source; with the page as anchor."""
    quoted = F.replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    public = F.concat(F.lit((base or "").rstrip("/")), F.lit("/"), bucket, F.lit("/"), quoted)
    known = F.lit(bool(base)) & (F.coalesce(bucket, F.lit("")) != "") & (F.coalesce(key, F.lit("")) != "")
    return page_anchor(F.when(known, public).otherwise(F.coalesce(source, F.lit(""))), page)


def is_public_url(url: Column) -> Column:
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False)) & (host != "") & ~F.lower(host).isin("localhost", "127.0.0.1", "::1", "[::1]")
