"""Media types of files by their names, with the table of Python's library."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.names import basename

UNKNOWN = "application/octet-stream"
#: The library's own table; what the machine at hand adds to it is left out, so that all executors agree.
_TABLE = mimetypes.MimeTypes()


def suffix(name: Column) -> Column:
    """The last suffix of a file's name with its dot, or nothing; dots at the beginning are no suffix."""
    return F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]+)$", 1)


def _lookup(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in sorted(entries.items()) for x in pair)), key)


def _without(name: Column, end: Column) -> Column:
    return F.left(name, F.length(name) - F.length(end))


def mime(path: Column) -> Column:
    """The type of a file: short suffixes stand for two (.tgz for .tar.gz), and a suffix that says how the
    content is packed is passed over."""
    name = basename(path)
    longer = _lookup(_TABLE.suffix_map, F.lower(suffix(name)))
    name = F.coalesce(F.concat(_without(name, suffix(name)), longer), name)
    packed = suffix(name).isin(*_TABLE.encodings_map)
    name = F.when(packed, _without(name, suffix(name))).otherwise(name)
    return F.coalesce(_lookup(_TABLE.types_map[True], F.lower(suffix(name))), F.lit(UNKNOWN))
