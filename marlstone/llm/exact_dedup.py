"""Exact dedup by a Golomb-coded fingerprint exchange.

1. One scan gives each row its 64-bit fingerprint and SHA-256 (of the text without white space)
   and its length; these small rows are written once.
2. Each partition sorts its distinct fingerprints and sends every owner (a range of the
   fingerprint space) its share as Golomb-Rice coded gaps, with a bit for each that it holds twice.
3. An owner merges the lists that it gets, and answers each with a bitmap of the fingerprints that
   occur more than once.
4. The partitions turn bitmaps back into suspects. Only suspects' texts are shuffled: grouped by
   their bytes, copies within a partition collapse before the shuffle. A digest with two different
   texts stops the job; so equal digests mean equal bytes.
5. Of each group the row with the most code points, then the smallest doc_id, stays.

Defined results: a null text counts as empty, and all texts without a visible character are equal.
A null doc_id loses ties against any other. Repeated rows are copies like any others: one stays.
Empty tables give an empty result. Other columns are not read by `groups`, and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import hinted, materialize, partitions, ship

#: Fingerprints that an owner gets, about.
OWNER_FINGERPRINTS = 2_000_000
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


# Golomb-Rice codes of sorted 64-bit fingerprints -------------------------------------------------


def encode(sorted_hashes: np.ndarray, low: int, width: int) -> tuple[int, bytes, bytes]:
    """(k, unary, binary) of the gaps between hashes in [low, low + width): quotients by 2**k as
    runs of ones ended by a zero, remainders as k bits each."""
    n = len(sorted_hashes)
    gaps = np.diff(sorted_hashes, prepend=np.uint64(low))
    k = min(63, max(0, int(width // max(n, 1)).bit_length() - 1))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 0
    rest = gaps & np.uint64((1 << k) - 1)
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    binary = ((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(binary).tobytes()


def decode(n: int, low: int, k: int, unary: bytes, binary: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(binary, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    rest = (bits << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) | rest
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


MESSAGE = "part long, first long, last long, owner int, n long, k int, unary binary, bits binary, twice binary"
BITMAP = "part long, first long, last long, owner int, bitmap binary"


def _bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def _flags(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n] == 1


def _owner(hashes: np.ndarray, owners_log2: int) -> np.ndarray:
    if not owners_log2:
        return np.zeros(len(hashes), np.int64)
    return (hashes >> np.uint64(64 - owners_log2)).astype(np.int64)


def _runs(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, start, end) of each run."""
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[:1] - 1)).tolist()
    return [(int(sorted_keys[i]), i, j) for i, j in zip(starts, [*starts[1:], len(sorted_keys)], strict=True)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _send(owners_log2: int):
    """Messages of a task: for each partition that it holds rows of, one to each owner."""
    width = 1 << (64 - owners_log2)
    types = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 3
    names = ["part", "first", "last", "owner", "n", "k", "unary", "bits", "twice"]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [
            (b.column("part").to_numpy(), b.column("place").to_numpy(), b.column("fingerprint").to_numpy())
            for b in batches
            if b.num_rows
        ]
        if not got:
            return
        part, place, prints = map(np.concatenate, zip(*got, strict=True))
        for p in np.unique(part):
            mine = part == p
            hashes, counts = np.unique(prints[mine].view(np.uint64), return_counts=True)
            first, last, rows = int(place[mine].min()), int(place[mine].max()), []
            for o, lo, hi in _runs(_owner(hashes, owners_log2)):
                k, unary, bits = encode(hashes[lo:hi], o * width, width)
                rows.append((int(p), first, last, o, hi - lo, k, unary, bits, _bitmap(counts[lo:hi] > 1)))
            yield _batch(rows, schema)

    return send


def _answer(owners_log2: int):
    """An owner's bitmaps: bit i for a message says that its i-th fingerprint occurs again."""
    width = 1 << (64 - owners_log2)
    schema = pa.schema([(x, pa.int64()) for x in ("part", "first", "last")] + [("owner", pa.int32()), ("bitmap", pa.binary())])

    def answer(messages: pa.Table) -> pa.Table:
        rows = messages.to_pylist()
        lists = [decode(r["n"], r["owner"] * width, r["k"], r["unary"], r["bits"]) for r in rows]
        twice = [own[_flags(r["twice"], r["n"])] for r, own in zip(rows, lists, strict=True)]
        values, counts = np.unique(np.concatenate(lists + twice), return_counts=True)
        again = values[counts > 1]
        out = [
            (r["part"], r["first"], r["last"], r["owner"], _bitmap(np.isin(own, again)))
            for r, own in zip(rows, lists, strict=True)
        ]
        return pa.Table.from_batches([_batch(out, schema)])

    return answer


def _receive(owners_log2: int):
    """The suspects of a partition, from its rows and the bitmaps that came back."""

    def receive(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        place = rows.column("place").to_numpy()
        hashes = rows.column("fingerprint").to_numpy().view(np.uint64)
        owner = _owner(hashes, owners_log2)
        found = [np.zeros(0, np.uint64)]
        for m in bitmaps.to_pylist():
            own = np.unique(hashes[(owner == m["owner"]) & (place >= m["first"]) & (place <= m["last"])])
            found.append(own[_flags(m["bitmap"], len(own))])
        return pa.table({"fingerprint": pa.array(np.unique(np.concatenate(found)).view(np.int64))})

    return receive


def fingerprints(docs: DataFrame) -> DataFrame:
    """A small row for each document; part and place say where it is."""
    text = normalised(F.col("text"))
    place = F.monotonically_increasing_id()
    return docs.select(
        F.col("doc_id"),
        F.sha2(text, 256).alias("text_sha256"),
        F.xxhash64(text).alias("fingerprint"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("length"),
        place.alias("place"),
        F.shiftright(place, 33).alias("part"),
    )


def suspects(prints: DataFrame, owners_log2: int) -> DataFrame:
    """Distinct fingerprints that occur in more than one row of prints."""
    rows = prints.select("part", "place", "fingerprint")
    messages = rows.mapInArrow(_send(owners_log2), MESSAGE)
    bitmaps = messages.groupBy("owner").applyInArrow(_answer(owners_log2), BITMAP)
    back = rows.groupBy("part").cogroup(bitmaps.groupBy("part"))
    return back.applyInArrow(_receive(owners_log2), "fingerprint long").distinct()


def verified(docs: DataFrame, suspect: DataFrame) -> DataFrame:
    """text_sha256 and the number of rows of each text that occurs again, by comparing bytes: the
    suspects' rows are grouped by the text itself, first within each partition."""
    texts = docs.select(normalised(F.col("text")).alias("bytes")).withColumn("fingerprint", F.xxhash64("bytes"))
    found = texts.join(suspect, "fingerprint", "left_semi")
    same_bytes = found.groupBy(F.sha2("bytes", 256).alias("text_sha256"), "bytes").agg(F.count(F.lit(1)).alias("rows"))
    digests = same_bytes.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("rows"))
    clash = F.raise_error(F.lit("two different texts have one SHA-256")).cast("long")
    return digests.where("rows > 1").select("text_sha256", F.when(F.col("texts") == 1, F.col("rows")).otherwise(clash).alias("rows"))


def _classes(docs: DataFrame, owners_log2: int | None) -> tuple[DataFrame, DataFrame]:
    """The small rows of all documents; of each group of equal texts, which row stays."""
    spark = docs.sparkSession
    ship(spark)
    prints = materialize(fingerprints(docs), "fingerprints")
    if owners_log2 is None:
        # As many owners as tasks run at once, and more if each would get too many fingerprints.
        owners_log2 = max(min(11, partitions(spark).bit_length() - 1), min(20, (prints.count() // OWNER_FINGERPRINTS).bit_length()))
    suspect = hinted(materialize(suspects(prints, owners_log2), "suspects"), 48)
    rank = F.struct("length", F.bitwise_not("doc_id").alias("first"), F.bitwise_not("place").alias("place"))
    best = prints.groupBy("text_sha256").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    best = best.join(verified(docs, suspect), "text_sha256").select(
        "text_sha256",
        F.bitwise_not("best.first").alias("keep_id"),
        F.bitwise_not("best.place").alias("keep_place"),
        F.col("best.length").alias("keep_length"),
        F.col("rows").alias("group_size"),
    )
    return prints, hinted(materialize(best, "classes"), 200)  # written, so that a hot digest's rows can be split


def groups(docs: DataFrame, owners_log2: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    prints, best = _classes(docs, owners_log2)
    alone = F.col("group_size").isNull()
    return prints.join(best, "text_sha256", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("place") == F.col("keep_place"))).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame, owners_log2: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    prints, best = _classes(docs, owners_log2)
    best = best.select("text_sha256", "keep_id", "keep_length")
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*names.values())
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"])
    joined = inner.withColumn("text_sha256", F.sha2(normalised(text), 256)).join(best, "text_sha256", "left")
    alone = F.col("keep_length").isNull()
    stays = doc_id.eqNullSafe(F.col("keep_id")) & (F.length(F.coalesce(text, F.lit(""))) == F.col("keep_length"))
    kept = joined.where(alone | stays)
    # Rows that repeat with their doc_id: one of them stays. Else nothing is shuffled here.
    if prints.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        kept = kept.where(alone).unionByName(kept.where(~alone).dropDuplicates(["text_sha256"]))
    return kept.select([F.col(v).alias(k) for k, v in names.items()])


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept
  FROM d
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM w
"""
