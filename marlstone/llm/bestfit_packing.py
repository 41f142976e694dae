"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised word by word through a bounded cache, followed by an end id; only longer
ones are cut into pieces of the capacity. Pieces that fill a sequence stand alone. The others are
dealt by a hash of their place in the written table (so equal pieces don't meet in one task) into
buckets of about `per_bucket` pieces, and each bucket is packed online: a fixed number
of open bins, indexed by a bitset keyed by free space; a piece goes to the bin with the least free
space that holds it; if there is none and all bins are open, the fullest closes first. Pieces come
in a fixed shuffled order, sorted within windows no larger than the number of open bins.

Defined results: a null text is empty, so it is one piece with the end id alone. A null doc_id is
packed like any other and stays null. Repeated rows are packed once each. An empty table gives an
empty result. Other columns are not read. Texts of any length are cut, never shortened.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import materialize, ship, worker_cache

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 2048
#: Pieces arrive in windows of this many, the longest of a window first.
WINDOW = 2000
PER_BUCKET = 60_000

#: Entries of each of the two generations of a worker's cache of words.
CACHE_WORDS = 300_000
#: Bytes of text whose words are made distinct together.
CHUNK_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SEPARATOR = "\x00"


class WordEncoder:
    """Ids of a text as little-endian 32-bit words, equal to those of the whole text at once.

    The vocabulary's own rules never join characters across white space, and lower-case all text,
    so words are encoded apart and kept. Special tokens are matched before lower-casing: texts that
    may hold one keep their case.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        separator = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.separator = separator[0] if len(separator) == 1 else -1
        suffix = self.tokenizer.model.end_of_word_suffix or "\x00"
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _encode(self, words: list[bytes]) -> None:
        """Many words are encoded as one text. A word of letters alone ends with its only token that
        ends a word; other words get a separator between them."""
        texts = [w.decode("utf-8", "replace") for w in words]
        letters = [t.isalpha() and t.lower().isalpha() for t in texts]
        rest = []
        for whole, glue in ((True, " "), (False, f" {_SEPARATOR} ")):
            own = [i for i, x in enumerate(letters) if x is whole]
            runs = [own[i : i + 4096] for i in range(0, len(own), 4096)]
            joined = [glue.join([texts[i] for i in run]) for run in runs]
            for run, coded in zip(runs, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(coded.ids, "<u4")
                if whole:
                    ends = np.flatnonzero(self.last[ids]) + 1
                    starts = np.append(0, ends[:-1])
                else:
                    ends = np.append(np.flatnonzero(ids == self.separator), len(ids))
                    starts = np.append(0, ends[:-1] + 1)
                if len(ends) != len(run):  # a word that holds the separator, or is no single piece
                    rest += run
                    continue
                data = ids.tobytes()
                self.known.update({words[i]: data[x:y] for i, x, y in zip(run, (4 * starts).tolist(), (4 * ends).tolist(), strict=True)})
        for i in rest:
            ids = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
            self.known[words[i]] = np.array(ids, "<u4").tobytes()

    def _recall(self, words: set[bytes]) -> set[bytes]:
        """Words that neither generation has; those of the older one move to the newer."""
        if not self.older:
            return words
        again = [w for w in words if w in self.older]
        self.known.update((w, self.older[w]) for w in again)
        return words.difference(again)

    def _learn(self, words: list[bytes]) -> None:
        """Make distinct words known, all at once."""
        new = {w for w in words if w not in self.known}
        if not new:
            return
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.older = {}, self.known
            new = set(words)
        new = self._recall(new)
        stems = {w: w[:-1] for w in new if w[-1:] in (b",", b".") and w[-2:-1].isalpha() and b"<|" not in w}
        wanted = new.difference(stems).union(stems.values(), (b",", b".")).difference(self.known)
        self._encode(sorted(self._recall(wanted)))
        for w, stem in stems.items():
            self.known[w] = self.known[stem] + self.known[w[-1:]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end. Words are made distinct in
        Arrow, so that each is looked up once, and ids are gathered by place."""
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        self._learn(words)
        found = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begins = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        place = coded.indices.to_numpy()
        counts = sizes[place]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(begins[place] - (ends - counts), counts) + np.arange(counts.sum())]
        words_before = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return ids, np.append(0, ends)[words_before]


def _encoder(definition: str) -> WordEncoder:
    return worker_cache(f"word encoder {zlib.crc32(definition.encode())}", lambda: WordEncoder(definition))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())  # a vocabulary: a few MB
    end = np.array([end_id], "<u4").tobytes()
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(("doc_id", "piece", "start", "length", "ids_crc32"), types, strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for b in batches:
            doc_ids, column = b.column("doc_id").to_pylist(), b.column("text")
            rows: list[tuple] = []
            before = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                ids, ends = encoder.encode(column.slice(start, stop - start))
                ends = ends.tolist()
                for i, first, last in zip(doc_ids[start:stop], [0, *ends], ends, strict=False):
                    for k, at in enumerate(range(first, last + 1, capacity)):  # the end id stands at `last`
                        size = min(capacity, last + 1 - at)
                        crc = zlib.crc32(ids[at : min(at + size, last)])
                        rows.append((i, k, at - first, size, zlib.crc32(end, crc) if at + size > last else crc))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class OpenBins:
    """At most `limit` open bins of one capacity; bit f of the bitset: a bin with f free is open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.count = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.count -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for an item: the open bin with the least space that holds it, or a new one."""
        fitting = self.bits >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            found, space = self.made, self.capacity
            self.made += 1
        left = space - size
        if left:
            if not self.free[left]:
                self.bits |= 1 << left
            self.free[left].append(found)
            self.count += 1
        return found, self.capacity - space


def pack(
    cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_bucket: int = PER_BUCKET
) -> DataFrame:
    """cut (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. cut is read more than
    once: pass a written table, best with a number for each row in the column place."""
    spark = cut.sparkSession
    ship(spark)
    part = cut.where(F.col("length") < capacity)
    placed = part if "place" in cut.columns else part.withColumn("place", F.monotonically_increasing_id())
    buckets = max(1, -(-part.count() // per_bucket))
    cut = cut.drop("place")
    names = cut.columns
    key = F.xxhash64("place")

    def fill(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        rows = rows.sort_by([("order", "ascending"), ("place", "ascending")])
        bins = OpenBins(capacity, open_bins)
        lengths = rows.column("length").to_numpy()
        window = np.arange(len(lengths)) // min(WINDOW, open_bins)
        rows = rows.take(np.lexsort((-lengths, window)))
        placed = [bins.place(n) for n in rows.column("length").to_pylist()]
        sequence, offset = np.array(placed, np.int64).reshape(-1, 2).T
        return rows.select(names).append_column("sequence_id", pa.array(sequence + (bucket << 40))).append_column("offset", pa.array(offset))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    packed = (
        placed.withColumns({"order": key, "bucket": F.pmod(key, F.lit(buckets))})
        .groupBy("bucket")
        .applyInArrow(fill, f"{types}, sequence_id long, offset long")
    )
    full = cut.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer_path).withColumn("place", F.monotonically_increasing_id()), "pieces"))
