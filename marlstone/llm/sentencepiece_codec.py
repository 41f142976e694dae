"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is encoded as the sequence of pieces of the highest total log score, after a marker has been
put before it and in place of every space. A character that no piece has becomes its UTF-8 bytes.
Decoding joins the pieces, turns markers into spaces and drops the first one.

No piece but runs of markers has a marker after its first place, and none has a line break, so the
best sequence is that of its parts: each space with what follows it, and each line. Parts are kept
in a bounded cache; the new ones of many texts run through the Viterbi together, byte by byte.

A vocabulary of the unigram kind brings its log scores. One of the BPE kind has ranks instead; they
become log scores by the Zipf-Mandelbrot law: -ln(rank + ZIPF_SHIFT), normalised. Nothing is trained.

Defined results: null and empty texts have no pieces. A marker in the text itself decodes to a space,
so such a text does not come back unchanged (round_trip is false). Null and unknown ids decode to a
replacement character. Texts of any length are encoded
whole. A null doc_id stays null, repeated rows are encoded once each, empty tables give an empty
result, and other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import chunks, ship, worker_cache

MARKER = "▁"
MARK = MARKER.encode()
REPLACEMENT = "\ufffd".encode()
ZIPF_SHIFT = 2.7
UNKNOWN_PENALTY = 10.0

CACHE_PARTS = 600_000
LONGEST_CACHED = 256
#: Bytes of parts that run through the Viterbi together, at most, and parts at once.
LONGEST_TOGETHER = 64
PARTS_AT_ONCE = 8_192

_NORMAL, _UNKNOWN, _USER, _BYTE, _UNIGRAM = 1, 2, 4, 6, 1


@dataclass
class DoubleArray:
    """Children of a node are at base[node] + byte, and check says whose they are."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: dict[bytes, int]) -> DoubleArray:
        ordered = sorted(keys)
        size = 1 << 12
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        lowest = 1
        todo = [(0, 0, len(ordered), 0)]  # node, its keys from and to, its depth
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(ordered[lo]) == depth:
                value[node] = keys[ordered[lo]]
                lo += 1
            if lo == hi:
                continue
            heads = np.array([ordered[i][depth] for i in range(lo, hi)])
            starts = np.flatnonzero(np.diff(heads, prepend=-1))
            children = heads[starts]
            window = 1024
            while True:  # the first place where all children are free
                free = np.flatnonzero(check[lowest : min(lowest + window, len(check) - 256)] < 0) + lowest
                places = free[free > children[0]] - children[0]
                ok = places[(check[places[:, None] + children] < 0).all(axis=1)] if len(places) else places
                if len(ok):
                    at = int(ok[0])
                    break
                if lowest + window >= len(check) - 256:
                    grow = len(check)
                    base, value = np.append(base, np.zeros(grow, np.int32)), np.append(value, np.full(grow, -1, np.int32))
                    check = np.append(check, np.full(grow, -1, np.int32))
                window *= 4
            base[node] = at
            check[at + children] = node
            while check[lowest] >= 0:
                lowest += 1
            ends = [*starts[1:], hi - lo]
            todo += [(at + int(c), lo + int(i), lo + int(j), depth + 1) for c, i, j in zip(children, starts, ends, strict=True)]
        return DoubleArray(base, check, value)


@dataclass
class Vocabulary:
    trie: DoubleArray
    scores: list[float]
    unknown: float
    byte_ids: list[int]
    surface: list[bytes]
    is_byte: np.ndarray
    name: str = ""


def vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as protobuf

    model = protobuf.ModelProto()
    model.ParseFromString(Path(path).read_bytes())
    return from_model(model)


def from_model(model) -> Vocabulary:
    """A vocabulary from a parsed model file."""
    pieces = list(model.pieces)
    scores = log_scores(model)
    usable = {p.piece.encode(): i for i, p in enumerate(pieces) if p.type in (_NORMAL, _USER)}
    if any(MARKER in p.strip(MARKER) or p.endswith(MARKER) and p.strip(MARKER) or "\n" in p for p in (k.decode() for k in usable)):
        raise ValueError("pieces with a marker inside or a line break can't be encoded in parts")
    byte_ids = {int(p.piece[3:-1], 16): i for i, p in enumerate(pieces) if p.type == _BYTE}
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary lacks byte pieces")
    surface = [bytes([int(p.piece[3:-1], 16)]) if p.type == _BYTE else p.piece.encode() if p.type in (_NORMAL, _USER) else b"" for p in pieces]
    low = min((s for s, p in zip(scores, pieces, strict=True) if p.type == _NORMAL), default=0.0)
    return Vocabulary(
        DoubleArray.build(usable),
        scores,
        low - UNKNOWN_PENALTY,
        [byte_ids[b] for b in range(256)],
        surface,
        np.array([p.type == _BYTE for p in pieces]),
        f"{len(pieces)}:{zlib.crc32(model.SerializeToString())}",
    )


def log_scores(model) -> list[float]:
    pieces = list(model.pieces)
    if model.trainer_spec.model_type == _UNIGRAM:
        return [p.score for p in pieces]
    ranks = np.array([min(-p.score, len(pieces)) for p in pieces])
    weights = 1.0 / (ranks + ZIPF_SHIFT)
    normal = np.array([p.type in (_NORMAL, _USER) for p in pieces])
    return np.log(weights / weights[normal].sum()).tolist()


@dataclass
class Codec:
    vocabulary: Vocabulary
    marked: dict[bytes, bytes] = field(default_factory=dict)
    bare: dict[bytes, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        trie = self.vocabulary.trie
        self._base, self._check, self._value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self._scores, self._byte_ids = np.array(self.vocabulary.scores), np.array(self.vocabulary.byte_ids, np.int32)
        self.line_break = np.array([self.vocabulary.byte_ids[10]], "<i4").tobytes()

    def best(self, part: bytes) -> bytes:
        """Ids, as little-endian 32-bit words, of the best pieces of a part with its markers."""
        base, check, value, scores = self._base, self._check, self._value, self.vocabulary.scores
        n, unknown = len(part), self.vocabulary.unknown
        reached, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        reached[0] = 0.0
        i = 0
        while i < n:
            lead = part[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            so_far, node, j, single = reached[i], 0, i, False
            while j < n:
                child = base[node] + part[j]
                if check[child] != node:
                    break
                node = child
                j += 1
                v = value[node]
                if v >= 0:
                    if j - i == width:
                        single = True
                    total = so_far + scores[v]
                    if total > reached[j]:
                        reached[j], back[j], piece[j] = total, i, v
            i += width
            if not single and so_far + unknown > reached[i]:
                reached[i], back[i], piece[i] = so_far + unknown, i - width, -1
        ids: list[int] = []
        while n:
            start = back[n]
            if piece[n] >= 0:
                ids.append(piece[n])
            else:
                ids += [self.vocabulary.byte_ids[b] for b in reversed(part[start:n])]
            n = start
        return np.array(ids[::-1], "<i4").tobytes()

    def together(self, parts: list[bytes]) -> list[bytes]:
        """best() of parts of one length: each step of the trie and the Viterbi is made for all of them."""
        trie, scores, byte_ids = self.vocabulary.trie, self._scores, self._byte_ids
        n = len(parts[0])
        data = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), n)
        reached = np.full((len(parts), n + 1), -np.inf)
        back, piece = np.zeros((len(parts), n + 1), np.int32), np.full((len(parts), n + 1), -1, np.int32)
        reached[:, 0] = 0.0
        widths = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        for i in range(n):
            heads = np.flatnonzero((data[:, i] & 0xC0) != 0x80)  # where a character begins
            if not len(heads):
                continue
            single = np.zeros(len(parts), bool)
            rows, node = heads, np.zeros(len(heads), np.int64)
            for j in range(i, n):
                child = trie.base[node] + data[rows, j].astype(np.int64)
                there = trie.check[child] == node
                rows, node = rows[there], child[there]
                if not len(rows):
                    break
                value = trie.value[node]
                hit = np.flatnonzero(value >= 0)
                at, found = rows[hit], value[hit]
                single[at[widths[at, i] == j + 1 - i]] = True
                total = reached[at, i] + scores[found]
                better = total > reached[at, j + 1]
                at = at[better]
                reached[at, j + 1], back[at, j + 1], piece[at, j + 1] = total[better], i, found[better]
            rest = heads[~single[heads]]
            end = i + widths[rest, i]
            total = reached[rest, i] + self.vocabulary.unknown
            better = total > reached[rest, end]
            rest, end = rest[better], end[better]
            reached[rest, end], back[rest, end], piece[rest, end] = total[better], i, -1
        # Each piece's id is put where it begins, those of bytes at the bytes.
        ids, rows, at = np.full((len(parts), n), -1, "<i4"), np.arange(len(parts)), np.full(len(parts), n)
        while len(rows):
            start, found = back[rows, at], piece[rows, at]
            known = found >= 0
            ids[rows[known], start[known]] = found[known]
            for r, a, b in zip(rows[~known].tolist(), start[~known].tolist(), at[~known].tolist(), strict=True):
                ids[r, a:b] = byte_ids[data[r, a:b]]
            more = start > 0
            rows, at = rows[more], start[more]
        flat = ids[ids >= 0].tobytes()
        ends = (4 * np.cumsum((ids >= 0).sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, texts: list[bytes]) -> None:
        """Put the words of texts that stand behind a space into the cache, all new ones together."""
        new: set[bytes] = set()
        for t in texts:
            new.update(t.replace(b"\n", b" ").split(b" "))
        new = {w for w in new.difference(self.marked) if 0 < len(w) <= LONGEST_TOGETHER}
        if len(self.marked) + len(new) > CACHE_PARTS:
            self.marked.clear()
            return self.learn(texts) if len(new) <= CACHE_PARTS // 2 else None
        by_length: dict[int, list[bytes]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        for words in by_length.values():
            for i in range(0, len(words), PARTS_AT_ONCE):
                some = words[i : i + PARTS_AT_ONCE]
                self.marked.update(zip(some, self.together([MARK + w for w in some]), strict=True))
        return None

    def _part(self, cache: dict[bytes, bytes], word: bytes, before: bytes) -> bytes:
        found = cache.get(word)
        if found is None:
            found = self.best(before + word.replace(b" ", MARK))
            if len(word) <= LONGEST_CACHED:
                if len(cache) >= CACHE_PARTS:
                    cache.clear()
                cache[word] = found
        return found

    def _line(self, line: bytes) -> bytes:
        """line: each of its spaces stands for a marker."""
        if b"  " in line:  # runs of markers belong together, and to what follows
            words, parts = line.split(b" "), []
            held = 0
            parts.append(self._part(self.bare, words[0], b""))
            for w in words[1:]:
                held += 1
                if w:
                    parts.append(self._part(self.marked, w, MARK) if held == 1 else self._part(self.bare, b" " * held + w, b""))
                    held = 0
            if held:
                parts.append(self._part(self.bare, b" " * held, b""))
            return b"".join(parts)
        first, *words = line.split(b" ")
        try:
            rest = b"".join(map(self.marked.__getitem__, words))
        except KeyError:
            rest = b"".join([self._part(self.marked, w, MARK) for w in words])
        return self._part(self.bare, first, b"") + rest if first else rest

    def encode(self, text: bytes) -> bytes:
        if not text:
            return b""
        return self.line_break.join([self._line(x) for x in (b" " + text).split(b"\n")])

    def decode_any(self, ids: list[int | None]) -> str:
        """A null id, or one that is not in the vocabulary, becomes a replacement character."""
        surface = self.vocabulary.surface
        return self._text([surface[i] if i is not None and 0 <= i < len(surface) else REPLACEMENT for i in ids])

    def decode(self, ids: list[int]) -> str:
        surface = self.vocabulary.surface
        return self._text([surface[i] for i in ids])

    @staticmethod
    def _text(pieces: list[bytes]) -> str:
        text = b"".join(pieces).replace(MARK, b" ").decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _codec(v: Vocabulary) -> Codec:
    return worker_cache(f"codec {v.name}", lambda: Codec(v))


def encode(docs: DataFrame, model: Vocabulary) -> DataFrame:
    """doc_id, ids of every row of docs (doc_id, text)."""
    return _coded(docs, model, False)


def encode_and_decode(docs: DataFrame, model: Vocabulary) -> DataFrame:
    """encode's columns, and n_pieces, n_bytes (pieces that are bytes), decoded_crc32 (of the text
    decoded from ids, as UTF-8) and round_trip (whether that is the text)."""
    return _coded(docs, model, True)


def _coded(docs: DataFrame, model: Vocabulary, decoded: bool) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # a vocabulary: a few MB
    names = ["doc_id", "ids"] + ["n_pieces", "n_bytes", "decoded_crc32", "round_trip"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            for start, texts in chunks(b.column("text"), 4 << 20):
                codec.learn(texts)
                coded = [codec.encode(t) for t in texts]
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
                ids = np.frombuffer(b"".join(coded), "<i4")
                columns = [b.column("doc_id").slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
                if decoded:
                    flat = ids.tolist()
                    back = [codec.decode(flat[i:j]).encode() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    bytes_before = np.cumsum(np.append(0, codec.vocabulary.is_byte[ids]))
                    columns += [
                        pa.array(np.diff(ends)),
                        pa.array(bytes_before[ends[1:]] - bytes_before[ends[:-1]]),
                        pa.array([zlib.crc32(x) for x in back], pa.int64()),
                        pa.array([x == t for x, t in zip(back, texts, strict=True)]),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names)

    types = "doc_id long, ids array<int>" + ", n_pieces long, n_bytes long, decoded_crc32 long, round_trip boolean" * decoded
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, types)


def decode(coded: DataFrame, model: Vocabulary) -> DataFrame:
    """coded (ids) with the column text. A null list gives a null text; a null id, or one that is not in
    the vocabulary, gives a replacement character."""
    spark = coded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = [c for c in coded.columns if c != "text"]
    kept = coded.select(*[F.col(f"`{c}`") for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            text = [None if x is None else codec.decode_any(x) for x in b.column(columns.index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*columns, "text"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{types}, text string")
