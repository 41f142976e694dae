"""LM scoring with a probabilistic suffix tree over words.

Tokens are the lower-cased words of a text and one end. Their symbols are the common words (about
COMMON_WORDS of them, the most frequent), CLASSES classes of the other words (by a hash of the whole
word) and the end; a word of a class is drawn from its class. The tree's states are contexts of up to
`depth` symbols, the last one first:

- a context is retained if it occurs LEAST_CONTEXT times in the training texts, at any corpus size, and
  if its next-symbol distribution diverges from that of the longest retained suffix above it: the
  log-likelihood ratio must exceed the description length of its counts (to charge the naming of each
  symbol as well was tried: it retains less, and held-out texts score worse);
- distributions are smoothed by absolute discounting towards that suffix, so each sums to one.

A text is scored from the state of the longest retained suffix at each token.

The tree is never in one place. Its head is in every task: the root, the words that hold HOT_SHARE of the
tokens, and pairs of them that do, each with all symbols that were seen behind it: at most 2 / HOT_SHARE
times the number of symbols, at any corpus size. The rest is dealt out by subtrees: every position (its context, its symbol,
its text) goes to the owner of the shortest suffix of its context that is not in the head, packed and
compressed. An owner counts the contexts of its subtrees over all training positions, retains some, and
returns what they add to each text's score. So what is gathered grows with the corpus, and no context
is dropped by its share of it. An owner gets about `owner_positions` positions; a single suffix at most
HOT_SHARE of all. Of texts that occur MANY_COPIES times one is dealt out, with their number, for all.

Words are counted over all training texts and the counts stay a table: those of the common words
go to every task, and the others are shuffled as (word, text) pairs and joined. As a word that is common
in the training texts is never shuffled by text, no word is a hot key.

Defined results: a null text is empty, its only token is the end. A null doc_id is not held out
and learned from. Repeated rows are learned from and scored once each. Without training texts all
words are unknown. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import drop, give_back, hinted, materialize, release, ship, tidy

FOLDS, HELD_FOLD = 5, 1
DEPTH = 3
#: Words that are symbols of their own and whose counts every task holds, about; classes of the others.
COMMON_WORDS = 200_000
CLASSES = 1 << 14
#: Contexts of one word in the head, at most (HOT_SHARE admits fewer), and the share of its words and pairs.
FREQUENT = 1023
HOT_SHARE = 1e-3
#: Groups in which the head tells symbols behind the frequent ones apart; 0: each by itself, as the method asks.
GROUPS = 0
LEAST_CONTEXT = 2
DISCOUNT = 0.5
#: Equal texts of which one stands for all; positions that an owner gets, about, and that a sender packs.
MANY_COPIES = 100
OWNER_POSITIONS = 600_000
SENT_AT_ONCE = 250_000
#: Positions of hot contexts that a task counts together.
COUNTED_AT_ONCE = 1_000_000
#: Positions that an owner works on together, about: whole subtrees.
PIECE = 150_000
#: Bytes of text whose words are made distinct together.
CHUNK_BYTES = 1 << 20
_SYMBOL_BITS = 20
#: Places of texts are sent as numbers below 2 to this power.
_PLACE_BITS = 24


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def slices(sizes: np.ndarray, most: int, block: np.ndarray | int = 0) -> list[tuple[int, int]]:
    """(start, stop) of runs of rows of about `most` in all, and of one block each."""
    before = np.cumsum(sizes) // most + (block << 32)
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def tokenised(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the place of each token's word among them, and the number of words by text."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(texts)
    n = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = split.flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), n


def _text_slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
    for start, stop in slices(sizes, CHUNK_BYTES):
        yield b.slice(start, stop - start)


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over the training texts of docs, summed in each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _text_slices(b):
                words, places, _ = tokenised(part.column("text"))
                n = np.bincount(places, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    texts = docs.where(~held_out(F.col("doc_id"))).select("text")
    return texts.mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """Counts of the common words and of all classes. Symbols: common words by rank, classes, the end;
    start, which is only ever in a context, is behind them."""

    index: dict[bytes, int]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int
    texts: int

    @property
    def common(self) -> int:
        return len(self.counts)

    @property
    def end(self) -> int:
        return self.common + len(self.class_tokens)

    @property
    def start(self) -> int:
        return self.end + 1

    def root(self) -> np.ndarray:
        """Log probability of each symbol."""
        n = np.concatenate([self.counts, self.class_tokens, [self.texts]]) + 0.5
        return np.log(n / n.sum())

    def base_total(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))


def vocabulary(counts: DataFrame, texts: int) -> Words:
    """From the written table of counts. What is collected is bounded by COMMON_WORDS and CLASSES."""
    # Steps of counts, the most frequent words first; of the step that doesn't fit, a part by a hash.
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()  # some hundred steps
    room, least, part = COMMON_WORDS, 0, 0.0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        least, part = r["step"], min(1.0, room / r["words"])
        room -= r["words"]
        if room < 0:
            break
    keep = (step > least) | ((step == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(part * (1 << 30))))
    common = counts.where(keep).toArrow()
    words, n = common.column("word").to_pylist(), np.array(common.column("n").to_pylist(), np.int64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in order], n[order]
    sums = np.zeros((2, CLASSES), np.int64)
    totals = np.zeros(2, np.int64)
    by_class = counts.groupBy((F.crc32("word") % CLASSES).alias("c"), keep.alias("own")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    for r in by_class:
        totals += r["n"], r["words"]
        if not r["own"]:
            sums[:, r["c"]] = r["n"], r["words"]
    return Words({w: i for i, w in enumerate(words)}, n, sums[0], sums[1], int(totals[0]) + texts, int(totals[1]) + bool(texts), texts)


# Symbols of all texts ------------------------------------------------------------------------------

CODED = "doc_id long, held_out boolean, place long, n_tokens long, known long, base double, rare array<binary>, times array<int>, symbols binary"


def _lists(values: pa.Array, of: np.ndarray, n: int) -> pa.ListArray:
    """Lists for n rows; of: the row of each value, ascending."""
    ends = np.cumsum(np.append(0, np.bincount(of, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _packed(symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The symbols of each row by byte planes; as bytes, Spark moves and compares them whole."""
    at, step = np.arange(len(symbols)) + np.repeat(2 * first, sizes), np.repeat(sizes, sizes)
    out = np.empty(3 * len(symbols), np.uint8)
    for k in range(3):
        out[at + k * step] = (symbols >> (8 * k)) & 255
    ends = np.append(3 * first, 3 * len(symbols)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def coded(docs: DataFrame, words) -> DataFrame:
    """A row for each of docs (doc_id, held_out, place, text), in symbols; rare words, whose counts no
    task holds, also as they are."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = words.value
        total, get = v.base_total(), v.index.get
        for b in batches:
            for part in _text_slices(b):
                distinct, places, n = tokenised(part.column("text"))
                rank = np.fromiter((get(w, -1) for w in distinct), np.int64, len(distinct))
                rare = np.flatnonzero(rank < 0)
                symbol = rank.copy()
                symbol[rare] = [v.common + zlib.crc32(distinct[i]) % len(v.class_tokens) for i in rare.tolist()]
                logs = np.full(len(distinct), -total)  # of a rare word, log10(n + 0.5) comes from the join
                logs[rank >= 0] += np.log10(v.counts[rank[rank >= 0]] + 0.5)
                sizes = n + 1
                first = np.cumsum(sizes) - sizes
                inner = np.ones(int(sizes.sum()), bool)
                inner[first + n] = False
                symbols, base, common = np.full(len(inner), v.end, np.int32), np.full(len(inner), math.log10(v.texts + 0.5) - total), np.full(len(inner), v.texts > 0)
                symbols[inner], base[inner], common[inner] = symbol[places], logs[places], rank[places] >= 0
                size, own = max(1, len(distinct)), rank[places] < 0
                found, times = np.unique(np.repeat(np.arange(len(n)), n)[own] * size + places[own], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "held_out", "place")), pa.array(sizes), pa.array(np.add.reduceat(common.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)),
                        _lists(pa.array(distinct, pa.binary()).take(pa.array(found % size)), found // size, len(n)), _lists(pa.array(times, pa.int32()), found // size, len(n)),
                        _packed(symbols, first, sizes),
                    ],
                    [x.split()[0] for x in CODED.split(", ")],
                )

    return docs.mapInArrow(tidy(code), CODED)


def contexts(symbols: np.ndarray, first: np.ndarray, depth: int, start: int) -> list[np.ndarray]:
    """The symbol before each one, the one before that, and so on."""
    place = np.arange(len(symbols)) - np.repeat(first, np.diff(np.append(first, len(symbols))))
    out = []
    for d in range(1, depth + 1):
        c = np.full(len(symbols), start, np.int32)
        c[d:] = symbols[: max(0, len(symbols) - d)]
        c[place < d] = start
        out.append(c)
    return out


def _sizes(b: pa.RecordBatch) -> np.ndarray:
    return pc.binary_length(b.column("symbols")).to_numpy(zero_copy_only=False).astype(np.int64) // 3


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where each row's begin, and how many each has (one at least)."""
    column, sizes = b.column("symbols"), _sizes(b)
    _, ends, data = column.buffers()
    first = np.cumsum(sizes) - sizes
    begin = int(np.frombuffer(ends, np.int32)[column.offset]) if len(sizes) else 0
    raw = np.frombuffer(data, np.uint8)[begin:] if len(sizes) else np.zeros(0, np.uint8)
    at, step = np.arange(int(sizes.sum())) + np.repeat(2 * first, sizes), np.repeat(sizes, sizes)
    symbols = raw[at].astype(np.int32)
    for k in (1, 2):
        symbols |= raw[at + k * step].astype(np.int32) << (8 * k)
    return symbols, first, sizes


# The tree's head -----------------------------------------------------------------------------------


@dataclass
class Head:
    """place: of each symbol (and start), its number among the head's words, or one behind the last.
    states[two, one] by place: the longest retained suffix in the head, 0 for the root; pairs[two, one]: the
    number of a pair that the head holds, retained or not, or -1. Of a state, keys (state * size + symbol,
    ascending) and ratios have the symbols seen behind it: log of the probability over the root's. Another
    symbol has the ratio of the parent state, and the state's back. Symbols are `reduced` (see GROUPS)."""

    root: np.ndarray
    reduced: np.ndarray
    size: int
    place: np.ndarray
    states: np.ndarray
    pairs: np.ndarray
    keys: np.ndarray
    ratios: np.ndarray
    back: np.ndarray
    parent: np.ndarray

    @property
    def start(self) -> int:
        return len(self.root)

    def ratio(self, state: np.ndarray, reduced: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state))
        at = np.flatnonzero(state)
        at = at[np.argsort(state[at].astype(np.int64) * self.size + reduced[at])]  # near keys are looked up together
        state, reduced = state[at].astype(np.int64), reduced[at]
        while len(at):
            key = (state * self.size + reduced).astype(self.keys.dtype)
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            seen = self.keys[i] == key
            out[at] += np.where(seen, self.ratios[i], self.back[state])
            state = np.where(seen, 0, self.parent[state])
            more = np.flatnonzero(state)
            at, state, reduced = at[more], state[more], reduced[more]
        return out

    def logs(self, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.root[symbols] + self.ratio(self.states[self.place[two], self.place[one]], self.reduced[symbols])

    def first_depth(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Symbols of the shortest suffix that is not in the head. That of a text's first token, whose
        context is the start alone, is never reached."""
        p1, p2 = self.place[one], self.place[two]
        return np.where(one == self.start, 1 << 20, np.where(p1 == len(self.pairs) - 1, 1, np.where(self.pairs[p2, p1] >= 0, 3, 2)))


def _smooth(counts: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, bool]:
    """A context's distribution, and whether it diverges enough from its parent's."""
    total, kinds = counts.sum(), np.count_nonzero(counts)
    p = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds * parent) / total
    seen = counts > 0
    gain = float((counts[seen] * np.log(p[seen] / parent[seen])).sum())
    return p, total >= LEAST_CONTEXT and gain > 0.5 * kinds * math.log(total)


def _count_codes(rows: DataFrame, head: Head, code) -> tuple[np.ndarray, np.ndarray]:
    """(code, n) over the training texts, by code; code(head, one, two) is a context's number, or -1, and
    codes are these and the next symbols."""
    at_once, most, shared = SENT_AT_ONCE, COUNTED_AT_ONCE, rows.sparkSession.sparkContext.broadcast(head)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        some, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, held, size = shared.value, [], 0
        for b in batches:
            for start, stop in slices(_sizes(b), at_once):
                symbols, first, _ = _flat(b.slice(start, stop - start))
                number = code(h, *contexts(symbols, first, 2, h.start))
                at = np.flatnonzero(number >= 0)
                held.append(number[at] * h.size + h.reduced[symbols[at]])
                size += len(at)
                if size >= most:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    found = rows.where("not held_out").select("symbols").mapInArrow(tidy(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, n = found.column("code").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def head_of(rows: DataFrame, v: Words, depth: int = DEPTH) -> Head:
    """Two passes over the symbols. What comes back is what was seen behind the head's contexts, of which
    there are at most 1 / HOT_SHARE of each length."""
    least = max(LEAST_CONTEXT, HOT_SHARE * max(1, v.tokens))
    frequent = min(FREQUENT, v.common)
    reduced = np.arange(v.end + 1)
    if GROUPS:
        behind = np.arange(frequent, v.end)
        reduced[frequent : v.end], reduced[v.end] = frequent + (behind * 2654435761 >> 15) % GROUPS, frequent + GROUPS
    size, root = int(reduced[-1]) + 1, v.root()
    whole = np.maximum(np.bincount(reduced, np.exp(root), size), 1e-300)
    held = [*np.flatnonzero(v.counts[:frequent] >= least).tolist(), v.start]
    place = np.full(v.start + 1, len(held), np.int32)
    place[held] = np.arange(len(held))
    states, pairs = np.zeros((len(held) + 1, len(held) + 1), np.int64), np.full((len(held) + 1, len(held) + 1), -1, np.int32)
    head = Head(root, reduced, size, place, states, pairs, np.zeros(1, np.int64), np.zeros(1, np.float32), np.zeros(1), np.zeros(1, np.int64))

    def retain(codes: np.ndarray, n: np.ndarray, above: np.ndarray) -> np.ndarray:
        """The state of each context, or that above it; those that diverge enough become states."""
        out = above.copy()
        keys, ratios, back, parent = [head.keys], [head.ratios], head.back.tolist(), head.parent.tolist()
        edges = np.searchsorted(codes, np.arange(len(above) + 1) * size)
        for c, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            if i < j:
                seen = codes[i:j] % size
                p, diverges = _smooth(n[i:j], whole[seen] * np.exp(head.ratio(np.full(j - i, above[c]), seen)))
                if diverges:
                    out[c] = len(back)
                    keys.append(len(back) * size + seen)
                    ratios.append(np.log(p / whole[seen]).astype(np.float32))
                    back.append(math.log(DISCOUNT * (j - i) / n[i:j].sum()))
                    parent.append(int(above[c]))
        head.back, head.parent = np.array(back), np.array(parent)
        head.ratios = np.concatenate(ratios)
        head.keys = np.concatenate(keys).astype(np.uint32 if len(back) * size < 1 << 32 else np.int64)
        return out

    codes, n = _count_codes(rows, head, lambda h, one, two: np.where(h.place[one] < len(h.pairs) - 1, h.place[one], -1).astype(np.int64))
    states[:, :-1] = retain(codes, n, np.zeros(len(held), np.int64))
    # Pairs (two, one) of its words; a text begins with start.
    hot = np.flatnonzero((n >= least) & (codes % size < frequent))
    two, one = codes[hot] // size, place[codes[hot] % size].astype(np.int64)
    if len(hot) and depth > 1:
        pairs[two, one] = np.arange(len(hot))
        codes, n = _count_codes(rows, head, lambda h, one, two: h.pairs[h.place[two], h.place[one]].astype(np.int64))
        states[two, one] = retain(codes, n, states[two, one])
    head.states = states.astype(np.int32)
    return head


# Its subtrees --------------------------------------------------------------------------------------

SENT = "owner long, slice long, n long, base long, positions binary"
ANSWER = "slice long, n long, base long, more binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Hashes of contexts that are longer by one symbol."""
    h = (h ^ (symbols.astype(np.uint64) + np.uint64(1))) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _planes(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [((c >> shift) & 255).astype(np.uint8) for c in columns for shift in (0, 8, 16)]


def _pack(columns: list[np.ndarray], weight: np.ndarray) -> bytes:
    """Whole numbers below 2**24 by byte planes, and a weight each; weights from 2**24 on take more planes."""
    wide = int(weight.max(initial=0)) >> 24 > 0
    planes = _planes([*columns, weight, *([weight >> 24] if wide else [])])
    return bytes([wide]) + pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, columns: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The columns with the weights below 2**24 as the last of them, and what the weights have above that."""
    wide = data[0]
    raw = np.frombuffer(pa.decompress(memoryview(data)[1:], 3 * n * (columns + wide), codec="zstd", asbytes=True), np.uint8)
    planes = raw.reshape(columns + wide, 3, n).astype(np.int32)
    found = planes[:, 0] | (planes[:, 1] << 8) | (planes[:, 2] << 16)
    return found[:columns], found[columns].astype(np.int64) << 24 if wide else None


def _rows(made: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*made, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _routes(head: Head, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each position the length and a hash of the shortest suffix that is not in the head."""
    two = before[1] if len(before) > 1 else np.full(len(before[0]), head.start, np.int32)
    length, route = head.first_depth(before[0], two), np.zeros(len(two), np.uint64)
    for d, c in enumerate(before[:3], 1):
        more = length >= d
        route[more] = _mixed(route[more], c[more])
    return length, route


def sent(rows: DataFrame, head, owners: int, depth: int) -> DataFrame:
    """The positions of rows (place, weight: how many training texts each stands for, symbols), packed by
    owner and by the slice of rows that they are from."""
    at_once = SENT_AT_ONCE

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        for b in batches:
            blocks = b.column("place").to_numpy() >> _PLACE_BITS
            for start, stop in slices(_sizes(b), at_once, blocks):
                part = b.slice(start, stop - start)
                symbols, first, sizes = _flat(part)
                before = contexts(symbols, first, depth, h.start)
                two = before[1] if depth > 1 else np.full(len(symbols), h.start, np.int32)
                length, route = _routes(h, before)
                owner = (route % np.uint64(owners)).astype(np.int64)
                goes = np.flatnonzero(length <= depth)
                order = goes[np.argsort((owner[goes] << (2 * _SYMBOL_BITS)) | (before[0][goes].astype(np.int64) << _SYMBOL_BITS) | two[goes], kind="stable")]
                owner = owner[order]
                place = part.column("place").to_numpy()
                base = int(blocks[start]) << _PLACE_BITS
                texts = np.repeat((place - base).astype(np.int64), sizes)[order]
                weight = np.repeat(part.column("weight").to_numpy(), sizes)[order]
                columns = [*(c[order] for c in before), symbols[order], texts]
                edges = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
                made = [(int(owner[i]), int(place[0]), int(j - i), base, _pack([c[i:j] for c in columns], weight[i:j])) for i, j in zip(edges, edges[1:], strict=False)]
                yield _rows(made, SENT)

    return rows.select("place", "weight", "symbols").mapInArrow(tidy(send), SENT)


def subtree_logs(head: Head, before: list[np.ndarray], symbols: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each position by the head, and by the longest retained suffix; weight:
    how often each position counts."""
    two = before[1] if len(before) > 1 else np.full(len(symbols), head.start, np.int32)
    base = head.logs(symbols, before[0], two)
    logs, length = base.copy(), head.first_depth(before[0], two)
    hashes, active = np.zeros(len(symbols), np.uint64), np.arange(len(symbols))
    low = np.uint64((1 << _SYMBOL_BITS) - 1)
    for d, c in enumerate(before, 1):
        hashes[active] = _mixed(hashes[active], c[active])
        later = active[length[active] > d]
        now = active[length[active] <= d]
        if not len(now):
            continue
        key = (hashes[now] & ~low) | symbols[now].astype(np.uint64)
        order = np.argsort(key)
        now, key = now[order], key[order]
        pairs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # a context and its next symbol
        context = key[pairs] & ~low
        of = np.cumsum(np.append(True, context[1:] != context[:-1])) - 1
        n = np.add.reduceat(weight[now].astype(np.int64), pairs)
        total, kinds = np.bincount(of, n), np.bincount(of, n > 0)
        often = total >= LEAST_CONTEXT
        parent = logs[now[pairs]]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.log((np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds[of] * np.exp(parent)) / total[of])
            gain = np.bincount(of, np.where(n > 0, n * (p - parent), 0.0))
            retained = often & (gain > 0.5 * kinds * np.log(np.maximum(total, 1)))
        sizes = np.diff(np.append(pairs, len(key)))
        chosen = np.repeat(retained[of], sizes)
        logs[now[chosen]] = np.repeat(p, sizes)[chosen]
        active = np.concatenate([later, now[np.repeat(often[of], sizes)]])
        if not len(active):
            break
    return base, logs


def _own(head, depth: int):
    """What the contexts of an owner add to the log probability of each text: an answer to each slice."""
    at_once = PIECE

    def score_of(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_numpy()
        give_back()
        found, at, above = np.empty((depth + 3, int(sizes.sum())), np.int32), 0, []
        for data, n in zip(rows.column("positions"), sizes.tolist(), strict=True):
            found[:, at : at + n], more = _unpack(data.as_py(), n, depth + 3)
            if more is not None:
                above.append((at, more))
            at += n
        *before, symbols, texts, weight = found
        if above:
            weight = weight.astype(np.int64)
            for at, more in above:
                weight[at : at + len(more)] += more
        # Whole subtrees at once, as an owner's temporary arrays are many times its positions.
        pieces = -(-len(symbols) // at_once)
        piece = (_routes(head.value, before)[1] >> np.uint64(40)) % np.uint64(max(1, pieces))
        more = np.empty(len(symbols), np.float32)
        for i in range(pieces):
            at = np.flatnonzero(piece == i)
            if len(at):
                base, logs = subtree_logs(head.value, [c[at] for c in before], symbols[at], weight[at])
                more[at] = logs - base
        answers, stop = [], np.cumsum(sizes)
        for i, (a, b) in enumerate(zip((stop - sizes).tolist(), stop.tolist(), strict=True)):
            moved = a + np.flatnonzero(more[a:b])
            place, of = np.unique(texts[moved], return_inverse=True)
            if len(place):
                sums = np.bincount(of, more[moved], len(place)).astype("<f4")
                data = pa.compress(place.astype("<u4").tobytes() + sums.tobytes(), codec="zstd", asbytes=True)
                answers.append((rows.column("slice")[i].as_py(), len(place), rows.column("base")[i].as_py(), data))
        return pa.Table.from_batches([_rows(answers, ANSWER)])

    return score_of


def _summed(rows: pa.Table) -> pa.Table:
    """place, more (log10) of the texts of a slice, from all owners' answers."""
    places, sums = [], []
    for n, base, data in zip(*(rows.column(c).to_pylist() for c in ("n", "base", "more")), strict=True):
        raw = pa.decompress(data, 8 * n, codec="zstd", asbytes=True)
        places.append(np.frombuffer(raw, "<u4", n).astype(np.int64) + base)
        sums.append(np.frombuffer(raw, "<f4", n, 4 * n).astype(np.float64))
    place, of = np.unique(np.concatenate(places), return_inverse=True)
    return pa.table({"place": place, "more": np.bincount(of, np.concatenate(sums), len(place)) / math.log(10)})


def _in_head(head):
    at_once = SENT_AT_ONCE

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = head.value
        for b in batches:
            for start, stop in slices(_sizes(b), at_once):
                part = b.slice(start, stop - start)
                symbols, first, _ = _flat(part)
                logs = np.add.reduceat(h.logs(symbols, *contexts(symbols, first, 2, h.start)), first) / math.log(10)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(logs)], [*part.schema.names[:-1], "score"])

    return tidy(add)


def score(docs: DataFrame, depth: int = DEPTH, owner_positions: int = OWNER_POSITIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = materialize(count_words(docs), "words")
    v = vocabulary(counts, docs.where(~held_out(F.col("doc_id"))).count())
    words = spark.sparkContext.broadcast(v)  # about COMMON_WORDS words
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.monotonically_increasing_id().alias("place"), "text")
    rich = materialize(coded(rows, words), "coded", "zstd")

    # The counts of rare words.
    pairs = rich.select("place", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("place", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # From Arrow, as a list of rows would start Python workers of its own, beside those of the operator.
    sizes = spark.createDataFrame(pa.table({"class": np.arange(len(v.class_tokens)), "size": v.class_tokens + 0.5 * (v.class_words + 1)}))
    seen = F.coalesce("n", F.lit(0))
    late = (
        pairs.join(counts, "word", "left")
        .withColumn("class", F.crc32("word") % CLASSES)
        .join(F.broadcast(sizes), "class")  # a row for each class
        .groupBy("place")
        .agg(
            F.sum(F.col("times") * F.log10(seen + 0.5)).alias("late_base"),
            F.sum(F.col("times") * F.log10((seen + 0.5) / F.col("size"))).alias("late_score"),
            F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("late_known"),
        )
    )
    late, rows = materialize(late, "late"), materialize(rich.drop("rare", "times"), "symbols", "zstd")
    for table in (counts, rich):
        drop(table)
    release(spark)

    head = spark.sparkContext.broadcast(head_of(rows, v, depth))  # bounded, see head_of()

    # Of many equal texts the one of the least place stands for all.
    text = F.struct(F.xxhash64("symbols"), F.hash("symbols"), "n_tokens").alias("text")
    trains = F.when(F.col("held_out"), 0).otherwise(1).cast("long")
    copies = rows.select(text, "place", trains.alias("weight")).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.sum("weight").alias("copies"))
    copies = hinted(materialize(copies.where(F.col("n") >= MANY_COPIES).drop("n"), "copies"), 64)
    marked = rows.withColumn("text", text).join(copies, "text", "left")
    dealt = marked.where("first is null or first = place").select("place", F.coalesce("copies", trains).alias("weight"), "symbols")

    positions = rows.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    owned = sent(dealt, head, max(1, -(-positions // owner_positions)), depth).groupBy("owner").applyInArrow(_own(head, depth), ANSWER)
    deeper = materialize(owned.groupBy("slice").applyInArrow(_summed, "place long, more double"), "deeper")
    kept = "doc_id long, held_out boolean, place long, n_tokens long, known long, base double, first long, score double"
    scored = marked.select(*(c.split()[0] for c in kept.split(", ")[:-1]), "symbols").mapInArrow(_in_head(head), kept)
    scored = scored.withColumn("first", F.coalesce("first", "place"))
    deeper, zero = deeper.withColumnRenamed("place", "first"), F.lit(0)
    return scored.join(late, "place", "left").join(deeper, "first", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("late_known", zero)).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("late_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("late_score", zero) + F.coalesce("more", zero)).alias("score"),
    )
