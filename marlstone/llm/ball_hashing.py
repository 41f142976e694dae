"""Meet-in-the-middle ball hashing over bits: points within an even radius of each other share a
variant within half of it, so every point emits its ball of variants and those that share one meet.

A ball is emitted in two steps, so that the shuffle stays small. A point is sent to every prefix that
some variant of it has; the task of a prefix completes the variants. Points travel packed, as one
binary for each batch and prefix. A prefix to which more than `most` points are sent is divided into
longer ones, until it is a whole variant. Points that share a whole variant are dealt into chunks of
about half of `most`, and each two chunks make a group: so no task gets an unbounded group, and each two
points still meet. A caller that takes all points of such a variant alike asks for the chunks alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import hinted, materialize

BALLS = "depth int, prefix long, n long, points binary"
#: Bits by which a crowded prefix grows at once.
DEEPER = 4
#: Bytes of points that are dealt together.
DEAL_BYTES = 32 << 20
#: The chunk of groups that are no part of a crowded variant.
WHOLE = -1


@cache
def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of at most `radius` of the lowest `bits` bits, and how many each has."""
    masks = [(sum(1 << i for i in c), r) for r in range(min(radius, bits) + 1) for c in combinations(range(bits), r)]
    return np.array(masks, np.uint64).reshape(-1, 2)


def _packed(prefix: np.ndarray, of: np.ndarray, records: np.ndarray, depth: int) -> pa.RecordBatch:
    """A row for each prefix, with the records that are sent to it."""
    order = np.argsort(prefix, kind="stable")
    prefix = prefix[order]
    starts = np.flatnonzero(np.diff(prefix, prepend=prefix[:1] - 1))
    n = np.diff(np.append(starts, len(prefix)))
    ends = np.cumsum(np.append(0, n)) * records.itemsize
    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(records[of[order]].tobytes())])
    columns = [pa.array(np.full(len(n), depth, np.int32)), pa.array(prefix[starts].astype(np.int64)), pa.array(n), blobs.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BALLS.split(", ")])


def emitted(points: np.ndarray, band: np.ndarray, records: np.ndarray, width: int, prefix_bits: int, half: int) -> pa.RecordBatch:
    """records: what is sent of each point. A prefix has its band above it."""
    masks = ball(prefix_bits, half)[:, 0]
    tops = (points >> np.uint64(width - prefix_bits)) | (band.astype(np.uint64) << np.uint64(prefix_bits))
    prefix = (tops[:, None] ^ masks).ravel()
    return _packed(prefix, np.repeat(np.arange(len(points)), len(masks)), records, prefix_bits)


def _deeper(depth: int, step: int, width: int, half: int, kind: np.dtype, point: Callable):
    """Divide each prefix by the next `step` bits."""
    rest = width - depth - step
    steps = np.arange(1 << step, dtype=np.uint64)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for prefix, blob in zip(b.column("prefix").to_pylist(), b.column("points"), strict=True):
                records = np.frombuffer(blob.as_py(), kind)
                points = point(records, prefix >> depth)
                own = np.uint64(prefix & ((1 << depth) - 1))
                used = np.bitwise_count((points >> np.uint64(width - depth)) ^ own).astype(np.int64)
                apart = np.bitwise_count(((points >> np.uint64(rest)) & np.uint64((1 << step) - 1))[:, None] ^ steps)
                at, s = np.nonzero(used[:, None] + apart <= half)
                yield _packed((np.uint64(prefix) << np.uint64(step)) | steps[s], at, records, depth + step)

    return divide


def _sliced(most: int, kind: np.dtype):
    """Cut packed points into pieces of at most `most` points."""
    size = most * kind.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for depth, prefix, blob in zip(*(b.column(c).to_pylist() for c in ("depth", "prefix", "points")), strict=True):
                pieces = [blob[i : i + size] for i in range(0, len(blob), size)]
                n = len(pieces)
                columns = [pa.array([depth] * n, pa.int32()), pa.array([prefix] * n, pa.int64()), pa.array([len(x) // kind.itemsize for x in pieces], pa.int64()), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BALLS.split(", ")])

    return cut


def dealt(balls: DataFrame, width: int, prefix_bits: int, half: int, most: int, kind: np.dtype, point: Callable, paired: bool = True) -> DataFrame:
    """balls with the columns chunk and other: rows of one (depth, prefix, chunk, other) make a group of
    bounded size. Where a whole variant is crowded, a group is two of its chunks if paired, else one;
    elsewhere chunk is WHOLE. point(records, band) are the points of records of type kind."""
    table, ready, depth = materialize(balls, "balls"), [], prefix_bits
    whole = [F.lit(WHOLE).cast("long").alias(c) for c in ("chunk", "other")]
    while True:
        sizes = table.groupBy("prefix").agg(F.sum("n").alias("crowd")).where(F.col("crowd") > most)
        crowded = materialize(sizes, "crowded")
        if not crowded.limit(1).count():
            return _union([*ready, table.select("*", *whole)])
        crowded = hinted(crowded, 32)
        ready.append(table.join(crowded.select("prefix"), "prefix", "left_anti").select("depth", "prefix", "n", "points", *whole))
        table = table.join(crowded.select("prefix"), "prefix", "left_semi").select("depth", "prefix", "n", "points")
        if depth == width:
            pieces = table.mapInArrow(_sliced(max(1, most // 8), kind), BALLS).join(crowded, "prefix")
            pieces = pieces.withColumn("chunks", F.ceil(2 * F.col("crowd") / most).cast("long"))
            pieces = pieces.withColumn("own", F.pmod(F.xxhash64("points"), F.col("chunks")))
            if not paired:
                return _union([*ready, pieces.select("depth", "prefix", "n", "points", F.col("own").alias("chunk"), F.col("own").alias("other"))])
            partner = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: c != F.col("own"))).alias("partner")
            pairs = pieces.select("depth", "prefix", "n", "points", "own", partner)
            return _union([*ready, pairs.select("depth", "prefix", "n", "points", F.least("own", "partner").alias("chunk"), F.greatest("own", "partner").alias("other"))])
        step = min(DEEPER, width - depth)
        table = materialize(table.mapInArrow(_deeper(depth, step, width, half, kind, point), BALLS), "balls")
        depth += step


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_of(rows: pa.Table, kind: np.dtype) -> tuple[int, int, np.ndarray]:
    """(depth, prefix with its band, records) of a group."""
    blobs = rows.column("points").to_pylist()
    return rows.column("depth")[0].as_py(), rows.column("prefix")[0].as_py(), np.frombuffer(b"".join(blobs), kind)


def meetings(points: np.ndarray, prefix: int, prefix_bits: int, width: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(variant, place of the point) of all variants with this prefix that several points share, in order."""
    rest = width - prefix_bits
    used = np.bitwise_count((points >> np.uint64(rest)) ^ np.uint64(prefix))
    low = np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for u in range(half + 1):
        own = np.flatnonzero(used == u)
        masks = ball(rest, half - u)[:, 0]
        variants.append(((points[own] & low)[:, None] ^ masks).ravel())
        owners.append(np.repeat(own, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], owner[order]
    same = variant[1:] == variant[:-1]
    shared = np.append(same, False) | np.append(False, same)
    return variant[shared], owner[shared]


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place in the component of each of n places linked by (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, n: int) -> np.ndarray:
    """Places of the links that make a forest of the least total distance, by Boruvka's rounds. Its
    links of at most some distance connect what all links of at most that distance connect."""
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, apart))] = np.arange(len(a))
    place_of = np.argsort(rank)
    label, taken = np.arange(n), [np.zeros(0, np.int64)]
    live = np.arange(len(a))
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return np.concatenate(taken)
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[live]], rank[live])
        np.minimum.at(best, label[b[live]], rank[live])
        chosen = place_of[np.unique(best[best < len(a)])]
        taken.append(chosen)
        label = roots(label[a[chosen]], label[b[chosen]], n)[label]
