"""Exact top-k inner products by a three-phase uniform threshold.

Components are floor(1024 x). The dimensions are dealt into `lists` blocks; a block's partial inner
products with a query are one score list, and a score is the sum over the lists. Vectors stay where they
are: a scan puts those of a batch into tiles of similar ones, each with its centre and, for every list,
the largest distance from it, and writes the tiles. Queries go to the tiles in blocks of bounded bytes.

1. Every task gathers local score lists: it resolves the few tiles whose centres score best with a query,
   and sends each query's best k scores. The k-th best over all tasks is a score that k rows reach: a
   safe cutoff.
2. The cutoffs go to all tasks. In a list j no vector of a tile can score above
   query_j . centre_j + |query_j| radius_j; tiles whose lists' bounds don't reach the cutoff together are
   left out whole. In the others the local score lists are made, in single precision, each score widened
   by more than its rounding. A row that reaches the cutoff must reach the uniform threshold, cutoff / lists,
   in one list at least: entries that do are collected, and of these stay the rows whose local scores
   reach the cutoff together.
3. What has been collected is resolved exactly. Each task returns at most k rows of a query that
   reach its cutoff; ties go to the smaller vec_id.

Scores are whole numbers and never rounded: products that a double cannot hold are made with Python's
integers. Bounds are widened by more than their rounding.

Defined results: vectors that are null, or hold null or non-finite components, take no part; nor do those
with a component that floor(1024 x) takes beyond 64 bits. A score beyond 64 bits is held at their end,
where scores tie. Only vectors of one length are compared. Repeated rows are rows of their own: each is
a candidate for the other, and each is a query if its vec_id is. A row without vec_id takes no part.
Fewer than k candidates: all are returned. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.runtime import materialize, ship
from marlstone.scratch import new_path

K = 10
LISTS = 4
SCALE = 1024

#: Vectors of a tile at most, and tiles that are resolved for a first cutoff by each batch.
TILE_ROWS = 128
LEADING_TILES = 2
#: Bytes of a block of queries, as doubles, and scores that a task holds at once.
BLOCK_BYTES = 16 << 20
#: Bytes of vectors, as doubles, that are put into tiles together.
TILED_BYTES = 64 << 20
SCORES_AT_ONCE = 1 << 21
_LARGEST = (1 << 63) - 1


def quantised(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of whole numbers as doubles) of the vectors of each length that take part."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    begins = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    for dims in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero((lengths == dims) & (ids >= 0))
        values = flat[begins[rows][:, None] + np.arange(dims)]
        whole = np.floor(SCALE * values)
        use = (np.isfinite(whole) & (np.abs(whole) < 2.0**63)).all(axis=1)
        yield rows[use], whole[use]


def tiles_of(matrix: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in tiles of at most `most`, cut along the line between two that lie far apart."""
    todo, out = [np.arange(len(matrix))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = matrix[rows]
        a = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        b = own[((own - a) ** 2).sum(axis=1).argmax()]
        along = own @ (b - a)
        order = np.argsort(along, kind="stable")
        low, high = max(1, len(rows) // 4), len(rows) - len(rows) // 4  # the widest gap between the quarters
        cut = low + int(np.diff(along[order][low - 1 : high]).argmax())
        todo += [rows[order[:cut]], rows[order[cut:]]]
    return out


def list_cuts(dims: int, lists: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dims), max(1, min(lists, dims)))


TILE = "dims int, ids binary, places binary, queries binary, vectors binary, kind string, centre binary, radii binary"


def _slices(b: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """Rows of about TILED_BYTES each, but for the rows of a tile at least."""
    size = 8 * len(b.column("embedding").flatten())
    step = max(least, b.num_rows * TILED_BYTES // max(1, size), 1)
    for start in range(0, b.num_rows, step):
        yield b.slice(start, step)


def tiles(vectors: DataFrame, is_query: Column, lists: int = LISTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """A row for each tile of vectors (vec_id, embedding): ids, places and whether each is a query;
    vectors in the smallest kind of whole numbers that holds them; the centre, and a radius by list."""
    ship(vectors.sparkSession)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole, tile_rows)):
            named = b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            ids, places = pc.fill_null(b.column("vec_id"), 0).to_numpy(), b.column("place").to_numpy()
            asks = pc.fill_null(b.column("asks"), False).to_numpy(zero_copy_only=False)
            made: list[tuple] = []
            for rows, matrix in quantised(np.where(named, 0, -1), b.column("embedding")):
                cuts = list_cuts(matrix.shape[1], lists)
                for own in tiles_of(matrix, tile_rows) if len(rows) else []:
                    v, at = matrix[own], rows[own]
                    largest = np.abs(v).max(initial=0)
                    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"
                    centre = v.mean(axis=0)
                    radii = np.array([np.sqrt(((v[:, c] - centre[c]) ** 2).sum(axis=1)).max() for c in cuts])
                    parts = (ids[at].astype("<i8"), places[at].astype("<i8"), asks[at], v.astype(kind))
                    made.append((v.shape[1], *(x.tobytes() for x in parts), kind, centre.tobytes(), radii.tobytes()))
            kinds = [pa.int32(), *[pa.binary()] * 4, pa.string(), pa.binary(), pa.binary()]
            columns = list(zip(*made, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in TILE.split(", ")])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    return rows.withColumn("place", F.monotonically_increasing_id()).mapInArrow(put, TILE)


@dataclass
class Tile:
    dims: int
    ids: np.ndarray
    places: np.ndarray
    queries: np.ndarray
    vectors: np.ndarray
    centre: np.ndarray
    radii: np.ndarray


def read_tiles(b: pa.RecordBatch) -> list[Tile]:
    out = []
    for dims, ids, places, queries, data, kind, centre, radii in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
        ids = np.frombuffer(ids, "<i8")
        out.append(Tile(dims, ids, np.frombuffer(places, "<i8"), np.frombuffer(queries, bool), np.frombuffer(data, kind).reshape(len(ids), dims), np.frombuffer(centre), np.frombuffer(radii)))
    return out


@dataclass
class Block:
    """Queries of one length; cutoffs: the score that a row must reach."""

    ids: np.ndarray
    places: np.ndarray
    vectors: np.ndarray
    cutoffs: np.ndarray | None = None

    def norms(self, cuts: list[np.ndarray]) -> np.ndarray:
        v = self.vectors.astype(np.float64)
        return np.stack([np.sqrt((v[:, c] ** 2).sum(axis=1)) for c in cuts], axis=1)


def _exact_kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """Doubles if these hold the products, else Python's integers."""
    largest = int(np.abs(queries.astype(np.float64)).max(initial=0)) * int(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1, queries.shape[1])
    return np.float64 if largest < 2**53 else object


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of all queries with all vectors."""
    kind = _exact_kind(queries, vectors)
    return queries.astype(kind) @ vectors.astype(kind).T


def pair_scores(queries: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of queries a with vectors b, pair by pair."""
    kind = _exact_kind(queries, vectors)
    step = max(1, SCORES_AT_ONCE // max(1, queries.shape[1]))
    parts = [(queries[a[i : i + step]].astype(kind) * vectors[b[i : i + step]].astype(kind)).sum(axis=1) for i in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def bounds(block: Block, own: list[Tile], lists: int) -> np.ndarray:
    """(list, query, tile): what a vector of the tile can score in the list at most."""
    cuts = list_cuts(own[0].dims, lists)
    q, centres, radii = block.vectors.astype(np.float64), np.stack([t.centre for t in own]), np.stack([t.radii for t in own])
    norms = block.norms(cuts)
    out = np.stack([q[:, c] @ centres[:, c].T + norms[:, [j]] * radii[:, j] for j, c in enumerate(cuts)])
    length = np.sqrt((centres**2).sum(axis=1)) + radii.sum(axis=1)
    return out + 1e-9 * norms.sum(axis=1)[None, :, None] * length + 1e-9


def collected(block: Block, own: list[Tile], lists: int) -> np.ndarray:
    """(query, tile): whether a vector of the tile may reach the query's cutoff."""
    return bounds(block, own, lists).sum(axis=0) >= block.cutoffs[:, None]


def admitted(queries: np.ndarray, cutoffs: np.ndarray, tile: Tile, lists: int) -> np.ndarray:
    """(query, vector): whether one local score reaches the uniform threshold, and all together the cutoff."""
    small = tile.vectors.dtype.itemsize <= 4 and np.abs(queries.astype(np.float64)).max(initial=0) < 2.0**31
    kind, unit = (np.float32, 2.0**-23) if small else (np.float64, 2.0**-52)
    cuts, cutoff = list_cuts(tile.dims, lists), cutoffs[:, None]
    reaches = np.zeros((len(queries), len(tile.vectors)), bool)
    total = np.zeros(reaches.shape)
    for c in cuts:
        q, v = queries[:, c].astype(np.float64), tile.vectors[:, c].astype(np.float64)
        rounding = (len(c) + len(cuts) + 4) * unit * np.outer(np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1)))
        local = q.astype(kind) @ v.astype(kind).T + rounding
        reaches |= local >= cutoff / len(cuts)
        total += local
    return reaches & (total >= cutoff)


class Best:
    """The best k rows of each query so far, by score and then vec_id."""

    def __init__(self, k: int):
        self.k = k
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append(np.array([query, ids, score]))
        self.count += len(query)
        if self.count > SCORES_AT_ONCE:
            self.held = [self.rows()]
            self.count = self.held[0].shape[1]

    def rows(self) -> np.ndarray:
        """(query, vec_id, score) in order of query and rank."""
        if not self.held:
            return np.zeros((3, 0), np.int64)
        all_rows = np.concatenate(self.held, axis=1)
        query, ids, score = all_rows
        order = np.lexsort((ids, np.bitwise_not(score), query))  # ~x falls as x rises, and never overflows
        all_rows, query = all_rows[:, order], query[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        return all_rows[:, nth < self.k]


def _resolve(best: Best, block: Block, queries: np.ndarray, tile: Tile, lists: int) -> None:
    """Score with some of the block's queries the tile's vectors, or with cutoffs only those that their local
    scores admit, and keep what reaches the cutoff."""
    step = max(1, SCORES_AT_ONCE // max(1, len(tile.ids)))
    for i in range(0, len(queries), step):
        some = queries[i : i + step]
        wanted = tile.places[None, :] != block.places[some][:, None]
        if block.cutoffs is not None:
            wanted &= admitted(block.vectors[some], block.cutoffs[some], tile, lists)
        a, b = np.nonzero(wanted)
        if 4 * len(a) > wanted.size:  # so many that a product of matrices is less work
            found = scores(block.vectors[some], tile.vectors)[a, b]
        else:
            found = pair_scores(block.vectors[some], tile.vectors, a, b)
        if block.cutoffs is not None:
            keep = (found >= block.cutoffs[some][a]).astype(bool)
            a, b, found = a[keep], b[keep], found[keep]
        if found.dtype == object:
            found = np.array([max(-_LARGEST - 1, min(_LARGEST, int(x))) for x in found], np.int64)
        best.add(some[a], tile.ids[b], found.astype(np.int64))


def _by_length(own: list[Tile], blocks: dict[int, Block]) -> Iterator[tuple[Block, list[Tile]]]:
    for dims, block in blocks.items():
        mine = [t for t in own if t.dims == dims]
        if mine:
            yield block, mine


def _phase(shared, k: int, lists: int, leading: int):
    """Phase 1 without cutoffs, phases 2 and 3 with them: the best rows of each query in a task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        best = {dims: Best(k) for dims in blocks}
        for b in batches:
            for block, own in _by_length(read_tiles(b), blocks):
                step = max(1, SCORES_AT_ONCE // (len(own) * lists))
                for i in range(0, len(block.ids), step):
                    part = Block(*(None if x is None else x[i : i + step] for x in (block.ids, block.places, block.vectors, block.cutoffs)))
                    if part.cutoffs is None:
                        guess = part.vectors.astype(np.float64) @ np.stack([t.centre for t in own]).T
                        wanted = np.zeros(guess.shape, bool)
                        most = min(leading, len(own))
                        np.put_along_axis(wanted, np.argpartition(-guess, most - 1, axis=1)[:, :most], True, axis=1)
                    else:
                        wanted = collected(part, own, lists)
                    for t in np.flatnonzero(wanted.any(axis=0)).tolist():
                        _resolve(best[own[t].dims], block, i + np.flatnonzero(wanted[:, t]), own[t], lists)
        for dims, found in best.items():
            query, ids, score = found.rows()
            columns = (blocks[dims].places[query], blocks[dims].ids[query], ids, score)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "query_id", "vec_id", "score"])

    return search


_FOUND = "place long, query_id long, vec_id long, score long"


def _queries(own: DataFrame) -> DataFrame:
    """dims, place, query_id, vector of the queries in tiles."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t.dims, int(t.places[i]), int(t.ids[i]), t.vectors[i].astype("<i8").tobytes()) for t in read_tiles(b) for i in np.flatnonzero(t.queries)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds, strict=True)], ["dims", "place", "query_id", "vector"])

    return own.mapInArrow(take, "dims int, place long, query_id long, vector binary")


def _block(rows: pa.Table) -> dict[int, Block]:
    dims, places, ids = (rows.column(c).to_numpy() for c in ("dims", "place", "query_id"))
    out = {}
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        data = b"".join(rows.column("vector").take(pa.array(at)).to_pylist())
        out[d] = Block(ids[at], places[at], np.frombuffer(data, "<i8").reshape(len(at), d))
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("place").orderBy(F.desc("score"), "vec_id")  # at most k rows a task
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = K, lists: int = LISTS, tile_rows: int = TILE_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of vectors (vec_id, embedding) that is_query
    holds for, the k other rows of highest inner product."""
    spark = vectors.sparkSession
    own = materialize(tiles(vectors, is_query, lists, tile_rows), "tiles")
    asked = materialize(_queries(own), "queries")
    size = asked.agg(F.sum(F.length("vector") + 16).alias("bytes")).first()["bytes"] or 0
    blocks, path = max(1, -(-size // block_bytes)), new_path(spark, "found")
    for n in range(blocks):
        # A block is bounded by block_bytes, and so is what comes back of it: a cutoff for each query.
        block = _block(asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == n).toArrow())
        first = own.mapInArrow(_phase(spark.sparkContext.broadcast(block), k, lists, LEADING_TILES), _FOUND)
        least = _ranked(first, k).where(F.col("rank") == k).select("place", "score").toArrow()
        reached = dict(zip(least.column("place").to_pylist(), least.column("score").to_pylist(), strict=True))
        for b in block.values():
            b.cutoffs = np.array([reached.get(p, -np.inf) for p in b.places.tolist()], np.float64)
            b.cutoffs = np.where(np.abs(b.cutoffs) < 2.0**53, b.cutoffs, b.cutoffs - 2.0**-50 * np.abs(b.cutoffs))
            b.cutoffs[np.isnan(b.cutoffs)] = -np.inf
        rest = own.mapInArrow(_phase(spark.sparkContext.broadcast(block), k, lists, LEADING_TILES), _FOUND)
        _ranked(rest, k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
