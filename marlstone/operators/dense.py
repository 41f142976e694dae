"""Exact cosine top-k. Each task scores its vectors against a block of queries and keeps k of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.ranking import top_k
from marlstone.scratch import materialize, new_path, ship

#: Queries of one pass over the vectors; more queries take more passes.
QUERIES_AT_ONCE = 8192
#: Scores that a task holds at once.
SCORES_AT_ONCE = 2_000_000


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score (cosine, 6 places) for queries (query_id, embedding) over vectors
    (vec_id, embedding). Null vectors, zero vectors and vectors of other lengths take no part."""
    spark = vectors.sparkSession
    ship(spark)
    usable = materialize(queries.where("embedding is not null").select("query_id", "embedding"), "queries")
    passes = max(1, -(-usable.count() // QUERIES_AT_ONCE))
    path = new_path(spark, "dense")
    for p in range(passes):  # a block of queries is bounded
        block = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow().combine_chunks()
        found = vectors.select("vec_id", "embedding").mapInArrow(_scorer(spark.sparkContext.broadcast(block), k), "query_id long, vec_id long, score double")
        best = top_k(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")
        if passes == 1:
            return best
        best.write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(path)


def units(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and unit vectors of those that take part."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    lengths = np.where(pc.is_valid(ids).to_numpy(zero_copy_only=False), lengths, -1)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    names, out = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        m = flat[begins[rows][:, None] + np.arange(n)]
        length = np.sqrt((m * m).sum(axis=1))
        use = np.isfinite(length) & (length > 0)
        out[n] = names[rows[use]], m[use] / length[use, None]
    return out


def _scorer(shared, k: int):
    def keep(held: list[np.ndarray]) -> list[np.ndarray]:
        """(query, id, score): the best k of each query, by score and then id."""
        query, ids, score = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        return [(query[nth < k], ids[nth < k], score[nth < k])]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        queries = units(block.column("query_id").combine_chunks(), block.column("embedding").combine_chunks()) if block.num_rows else {}
        best: dict[int, list] = {n: [] for n in queries}
        for b in batches:
            for n, (ids, rows) in units(b.column("vec_id"), b.column("embedding")).items():
                if n not in queries or not len(ids):
                    continue
                wanted = queries[n][1]
                step = max(1, SCORES_AT_ONCE // len(ids))
                for i in range(0, len(wanted), step):
                    scores = np.round(wanted[i : i + step] @ rows.T, 6) + 0.0
                    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(scores), -np.inf)
                    at, row = np.nonzero(scores >= least[:, None])  # with all that tie for the last place
                    best[n].append((at + i, ids[row], scores[at, row]))
                if sum(len(x[0]) for x in best[n]) > SCORES_AT_ONCE:
                    best[n] = keep(best[n])
        for n, held in best.items():
            if held:
                query, ids, found = keep(held)[0]
                yield pa.RecordBatch.from_arrays([pa.array(queries[n][0][query], pa.int64()), pa.array(ids, pa.int64()), pa.array(found)], ["query_id", "vec_id", "score"])

    return score
