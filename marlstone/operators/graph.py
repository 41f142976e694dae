"""The chunk graph: neighbours in reading order, on the same page and on adjacent pages; and the
expansion of seed hits along it.

A page of n chunks has n(n-1)/2 edges of its own. `edges` and `nodes` list them; `runs` is the same graph
with a row for each chunk (its page's chunks and those of the pages beside it are its neighbours, and so are
prev_id and next_id), from which `run_stats` counts in closed form and `expand_runs` takes what seeds need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.bm25 import LAST_PAGE
from marlstone.operators.ranking import ranked, top_k
from marlstone.scratch import materialize

KINDS = ("prev_next", "same_page", "adjacent_page")
DECAY = 0.95


def edges(chunks: DataFrame) -> DataFrame:
    """src, dst, edge_type of chunks (doc_id, page_num, chunk_id); an edge that several rules give is
    credited to the first of KINDS. Pairs that follow each other are left out of the other rules by their places,
    so edges need not meet to be made distinct; only if chunk ids repeat are they grouped."""
    rows = chunks.select("doc_id", "page_num", "chunk_id")
    page_key = F.when(F.col("page_num") > 0, F.col("page_num")).otherwise(LAST_PAGE)
    placed = materialize(ranked(rows.withColumn("page_key", page_key), ["doc_id"], ["page_key", "chunk_id"], "at").drop("page_key"), "placed")
    repeated = placed.groupBy("chunk_id").count().where("count > 1").limit(1).count() > 0
    here = placed.select("doc_id", "at", F.col("chunk_id").alias("a"))
    after = placed.select("doc_id", (F.col("at") - 1).alias("at"), F.col("chunk_id").alias("b"))
    follow = here.join(after, ["doc_id", "at"])
    known = placed.where("page_num is not null")
    left = known.select("doc_id", "page_num", F.col("at").alias("a_at"), F.col("chunk_id").alias("a"))
    right = known.select("doc_id", "page_num", F.col("at").alias("b_at"), F.col("chunk_id").alias("b"))
    apart = F.lit(True) if repeated else F.abs(F.col("a_at") - F.col("b_at")) != 1
    same = left.join(right, ["doc_id", "page_num"]).where((F.col("a") < F.col("b")) & apart)
    next_page = right.withColumn("page_num", F.col("page_num") - 1)
    adjacent = left.join(next_page, ["doc_id", "page_num"]).where((F.col("a") != F.col("b")) & apart)

    def both_ways(pairs: DataFrame, kind: int) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
        return pairs.select(ends.alias("e")).select("e.src", "e.dst", F.lit(kind).alias("kind"))

    every = both_ways(follow, 0).unionByName(both_ways(same, 1)).unionByName(both_ways(adjacent, 2))
    if repeated:
        every = every.groupBy("src", "dst").agg(F.min("kind").alias("kind"))
    names = F.array(*map(F.lit, KINDS))
    return every.select("src", "dst", F.get(names, F.col("kind")).alias("edge_type"))


def nodes(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """chunks with the sorted array neighbors; a chunk without edges has an empty one."""
    lists = links.groupBy(F.col("src").alias("chunk_id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
    return chunks.join(lists, "chunk_id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))


def stats(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, directed edges, degrees, and edges by kind (adjacent pages count directed)."""
    count = chunks.agg(F.count(F.lit(1)).alias("total_nodes"))
    degrees = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), *(F.count_if(F.col("edge_type") == k).alias(k) for k in KINDS))
    totals = degrees.agg(
        F.coalesce(F.sum("degree"), F.lit(0)).alias("total_edges_directed"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.coalesce((F.sum("prev_next") / 2).cast("long"), F.lit(0)).alias("prev_next"),
        F.coalesce((F.sum("same_page") / 2).cast("long"), F.lit(0)).alias("same_page"),
        F.coalesce(F.sum("adjacent_page"), F.lit(0)).alias("adjacent_page"),
    )
    ratio = F.when(F.col("total_nodes") > 0, F.col("total_edges_directed") / F.col("total_nodes")).otherwise(0.0)
    return count.crossJoin(totals).withColumn("avg_degree", F.round(ratio, 4))


def runs(chunks: DataFrame) -> DataFrame:
    """The graph of chunks (doc_id, page_num, chunk_id) by runs of pages: chunk_id, doc_id, page_num, prev_id,
    next_id. As large as the chunks, whatever pages hold."""
    page_key = F.when(F.col("page_num") > 0, F.col("page_num")).otherwise(LAST_PAGE)
    rows = chunks.select("doc_id", "page_num", "chunk_id").withColumn("page_key", page_key)
    placed = materialize(ranked(rows, ["doc_id"], ["page_key", "chunk_id"], "at").drop("page_key"), "placed")
    before = placed.select("doc_id", (F.col("at") + 1).alias("at"), F.col("chunk_id").alias("prev_id"))
    after = placed.select("doc_id", (F.col("at") - 1).alias("at"), F.col("chunk_id").alias("next_id"))
    return placed.join(before, ["doc_id", "at"], "left").join(after, ["doc_id", "at"], "left").select("chunk_id", "doc_id", "page_num", "prev_id", "next_id")


def run_stats(chunks: DataFrame) -> DataFrame:
    """As stats, from chunks (doc_id, page_num, chunk_id) alone: pages of n and m chunks side by side have
    n(n-1)/2 and nm pairs, less those that follow each other, which are credited to that. Chunk ids that
    repeat would be one node: then the edges are listed and counted."""
    held = materialize(runs(chunks), "runs")
    if held.groupBy("chunk_id").count().where("count > 1").limit(1).count():
        return stats(chunks, materialize(edges(chunks), "edges"))
    sizes = held.where("page_num is not null").groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "sizes")
    before = sizes.select("doc_id", (F.col("page_num") + 1).alias("page_num"), F.col("n").alias("before"))
    after = sizes.select("doc_id", (F.col("page_num") - 1).alias("page_num"), F.col("n").alias("after"))
    pages = sizes.join(before, ["doc_id", "page_num"], "left").join(after, ["doc_id", "page_num"], "left")
    pages = materialize(pages.select("doc_id", "page_num", "n", F.coalesce("after", F.lit(0)).alias("after"), (F.col("n") - 1 + F.coalesce("before", F.lit(0)) + F.coalesce("after", F.lit(0))).alias("near")), "around")
    # Pairs that follow each other, by how far their pages are apart.
    one = held.where("next_id is not null").select("doc_id", F.col("chunk_id").alias("a"), F.col("page_num").alias("a_page"), F.col("next_id").alias("b"))
    two = held.select(F.col("chunk_id").alias("b"), F.col("page_num").alias("b_page"))
    follow = materialize(one.join(two, "b").withColumn("apart", F.abs(F.col("a_page") - F.col("b_page"))), "follow")
    ends = F.explode(F.array(F.struct(F.col("a").alias("chunk_id"), F.col("a_page").alias("page_num")), F.struct(F.col("b").alias("chunk_id"), F.col("b_page").alias("page_num"))))
    far = follow.where(F.coalesce(F.col("apart"), F.lit(2)) > 1).select("doc_id", ends.alias("e")).select("doc_id", "e.*")
    extra = far.groupBy("doc_id", "page_num", "chunk_id").agg(F.count(F.lit(1)).alias("extra"))
    degrees = extra.join(pages, ["doc_id", "page_num"], "left").select((F.col("extra") + F.coalesce("near", F.lit(0))).alias("degree"))
    degrees = degrees.unionByName(pages.select(F.col("near").alias("degree")))
    none = F.lit(0).cast("long")
    by_page = pages.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), none).alias("same"), F.coalesce(F.sum(F.col("n") * F.col("after")), none).alias("beside"))
    by_order = follow.agg(F.count(F.lit(1)).alias("prev_next"), F.count_if(F.col("apart") == 0).alias("same_follow"), F.count_if(F.col("apart") == 1).alias("beside_follow"))
    totals = by_page.crossJoin(by_order).crossJoin(degrees.agg(F.coalesce(F.max("degree"), none).alias("max_degree"))).crossJoin(held.agg(F.count(F.lit(1)).alias("total_nodes")))  # one row each
    counted = totals.select("total_nodes", "max_degree", "prev_next", (F.col("same") - F.col("same_follow")).alias("same_page"), (2 * (F.col("beside") - F.col("beside_follow"))).alias("adjacent_page"))
    counted = counted.withColumn("total_edges_directed", 2 * (F.col("prev_next") + F.col("same_page")) + F.col("adjacent_page"))
    ratio = F.when(F.col("total_nodes") > 0, F.col("total_edges_directed") / F.col("total_nodes")).otherwise(0.0)
    return counted.select("total_nodes", "total_edges_directed", "max_degree", "prev_next", "same_page", "adjacent_page", F.round(ratio, 4).alias("avg_degree"))


def first_neighbours(seeds: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """chunk_id, neighbors of the seeds (chunk_id): the first neighbours, in order, `most` at least. Of a page
    only its first chunks are looked at."""
    asked = held.join(seeds.select("chunk_id").distinct(), "chunk_id", "left_semi")
    places = F.explode(F.array(*[F.col("page_num") + i for i in (-1, 0, 1)])).alias("page_num")
    pages = asked.where("page_num is not null").select("chunk_id", "doc_id", places)
    wanted = pages.select("doc_id", "page_num").distinct()
    first = top_k(held.join(wanted, ["doc_id", "page_num"], "left_semi").select("doc_id", "page_num", F.col("chunk_id").alias("n")), ["doc_id", "page_num"], [F.col("n")], most + 1)
    near = pages.join(first.drop("rank"), ["doc_id", "page_num"]).where(F.col("n") != F.col("chunk_id")).select("chunk_id", "n")
    beside = asked.select("chunk_id", F.explode(F.array("prev_id", "next_id")).alias("n")).where("n is not null")
    lists = near.unionByName(beside).groupBy("chunk_id").agg(F.array_sort(F.collect_set("n")).alias("neighbors"))
    return lists.withColumn("neighbors", F.slice("neighbors", 1, most))


def _fold(k_total: int, per_seed: int) -> Column:
    """Seeds first, then each seed's neighbours in order, up to per_seed new ones, k_total in all."""
    hit = "struct<chunk_id:string,score:double>"
    start = F.struct(F.col("seeds").alias("hits"), F.transform("seeds", lambda s: s["chunk_id"]).alias("seen"))

    def one_seed(state: Column, seed: Column) -> Column:
        fresh = F.slice(F.filter(seed["neighbors"], lambda n: ~F.array_contains(state["seen"], n)), 1, per_seed)
        room = F.greatest(F.lit(0), F.lit(k_total) - F.size(state["hits"]))
        fresh = F.slice(fresh, F.lit(1), room)
        hits = F.transform(fresh, lambda n: F.struct(n.alias("chunk_id"), (seed["score"] * DECAY).alias("score")))
        return F.struct(F.concat(state["hits"], hits).cast(f"array<{hit}>").alias("hits"), F.concat(state["seen"], fresh).alias("seen"))

    typed = start.cast(f"struct<hits:array<{hit}>,seen:array<string>>")
    return F.slice(F.aggregate("with_neighbors", typed, one_seed)["hits"], 1, k_total)


def expand_runs(seeds: DataFrame, held: DataFrame, k_total: int = 5, k_seed: int = 2, per_seed: int = 2) -> DataFrame:
    """As expand, from a graph of runs. What a query has seen of a seed's neighbours are seeds and those
    taken for other seeds, so the first few suffice."""
    seeds = materialize(seeds.select("query_id", "rank", "chunk_id", "score"), "seeds")
    near = first_neighbours(seeds, held, k_seed + k_seed * per_seed + per_seed)
    return expand(seeds, near, k_total, k_seed, per_seed, whole=False)


def expand(seeds: DataFrame, graph_nodes: DataFrame, k_total: int = 5, k_seed: int = 2, per_seed: int = 2, whole: bool = True) -> DataFrame:
    """query_id, rank, chunk_id, score: seeds (query_id, rank, chunk_id, score) and their neighbours.
    A list of a few hits for each query is folded, as what one seed takes the next can't. If the nodes are
    the whole graph, neighbours that it doesn't have are left out."""
    used = seeds.where(F.col("rank") <= max(1, min(k_seed, k_total)))
    used = used.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"))
    near = used.join(graph_nodes.select("chunk_id", F.explode("neighbors").alias("n")), "chunk_id")
    if whole:
        near = near.join(graph_nodes.select(F.col("chunk_id").alias("n")), "n", "left_semi")
    lists = near.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_set("n")).alias("neighbors"))
    full = used.join(lists, ["query_id", "chunk_id"], "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))
    by_query = full.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "neighbors"))).alias("with_neighbors"))
    folded = by_query.withColumn("seeds", F.transform("with_neighbors", lambda s: F.struct(s["chunk_id"].alias("chunk_id"), s["score"].cast("double").alias("score"))))
    return folded.select("query_id", F.posexplode(_fold(k_total, per_seed)).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.chunk_id", F.round("hit.score", 6).alias("score"))
