"""Links between texts whose sets of word shingles have a Jaccard similarity of THRESHOLD percent or
more: size-banded tiles, bitmap signatures, exact intersection.

1. Each text's distinct five-word shingles are a sorted array of 64-bit hashes; equal sets are one
   node, whatever their number.
2. Two similar sets share one of their first n - ceil(0.8 n) + 1 shingles in any common order. The order
   is by frequency, counted over all texts in hashed buckets, then by hash: so passages that many texts
   share come last. Shingles of these prefixes that two nodes share are keys.
3. Leaders: in each key's nodes one is drawn, the others are held against it, and what is linked is one
   component from then on. A key whose nodes are all of one component is settled, so a large group of
   near copies costs a comparison for each node, not for each pair.
4. What is left goes into tiles: a key's nodes of a band of sizes, and of the band below, as sizes of
   similar sets differ by a quarter at most. A key with more nodes than a tile holds is cut into parts,
   each pair of which is a tile. Two nodes are compared at the first key that they share.
5. In a tile, sets are bitmaps as wide as their band's sizes. Bits that two bitmaps don't share bound the
   overlap from above; nodes with a partner that this bound admits, in another component, get their
   arrays, and a second pass intersects these exactly and returns a forest of links.

Nodes are told apart by 64-bit hashes of whole sets, and a second hash is compared with the first: if two
different sets had one, all is done again with another seed. Shingles are 64-bit hashes of their words'.

Defined results: A-Z alone are lower-cased. A null text, or one without words, has an empty set, is linked
with nothing and names its own component. Fewer words than a shingle: their whole sequence is the only
shingle. Equal sets are linked. Repeated rows are links of their own kind: one component. A null doc_id
never names a component unless all of its rows are null. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.runtime import chunks, drop, hinted, materialize, partitions, ship
from marlstone.scratch import spread

WORDS, THRESHOLD = 5, 80
#: Previous keys of a node that a tile knows.
KNOWN_KEYS = 16
SEED = 42
#: Shingles for each bucket of the frequency table on average, the number of buckets, and those of a slice.
PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS, SLICE = 16, 1 << 12, 1 << 24, 1 << 16
#: Steps of a frequency's logarithm: 255 stand for more texts than there are.
LEVELS = 4
#: Times that leaders are drawn before tiles are made, at most: while so large a part of their pairs is linked.
LEADER_ROUNDS, WORTHWHILE = 3, 0.1
#: Sizes of a band differ by less than this factor, a little above 1 / THRESHOLD.
BAND = 1.26
#: Bytes of the arrays of a part of a tile, and nodes in it at most.
PART_BYTES, MOST_NODES = 8 << 20, 1024
#: Words of bitmaps that are compared at once.
BLOCK_WORDS = 1 << 20


#: Odd factors, by place in a shingle, of its words' hashes.
_FACTORS = np.random.default_rng(12).integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles: sums of its words' XXH64, each by the
    factor of its place, so that shingles that differ in one word never have one hash."""
    from xxhash import xxh64_intdigest

    split = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    words = int(sizes.sum())
    # What a shingle reads beyond its text is dropped, or replaced below.
    hashes = np.zeros(words + WORDS, np.uint64)
    hashes[:words] = np.fromiter(map(xxh64_intdigest, chain.from_iterable(split)), np.uint64, words)
    del split
    total = np.zeros(words, np.uint64)
    for i in range(WORDS):
        total += hashes[i : i + words] * _FACTORS[i]
    stops = np.cumsum(sizes)
    for a, n in zip((stops - sizes)[sizes < WORDS].tolist(), sizes[sizes < WORDS].tolist(), strict=True):
        if n:
            total[a] = (hashes[a : a + n] * _FACTORS[:n]).sum(dtype=np.uint64)
    total ^= total >> np.uint64(32)  # so that all bits depend on all words
    total *= _FACTORS[0]
    total ^= total >> np.uint64(29)
    out = []
    for a, n in zip((stops - sizes).tolist(), sizes.tolist(), strict=True):
        held = np.sort(total[a : a + min(n, max(1, n - WORDS + 1))])  # np.unique takes five times as long
        new = held[1:] != held[:-1]
        out.append(held if new.all() else held[np.append(True, new)])
    return out


def shingle_set(text: bytes) -> np.ndarray:
    return shingle_sets([text])[0]


def prefix_size(n: int) -> int:
    """Two similar sets share one of so many first shingles."""
    return n - -(-THRESHOLD * n // 100) + 1


def similar(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= THRESHOLD * (a + b - shared)


def least_shared(total: np.ndarray) -> np.ndarray:
    """The smallest intersection of similar sets of so many elements together."""
    return -(-THRESHOLD * total // (100 + THRESHOLD))


def bitmap_bits(n: int) -> int:
    """The bits of a set's bitmap: as wide as a tile of its own or the next band needs."""
    return tile_bits(band_of(n) + 1)


def tile_bits(band: int) -> int:
    return max(64, 1 << math.ceil(math.log2(BAND ** (band + 1))))


def band_of(n: int) -> int:
    return int(math.log(n) / math.log(BAND))


def bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(bitmap_bits(len(hashes)), np.uint8)
    bits[(hashes >> np.uint64(32)) & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(held: bytes, bits: int) -> np.ndarray:
    """A bitmap at a narrower width, as 64-bit words."""
    return np.bitwise_or.reduce(np.frombuffer(held, np.uint64).reshape(-1, bits // 64), axis=0)


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def node_of(hashes: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit hashes of a set, the first as the node's name."""
    from xxhash import xxh64_intdigest

    held = hashes.tobytes()
    return tuple(int(np.uint64(xxh64_intdigest(held, seed + i)).view(np.int64)) for i in range(2))


# Passes over the texts ---------------------------------------------------------------------------


def described(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, n, node, second, bits, texted for every row: the size of its set, two hashes and the bitmap
    of it (null for an empty set), and a hash of its text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in chunks(b.column("text")):
                sets = shingle_sets(texts)
                names = [node_of(s, seed) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(start, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x[0] for x in names], pa.int64()),
                        pa.array([x[1] for x in names], pa.int64()),
                        pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                        b.column("texted").slice(start, len(texts)),
                    ],
                    ["doc_id", "n", "node", "second", "bits", "texted"],
                )

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("texted"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, node long, second long, bits binary, texted long")


def bucket_count(shingles: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1, shingles / PER_BUCKET)))))


def frequency_levels(docs: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket of shingles a logarithm of its texts. Tasks send counts by slices of the table, which
    others add up as they come; a byte for each bucket comes to the driver, MOST_BUCKETS at most."""
    slices = max(1, buckets // SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.uint32)
        for b in batches:
            for _, texts in chunks(b.column("text")):
                found = np.sort(np.concatenate(shingle_sets(texts)) & np.uint64(buckets - 1))
                edges = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
                held[found[edges]] += np.diff(np.append(edges, len(found))).astype(np.uint32)
        for i, x in enumerate(held.reshape(slices, -1)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("slice").to_pylist(), b.column("counts"), strict=True):
                counts = np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.int64)
                held[i] = held[i] + counts if i in held else counts
        for i, x in held.items():
            levels = (LEVELS * np.log2(1 + x)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(levels.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    shape = "slice int, counts binary"
    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, shape)
    out = np.zeros((slices, buckets // slices), np.uint8)
    for row in counted.repartition(min(slices, partitions(docs.sparkSession)), "slice").mapInArrow(add, shape).toLocalIterator():
        out[row.slice] = np.frombuffer(zlib.decompress(row.counts), np.uint8)
    return out.ravel()


def emitted(docs: DataFrame, levels: np.ndarray, seed: int) -> DataFrame:
    """key, node, n, at: the prefix of every text's set, placed in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for b in batches:
            for _, texts in chunks(b.column("text")):
                keys, nodes, sizes, seen = [], [], [], set()
                for s in shingle_sets(texts):
                    if not len(s) or (name := node_of(s, seed)[0]) in seen:
                        continue
                    seen.add(name)
                    order = np.argsort(level[s & np.uint64(len(level) - 1)], kind="stable")
                    keys.append(s[order[: prefix_size(len(s))]].view(np.int64))
                    nodes.append(name)
                    sizes.append(len(s))
                if keys:
                    times = [len(k) for k in keys]
                    columns = [np.concatenate(keys), np.repeat(np.array(nodes, np.int64), times), np.repeat(np.array(sizes, np.int64), times)]
                    columns.append(np.concatenate([np.arange(x, dtype=np.int32) for x in times]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "at"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, node long, n long, at int")


def arrays(docs: DataFrame, rows: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """node, hashes of the wanted nodes (node): read again from one text of each."""
    wanted = hinted(materialize(wanted, "wanted"), 24)
    texts = rows.join(wanted, "node").groupBy("node").agg(F.min("texted").alias("texted")).select("texted").distinct()
    texts = hinted(materialize(texts, "texted"), 24)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, held in chunks(b.column("text")):
                found = {node_of(s, seed)[0]: s for s in shingle_sets(held) if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["node", "hashes"])

    read = docs.select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("texted")).join(texts, "texted")
    found = read.select("text").mapInArrow(run, "node long, hashes binary")
    return materialize(found.dropDuplicates(["node"]), "arrays")


# Pairs -------------------------------------------------------------------------------------------


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        n, m = (np.asarray(b.column(c)) for c in ("n", "n2"))
        for one, two, total in zip(b.column("bits"), b.column("bits2"), n + m, strict=True):
            one, two = one.as_py(), two.as_py()
            width = 8 * min(len(one), len(two))
            apart = int(bits_apart(folded(one, width), folded(two, width)))
            keep.append((total - apart) // 2 >= least_shared(total))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("parent")], ["key", "parent"]).filter(pa.array(keep, pa.bool_()))


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for one, two in zip(b.column("hashes"), b.column("hashes2"), strict=True):
            one, two = (np.frombuffer(x.as_py(), np.uint64) for x in (one, two))
            keep.append(similar(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two)))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("parent")], ["key", "parent"]).filter(pa.array(keep, pa.bool_()))


def bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of pairs (key, parent) of nodes that their bitmaps (node, n, bits) admit."""
    return _both(pairs, bits, ["n", "bits"]).mapInArrow(_bound, "key long, parent long")


def intersected(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (key, parent) of nodes whose sets (node, hashes) are similar."""
    return _both(pairs, sets, ["hashes"]).mapInArrow(_intersect, "key long, parent long")


def _both(pairs: DataFrame, held: DataFrame, what: list[str]) -> DataFrame:
    one = held.select(F.col("node").alias("key"), *what)
    two = held.select(F.col("node").alias("parent"), *[F.col(c).alias(f"{c}2") for c in what])
    return pairs.join(one, "key").join(two, "parent").select("key", "parent", *what, *[f"{c}2" for c in what])


def relabelled(keys: DataFrame, links: DataFrame) -> DataFrame:
    """keys (key, node, n, at) of which the nodes are not all of one component, with comp."""
    comps = hinted(materialize(components(links), "comps"), 48)
    named = keys.join(comps.select(F.col("key").alias("node"), "root"), "node", "left")
    named = named.select("key", "node", "n", "at", F.coalesce("root", "node").alias("comp"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return materialize(named.join(open_keys, "key", "left_semi"), "keys")


def led(keys: DataFrame, turn: int) -> DataFrame:
    """key, parent: every node with the leader of its key, where that may be similar and isn't linked yet."""
    leader = F.min_by(F.struct("node", "n", "comp"), F.xxhash64("node", F.lit(turn))).alias("leader")
    leaders = hinted(materialize(keys.groupBy("key").agg(leader), "leaders"), 96)
    met = keys.join(leaders, "key").where((F.col("comp") != F.col("leader.comp")) & _sizes_fit(F.col("n"), F.col("leader.n")))
    return met.select(F.greatest("node", "leader.node").alias("key"), F.least("node", "leader.node").alias("parent")).distinct()


# Tiles -------------------------------------------------------------------------------------------

TILE = ["key", "band", "one", "two"]


def tiled(keys: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """TILE, node, n, comp, home, part, known: the rows of every tile. keys: key, node, n, at, comp.

    known are the node's keys before this one. Two nodes that both know a key have met there (or before:
    at the first key that they share they know none in common), and needn't meet again."""
    before = W.partitionBy("node").orderBy("at").rowsBetween(-KNOWN_KEYS, -1)
    keys = keys.withColumn("known", F.collect_list("key").over(before))
    band = F.floor(F.ln("n") / F.lit(math.log(BAND))).cast("int")
    places = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home"))))
    rows = keys.withColumn("p", places).select("key", "p.band", "node", "n", "comp", "p.home", "known")
    last = F.try_element_at("known", F.lit(-1))
    groups = rows.groupBy("key", "band").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if("home").alias("homes"),
        F.min("comp").alias("lo"),
        F.max("comp").alias("hi"),
        F.count(last).alias("later"),
        F.min(last).alias("last_lo"),
        F.max(last).alias("last_hi"),
    )
    met = (F.col("later") == F.col("nodes")) & (F.col("last_lo") == F.col("last_hi"))  # all have met at one key before
    groups = groups.where((F.col("homes") > 0) & (F.col("lo") < F.col("hi")) & ~F.coalesce(met, F.lit(False)))
    most = F.greatest(F.lit(16), F.least(F.lit(most_nodes), F.floor(F.lit(PART_BYTES) / (8 * F.pow(F.lit(BAND), F.col("band") + 1))).cast("int")))
    groups = materialize(groups.select("key", "band", F.ceil(F.col("nodes") / most).cast("int").alias("parts")), "groups")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    dealt = rows.join(hinted(groups, 48), ["key", "band"]).withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("key", "band", "node", "n", "comp", "home", "part", "known", other)
    return dealt.select("key", "band", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "node", "n", "comp", "home", "part", "known")


def _partners(tile: pa.Table) -> Iterator[tuple[int, list[int]]]:
    """Rows of a tile with those after them that may be similar by sizes and bitmaps, are of another
    component and haven't met before. Blocks of rows are compared with all at once."""
    bits = _bitmaps(tile)
    n, comp, home, part = (np.asarray(tile.column(c)) for c in ("n", "comp", "home", "part"))
    known = [set(x.as_py()) for x in tile.column("known")]
    parted = tile.column("one")[0].as_py() != tile.column("two")[0].as_py()
    every, step = np.arange(len(n)), max(1, BLOCK_WORDS // bits.size)
    for start in range(0, len(n), step):
        rows = slice(start, start + step)
        total = n[rows, None] + n
        fit = (comp[rows, None] != comp) & (home[rows, None] | home) & (every > every[rows, None])
        fit &= np.minimum(n[rows, None], n) * 100 >= np.maximum(n[rows, None], n) * THRESHOLD
        if parted:
            fit &= part[rows, None] != part  # pairs of one part have a tile of their own
        if not fit.any():
            continue
        fit &= (total - bits_apart(bits[rows, None], bits)) // 2 >= least_shared(total)
        for i in np.flatnonzero(fit.any(axis=1)).tolist():
            found = [j for j in np.flatnonzero(fit[i]).tolist() if known[start + i].isdisjoint(known[j])]
            if found:
                yield start + i, found


def _bitmaps(tile: pa.Table) -> np.ndarray:
    held = [x.as_py() for x in tile.column("bits")]
    width = min(tile_bits(tile.column("band")[0].as_py()), *(8 * len(x) for x in held))
    return np.stack([folded(x, width) for x in held])


def _needed(tile: pa.Table) -> pa.Table:
    """The rows of a tile that have a possible partner."""
    has = np.zeros(tile.num_rows, bool)
    for i, found in _partners(tile):
        has[i] = True
        has[found] = True
    kept = tile.filter(pa.array(has)).drop_columns(["bits"])
    return kept.set_column(kept.column_names.index("known"), "known", kept.column("known").cast(pa.list_(pa.int64())))


def _linked(tile: pa.Table) -> pa.Table:
    """A forest of links between a tile's nodes of different components."""
    comp, node = tile.column("comp").to_numpy().copy(), np.asarray(tile.column("node"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in tile.column("hashes")]
    links = []
    for i, found in _partners(tile):
        for j in found:
            if comp[i] != comp[j] and similar(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                comp[comp == comp[j]] = comp[i]
                links.append((max(node[i], node[j]), min(node[i], node[j])))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"key": pa.array(a, pa.int64()), "parent": pa.array(b, pa.int64())})


def needed_rows(keys: DataFrame, bits: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """The rows of tiles that have a possible partner."""
    held = [*TILE, "node", "n", "comp", "home", "part", "known"]
    rows = tiled(keys, most_nodes).join(bits.select("node", "bits"), "node").select(*held, "bits")
    shape = "key long, band int, one int, two int, node long, n long, comp long, home boolean, part int, known array<long>"
    return materialize(rows.groupBy(*TILE).applyInArrow(_needed, shape), "needed")


def tile_links(needed: DataFrame, bits: DataFrame, sets: DataFrame) -> DataFrame:
    """key, parent: links between nodes of different components in one tile."""
    full = needed.join(bits.select("node", "bits"), "node").join(sets, "node")
    return full.select(*TILE, "node", "n", "comp", "home", "part", "known", "bits", "hashes").groupBy(*TILE).applyInArrow(_linked, "key long, parent long")


def similar_nodes(docs: DataFrame, rows: DataFrame, shingles: int, seed: int, most_nodes: int = MOST_NODES, rounds: int = LEADER_ROUNDS) -> DataFrame:
    """key, parent: links that connect what all links between similar nodes connect."""
    levels = frequency_levels(docs, bucket_count(shingles))
    prefixes = materialize(emitted(docs, levels, seed), "prefixes")
    # Keys that two nodes share; copies give their nodes again.
    shared = prefixes.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    shared = hinted(materialize(shared, "shared"), 24)
    keys = materialize(prefixes.join(shared, "key", "left_semi").distinct().withColumn("comp", F.col("node")), "keys")
    drop(prefixes)
    bits = rows.join(hinted(materialize(keys.select("node").distinct(), "wanted"), 24), "node")
    bits = materialize(bits.select("node", "n", "bits").dropDuplicates(["node"]), "bitmaps")
    links = None
    for turn in range(rounds):
        pairs = materialize(led(keys, turn), "led")
        asked = pairs.count()
        if not asked:
            break
        few = materialize(bounded(pairs, bits), "bounded")
        ends = few.select(F.explode(F.array("key", "parent")).alias("node")).distinct()
        found = materialize(intersected(few, arrays(docs, rows, ends, seed)), "links")
        links = links.unionByName(found) if links is not None else found
        linked = found.count()
        smaller = relabelled(keys.drop("comp"), links)
        drop(keys)
        keys = smaller
        if linked < WORTHWHILE * asked:
            break
    if keys.limit(1).count():
        needed = needed_rows(keys, bits, most_nodes)
        sets = arrays(docs, rows, needed.select("node").distinct(), seed)
        found = materialize(tile_links(needed, bits, sets), "links")
        links = links.unionByName(found) if links is not None else found
    return links if links is not None else keys.select("key", F.col("node").alias("parent"))


def components_of(docs: DataFrame, most_nodes: int = MOST_NODES, rounds: int = LEADER_ROUNDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = spread(docs.select("doc_id", "text"))
    rows = materialize(described(docs, seed), "described")
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(F.min("second").alias("lo"), F.max("second").alias("hi"), F.min("doc_id").alias("least")), "nodes")
    if nodes.where("lo < hi").limit(1).count():
        return components_of(docs, most_nodes, rounds, seed + 2)
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    found = materialize(components(similar_nodes(docs, rows, shingles, seed, most_nodes, rounds)), "components")
    rooted = nodes.join(hinted(found, 48).withColumnRenamed("key", "node"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    # Written and counted, so that a hot root's rows can be split.
    names = hinted(materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names"), 64)
    named = hinted(materialize(rooted.join(names, "root").select("node", "component_id"), "named"), 64)
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


ORACLE_SQL = rf"""WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(list_transform(generate_series(1, greatest(1, len(words) - {WORDS - 1})), lambda i: list_aggregate(words[i:i + {WORDS - 1}], 'string_agg', ' '))) AS shingles
  FROM texts WHERE len(words) > 0
), sized AS (SELECT doc_id, shingles, len(shingles) AS n, md5(list_sort(shingles)::VARCHAR) AS digest FROM shingled
), distinct_sets AS (SELECT min(doc_id) AS node, digest, any_value(n) AS n, any_value(shingles) AS shingles FROM sized GROUP BY digest
), parts AS (SELECT node, n, unnest(shingles) AS shingle FROM distinct_sets
), links AS (
  SELECT a.node AS a, b.node AS b FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {THRESHOLD} * (a.n + b.n - count(*))
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT node, node AS other FROM distinct_sets
  UNION SELECT r.node, w.b FROM reached r JOIN ways w ON r.other = w.a
), roots AS (SELECT node, min(other) AS component_id FROM reached GROUP BY 1)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.component_id, t.doc_id) AS component_id
FROM texts t LEFT JOIN sized s USING (doc_id) LEFT JOIN distinct_sets d USING (digest) LEFT JOIN roots r USING (node)"""
