"""SimHash near-dedup by meet-in-the-middle ball hashing.

A 64-bit fingerprint is the majority vote of the hashes of a text's word shingles. Two fingerprints
within `radius` (even) bits of each other have a common variant within half of it, so every distinct
fingerprint emits its ball of variants and those that share a variant are linked (ball_hashing.py).
Fingerprints that meet in a variant are within the radius of each other, so none is lost; a task
verifies those that meet against the least of them and returns a spanning forest, not all pairs.

`dedup` looks for texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Their fingerprints differ in about ten of 64 bits, too many for one ball. So a text has a signature of
BANDS fingerprints of BAND_BITS bits, and each band's fingerprint is ball-hashed:

1. Texts with one 64-bit fingerprint (the signature's first two bands) are one node. Nodes that share
   a variant in some band with a node whose first 64 bits are near are suspects.
2. Suspects are ball-hashed again with whole signatures. Of those that meet, a task returns the links
   whose signatures are at most FAR bits apart, as a forest of the least total distance: its links up to
   any distance connect what all links up to that distance connect.
3. Links of at most SURE bits hold; the others are verified on the texts (Jaccard of their shingle sets).

Two texts of similarity 0.8 share a variant in one of 32 bands but for 2 in a hundred, those of 0.85
but for 1 in a thousand; the distance of a signature is within FAR but for 2 in a hundred at 0.8.

Defined results: a text that is null or without words has fingerprint zero, linked like any other.
Fewer words than a shingle: their whole sequence is the only shingle. Repeated rows and exact
copies share a fingerprint and so a component. A null doc_id never names a component unless all of
its rows are null. An empty table gives an empty result. Other columns are not read by `components_of`
and kept by `dedup`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.ball_hashing import BALLS, DEAL_BYTES, WHOLE, ball, dealt, emitted, forest, group_of, meetings, roots
from marlstone.llm.components import components
from marlstone.llm.runtime import chunks, hinted, materialize, ship, worker_cache

BITS = 64
WORDS = 4
RADIUS = 4
SEED = 42

#: Distinct fingerprints for each prefix, on average; the prefix grows with the corpus.
PER_PREFIX = 2048
LEAST_PREFIX, MOST_PREFIX = 6, 24
#: Variants that a task holds at once; more are made in rounds over longer prefixes.
VARIANTS_AT_ONCE = 6_000_000
#: Fingerprints that are sent to one prefix at most; beyond, longer prefixes divide them.
MOST_SENT = 1 << 18

#: The signature of `dedup`: shingles of so many words, from so similar on.
SIMILAR_WORDS, SIMILAR = 5, 0.8
BANDS, BAND_BITS, BAND_RADIUS = 32, 32, 2
SIGNATURE = BANDS * BAND_BITS
#: Bits of the first 64 that two suspects differ in at most: 3.5 deviations above the mean at SIMILAR.
SUSPECT = 20
#: Bits of a signature. At SIMILAR the mean is 155 and the deviation 11.5: links from SURE to FAR are verified.
SURE, FAR = 120, 180
#: Nodes for each prefix of a band, on average, and points that are sent to one at most.
BAND_NODES, SUSPECT_NODES = 32_768, 1_024
MOST_NODES, MOST_SUSPECTS = 1 << 20, 1 << 14
#: Variants that more suspects than this share are looked through at once.
CROWDED = 32

_LANES = np.uint64(0x0101010101010101)
_FACTORS = np.random.default_rng(64).integers(0, 2**63, SIGNATURE // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, words: int = WORDS) -> bytes:
    """XXH64 digests, 8 bytes each, of the shingles of a text."""
    from xxhash import xxh64_digest

    split = text.lower().split()
    if not split:
        return b""
    joined = b" ".join(split)
    if len(split) <= words:
        return xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)])


def votes(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Majority votes of runs of n > 0 hashes each. Counts are summed in the bytes of 64-bit words, at
    most 255 hashes at a time."""
    begin = np.cumsum(n) - n
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    runs = np.repeat(begin - 255 * first, parts) + 255 * np.arange(parts.sum())
    out = np.zeros(len(n), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, runs)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        majority = 2 * counts > n[:, None]
        for lane in range(8):
            out |= majority[:, lane].astype(np.uint64) << np.uint64(8 * lane + shift)
    return out


def fingerprints_of(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Majority votes of all shingles, repeats included, as unsigned integers."""
    digests = [shingle_hashes(t, words) for t in texts]
    n = np.array([len(d) // 8 for d in digests], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = n > 0
    if some.any():
        out[some] = votes(np.frombuffer(b"".join(digests), ">u8").astype(np.uint64), n[some])
    return out


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(shingle_hashes(text, SIMILAR_WORDS), ">u8").astype(np.uint64))


def signatures_of(texts: list[bytes]) -> np.ndarray:
    """(texts, SIGNATURE / 64) majority votes of the distinct five-word shingles."""
    sets = [shingle_set(t) for t in texts]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(texts), len(_FACTORS)), np.uint64)
    some = n > 0
    if some.any():
        hashes = np.concatenate(sets)
        for i, factor in enumerate(_FACTORS):
            mixed = hashes * factor
            mixed ^= mixed >> np.uint64(32)
            out[some, i] = votes(mixed * _FACTORS[i - 1], n[some])
    return out


def _with(docs: DataFrame, made: Callable[[list[bytes]], list[pa.Array]], names: str) -> DataFrame:
    """docs with the columns that made gives for their texts."""
    ship(docs.sparkSession)
    columns = docs.columns
    place = columns.index("text")
    new = [x.split()[0] for x in names.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("", lambda: None)  # nothing that another operator has left
        for b in batches:
            for start, texts in chunks(b.column(place).cast(pa.binary()), 2 << 20):
                yield pa.RecordBatch.from_arrays([*b.slice(start, len(texts)).columns, *made(texts)], [*columns, *new])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(add, f"{types}, {names}")


def with_bits(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with the column bits: the fingerprint of text, as a signed long."""
    return _with(docs, lambda texts: [pa.array(fingerprints_of(texts, words).view(np.int64))], "bits long")


def with_signature(docs: DataFrame) -> DataFrame:
    """docs with bits, the first 64 bits of the signature, and the whole of it."""

    def sign(texts: list[bytes]) -> list[pa.Array]:
        signs = signatures_of(texts)
        return [pa.array(signs[:, 0].view(np.int64)), pa.array([x.tobytes() for x in signs], pa.binary())]

    return _with(docs, sign, "bits long, signature binary")


def _forest(child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, root) of the links' components, root the least key; roots themselves left out."""
    keys, ends = np.unique(np.concatenate([child, parent]), return_inverse=True)
    label = roots(ends[: len(child)], ends[len(child) :], len(keys))
    moved = label != np.arange(len(keys))
    return keys[moved], keys[label[moved]]


def meet(prints: np.ndarray, used: np.ndarray, prefix: int, prefix_bits: int, radius: int, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between prints that share a variant with this prefix; used: how many of its bits differ."""
    half, rest = radius // 2, BITS - prefix_bits
    made = sum(int((used == u).sum()) * len(ball(rest, half - u)) for u in range(half + 1))
    none = np.zeros(0, np.int64)
    if made > at_once and prefix_bits < 48:
        found = []
        for s in range(16):
            apart = np.bitwise_count(((prints >> np.uint64(rest - 4)) & np.uint64(15)) ^ np.uint64(s)).astype(np.int64)
            near = used + apart <= half
            if near.sum() > 1:
                found.append(meet(prints[near], (used + apart)[near], (prefix << 4) | s, prefix_bits + 4, radius, at_once))
        child, parent = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
        return _forest(child, parent) if len(child) else (none, none)
    low = np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for u in range(half + 1):
        own = np.flatnonzero(used == u)
        masks = ball(rest, half - u)[:, 0]
        variants.append(((prints[own] & low)[:, None] ^ masks).ravel())
        owners.append(np.repeat(own, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(variant)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(shared):
        return none, none
    at = np.minimum(np.searchsorted(shared, variant), len(shared) - 1)
    met = np.flatnonzero(shared[at] == variant)
    at, who = at[met], prints[owner[met]].view(np.int64)
    least = np.full(len(shared), np.iinfo(np.int64).max)
    np.minimum.at(least, at, who)
    child, parent = who, least[at]
    near = (child != parent) & (np.bitwise_count((child ^ parent).view(np.uint64)) <= radius)
    return _forest(child[near], parent[near]) if near.any() else (none, none)


_PRINT = np.dtype([("point", "<u8")])


def prefix_bits_for(count: int, each: int) -> int:
    return min(MOST_PREFIX, (max(1, count) // each).bit_length())


def links(distinct: DataFrame, count: int, radius: int = RADIUS, at_once: int = VARIANTS_AT_ONCE, most: int = MOST_SENT) -> DataFrame:
    """key, parent: links whose components are those of all pairs of distinct (bits) within radius."""
    prefix_bits, half = max(LEAST_PREFIX, prefix_bits_for(count, PER_PREFIX)), radius // 2
    ship(distinct.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column("bits").to_numpy().view(np.uint64)
            if len(prints):
                yield emitted(prints, np.zeros(len(prints), np.uint64), prints.view(_PRINT), BITS, prefix_bits, half)

    def ask(rows: pa.Table) -> pa.Table:
        depth, prefix, records = group_of(rows, _PRINT)
        prints, prefix = records["point"], prefix & (2**64 - 1)
        used = np.bitwise_count((prints >> np.uint64(BITS - depth)) ^ np.uint64(prefix)).astype(np.int64)
        child, parent = meet(prints, used, prefix, depth, radius, at_once)
        return pa.table({"key": pa.array(child, pa.int64()), "parent": pa.array(parent, pa.int64())})

    balls = distinct.select("bits").mapInArrow(emit, BALLS)
    groups = dealt(balls, BITS, prefix_bits, half, most, _PRINT, lambda records, band: records["point"])
    return groups.groupBy("depth", "prefix", "chunk", "other").applyInArrow(ask, "key long, parent long")


# Texts of similar shingle sets ---------------------------------------------------------------------

_NODE = np.dtype([("key", "<i8"), ("point", "<u4")])
_SUSPECT = np.dtype([("words", "<u8", (SIGNATURE // 64,))])


def _bands(signs: np.ndarray) -> np.ndarray:
    """(BANDS, n) fingerprints of (n, SIGNATURE / 64) words."""
    return np.ascontiguousarray(signs).view("<u4").reshape(len(signs), BANDS).T


def _signs(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u8").reshape(b.num_rows, SIGNATURE // 64)


def _dealt_bands(nodes: DataFrame, each: int, most: int, kind: np.dtype, records_of: Callable, point: Callable, paired: bool) -> DataFrame:
    """The groups of a ball hashing of nodes (signature, bands: a bit for each band that takes part)."""
    ship(nodes.sparkSession)
    prefix_bits, half = min(BAND_BITS, prefix_bits_for(nodes.count(), each)), BAND_RADIUS // 2
    step = max(1, DEAL_BYTES // (kind.itemsize * BANDS * (prefix_bits + 1)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                signs = _signs(part)
                band, node = np.nonzero((part.column("bands").to_numpy() >> np.arange(BANDS)[:, None]) & 1)
                points = _bands(signs)[band, node]
                yield emitted(points.astype(np.uint64), band, records_of(signs[node], points), BAND_BITS, prefix_bits, half)

    balls = nodes.select("signature", "bands").mapInArrow(emit, BALLS)
    return dealt(balls, BAND_BITS, prefix_bits, half, most, kind, point, paired).groupBy("depth", "prefix", "chunk", "other")


def _band_group(rows: pa.Table, kind: np.dtype) -> tuple[int, int, int, np.ndarray]:
    """(depth, band, prefix, records) of a group."""
    depth, prefix, records = group_of(rows, kind)
    return depth, prefix >> depth, prefix & ((1 << depth) - 1), records


def suspects(nodes: DataFrame) -> DataFrame:
    """bits of nodes (bits, signature) that meet in some band and whose first 64 bits are near, and the
    bands in which they do."""

    def records_of(signs: np.ndarray, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), _NODE)
        out["key"], out["point"] = signs[:, 0].view(np.int64), points
        return out

    def ask(rows: pa.Table) -> pa.Table:
        depth, band, prefix, records = _band_group(rows, _NODE)
        keys = records["key"].view(np.uint64) if len(records) else np.zeros(0, np.uint64)
        variant, at = meetings(records["point"].astype(np.uint64), prefix, depth, BAND_BITS, BAND_RADIUS // 2)
        crowd = len(rows) > 0 and rows.column("chunk")[0].as_py() != WHOLE
        found = np.full(len(keys), crowd)  # of a variant too crowded for one task, all
        left = np.arange(0 if crowd else len(variant))
        for k in range(1, CROWDED + 1):  # each with the k-th behind it
            left = left[left + k < len(variant)]
            left = left[variant[left] == variant[left + k]]
            if not len(left):
                break
            a, b = at[left], at[left + k]
            near = np.bitwise_count(keys[a] ^ keys[b]) <= SUSPECT
            found[a[near]] = found[b[near]] = True
        else:  # variants that more share: all of them
            crowded = np.isin(variant, variant[left])
            found[at[crowded]] = True
        near = np.unique(keys[found]).view(np.int64)
        return pa.table({"bits": pa.array(near, pa.int64()), "band": pa.array(np.full(len(near), band), pa.int64())})

    nodes = nodes.withColumn("bands", F.lit((1 << BANDS) - 1))
    groups = _dealt_bands(nodes, BAND_NODES, MOST_NODES, _NODE, records_of, lambda records, band: records["point"].astype(np.uint64), paired=False)
    found = groups.applyInArrow(ask, "bits long, band long").select("bits", F.expr("shiftleft(1L, cast(band as int))").alias("bands"))
    return found.groupBy("bits").agg(F.bit_or("bands").alias("bands"))


def _near_pairs(words: np.ndarray, points: np.ndarray, variant: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of pairs that share a variant and whose signatures are at most FAR apart."""
    found = []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            apart = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
            near = apart <= FAR
            found.append((x[near], y[near], apart[near]))

    left = np.arange(len(variant))
    for k in range(1, CROWDED + 1):
        left = left[left + k < len(variant)]
        left = left[variant[left] == variant[left + k]]
        if not len(left):
            break
        keep(at[left], at[left + k])
    else:  # what shares a crowded variant is compared once, whatever the number of variants
        many = np.unique(at[np.isin(variant, variant[left])])
        for i in range(len(many) - 1):
            b = many[i + 1 :]
            b = b[np.bitwise_count(points[b] ^ points[many[i]]) <= BAND_RADIUS]
            keep(np.full(len(b), many[i]), b)
    a, b, apart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return a, b, apart


def near_links(nodes: DataFrame) -> DataFrame:
    """key, parent, apart: a forest for each group of suspects (signature, bands) that meet, of all
    links up to FAR."""

    def records_of(signs: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(signs).view(_SUSPECT).ravel()

    def point(records: np.ndarray, band: int) -> np.ndarray:
        return _bands(records["words"])[band].astype(np.uint64)

    def ask(rows: pa.Table) -> pa.Table:
        depth, band, prefix, records = _band_group(rows, _SUSPECT)
        points = point(records, band)
        variant, at = meetings(points, prefix, depth, BAND_BITS, BAND_RADIUS // 2)
        words = np.ascontiguousarray(records["words"])
        a, b, apart = _near_pairs(words, points, variant, at)
        taken = forest(a, b, apart, len(words))
        keys = words[:, 0].view(np.int64) if len(words) else np.zeros(0, np.int64)
        x, y = keys[a[taken]], keys[b[taken]]
        return pa.table({"key": np.maximum(x, y), "parent": np.minimum(x, y), "apart": apart[taken]})

    groups = _dealt_bands(nodes, SUSPECT_NODES, MOST_SUSPECTS, _SUSPECT, records_of, point, paired=True)
    return groups.applyInArrow(ask, "key long, parent long, apart long").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (key, parent) whose texts (bits, text) are as similar as SIMILAR."""
    asked = pairs.select("key").union(pairs.select("parent")).distinct()
    texts = materialize(texts.select(F.col("bits").alias("key"), F.col("text").cast("binary").alias("text")).join(asked, "key"), "asked")
    both = pairs.join(texts, "key").join(texts.select(F.col("key").alias("parent"), F.col("text").alias("other")), "parent")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for text, other in zip(b.column("text"), b.column("other"), strict=True):
                one, two = shingle_set(text.as_py() or b""), shingle_set(other.as_py() or b"")
                shared = len(np.intersect1d(one, two, assume_unique=True))
                near.append(shared >= SIMILAR * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("parent")], ["key", "parent"]).filter(pa.array(near, pa.bool_()))

    return both.select("key", "parent", "text", "other").mapInArrow(check, "key long, parent long")


def similar_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """key, parent: links between nodes (bits, signature) of similar texts (bits, text)."""
    few = materialize(suspects(nodes), "suspects")
    found = near_links(materialize(nodes.join(hinted(few, 64), "bits").select("signature", "bands"), "signatures"))
    found = materialize(found.groupBy("key", "parent").agg(F.min("apart").alias("apart")), "found")
    sure, doubtful = found.where(F.col("apart") <= SURE), found.where(F.col("apart") > SURE)
    return sure.select("key", "parent").unionByName(verified(doubtful.select("key", "parent"), texts))


def _rooted(least: DataFrame, links_of: DataFrame) -> DataFrame:
    """least (bits, least, rows) with root for each distinct bits."""
    found = components(links_of).withColumnRenamed("key", "bits")
    return materialize(least.join(found, "bits", "left").withColumn("root", F.coalesce("root", "bits")), "rooted")


def _least(prints: DataFrame, *more) -> DataFrame:
    """bits, least (the least doc_id with these bits), rows for each distinct bits."""
    return materialize(prints.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), *more), "distinct")


def components_of(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs (doc_id, text)."""
    prints = materialize(with_bits(docs.select("doc_id", "text"), words).drop("text"), "simhash")
    least = _least(prints)
    rooted = _rooted(least, links(least.select("bits"), least.count(), radius))
    # Written and counted, so that a hot root's rows can be split.
    names = hinted(materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names"), 64)
    named = hinted(materialize(rooted.join(names, "root").select("bits", "component_id"), "named"), 64)
    return prints.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of similar texts, all columns kept: that of the least doc_id
    (null comes last), and if several rows have it, the one of the least bits."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*[c if c in ("doc_id", "text") else v for c, v in names.items()])
    held = materialize(with_signature(inner), "texts")
    least = _least(held, F.min("signature").alias("signature"))
    # A node's text: that of its least row.
    texts = held.join(least.select("bits", "least"), "bits").where(F.col("doc_id").eqNullSafe(F.col("least"))).select("bits", "text").dropDuplicates(["bits"])
    rooted = _rooted(least.drop("signature"), similar_links(least.select("bits", "signature"), texts))
    kept = keep_least(held.drop("signature"), rooted)
    return kept.select([F.col(k if k in ("doc_id", "text") else v).alias(k) for k, v in names.items()])


def keep_least(held: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of held for each root; rooted: bits, least, rows, root."""
    prints = held.select("doc_id", "bits")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "bits")).alias("first")
    firsts = hinted(materialize(rooted.groupBy("root").agg(first), "firsts"), 96)  # so that a hot root's rows can be split
    wins = F.col("bits") == F.col("first.bits")
    marks = rooted.join(firsts, "root").where(~wins | (F.col("rows") > 1))
    marks = hinted(materialize(marks.select("bits", wins.alias("wins"), "least"), "marks"), 64)
    joined = held.join(marks, "bits", "left")
    marked = F.col("wins").isNotNull()
    kept = joined.where(~marked | (F.col("wins") & F.col("doc_id").eqNullSafe(F.col("least"))))
    # Rows that repeat with their doc_id: one of them stays. Else nothing is shuffled here.
    if prints.groupBy("doc_id", "bits").count().where("count > 1").limit(1).count():
        kept = kept.where(~marked).unionByName(kept.where(marked).dropDuplicates(["bits"]))
    return kept
