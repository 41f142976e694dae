"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (low quality) and 2 (good). Hashed text features share one vector of
weights, ordered thresholds cut the scale: P(grade >= j) = 1 / (1 + exp(threshold_j - score)). The
expected grade and the tail probability P(grade >= 2) come from the same score, and a text is
selected if the tail probability reaches a threshold.

Features: whether a word occurs, and whether a word's first letters do (lower-cased, outer
punctuation dropped); and how large a share of the words has each of a few shapes (capitals, signs
at the end, bare signs, a repetition of the word before). Whole texts are read; a word's hashes are
kept in a bounded cache.

The regression learns from at most about SAMPLE_DOCS labelled rows, chosen by a hash of their id and
text and counted before any is fetched, so the bound holds however often an id repeats; rows equal in
both are learned once. A long text counts like any other. Buckets that don't tell grades apart are found by a sum over the
written sample, so only the others' are gathered. Everything else covers all rows.

Defined results: a null or blank text has no features; it gets the score of the features' absence
and is never selected. A null doc_id is scored, not learned from. A labelled row with a null rating
is not learned from; ratings that repeat count once, at their lowest grade. Without any
usable label every grade is equally likely and nothing is selected. Repeated rows get equal results.
Empty tables give an empty result. Other columns are not read by `grade` and kept by `accepted`.
"""

from __future__ import annotations

import operator
import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import chunks, materialize, ship, worker_cache

GRADES = 3
BUCKETS_LOG2 = 18
PREFIX_CHARACTERS = 5
SELECT_AT = 0.5

SAMPLE_DOCS = 8_000
#: A bucket keeps its weight only if this many rows have it, and if their mean grade is this many
#: standard errors from the mean of all.
LEAST_DOCS = 3
LEAST_ERRORS = 4.5
RIDGE = 2e-5
STEPS = 250
RATE = 0.08

CACHE_WORDS = 250_000
#: Shapes of words, by index; the last is that of a word equal to the one before.
SHAPES = ("plain", "capitals", "signs at the end", "signs only", "digits", "repeated")
_PUNCTUATION = string.punctuation
_ORDINARY = ".,;:!?\"'()"


def _hash(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}\x1f{word}".encode()) >> (32 - BUCKETS_LOG2)


def word_features(raw: bytes) -> tuple[int, int, int]:
    """(bucket of the word, of its first letters, shape); a bucket is -1 if there is none."""
    word = raw.decode("utf-8", "replace")
    core = word.strip(_PUNCTUATION)
    if not core:
        return -1, -1, 3
    tail = word[len(word.rstrip(_PUNCTUATION)) :]
    if len(core) > 1 and core.isupper():
        shape = 1
    elif len(tail) > 1 or tail.strip(_ORDINARY):
        shape = 2
    else:
        shape = 4 if core.isdigit() else 0
    core = core.lower()
    return _hash("word", core), _hash("prefix", core[:PREFIX_CHARACTERS]) if len(core) >= PREFIX_CHARACTERS else -1, shape


def _known(words: Iterable[bytes]) -> dict[bytes, tuple[int, int, int]]:
    features = worker_cache("word features", dict)
    new = set(words).difference(features)
    if len(features) + len(new) > CACHE_WORDS:
        features.clear()
        new = words
    features.update((w, word_features(w)) for w in new)
    return features


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, shares of the shapes)."""
    words = text.split()
    shares = np.zeros(len(SHAPES))
    if not words:
        return np.zeros(0, np.int64), shares
    counts = Counter(words)
    known = _known(counts)
    table = np.array([known[w] for w in counts], np.int64)
    times = np.fromiter(counts.values(), np.int64, len(counts))
    shares += np.bincount(table[:, 2], times, len(SHAPES))
    shares[-1] = sum(map(operator.eq, words, words[1:]))
    buckets = np.unique(table[:, :2])
    return buckets[buckets >= 0], shares / len(words)


@dataclass
class CumulativeLink:
    """score = weights of the buckets that occur + shapes @ shape_weights; thresholds ascend."""

    weights: np.ndarray
    shape_weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            buckets, shares = text_features(t)
            out[i] = self.weights[buckets].sum() + np.sqrt(shares) @ self.shape_weights
        return out

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def telling(having: np.ndarray, sums: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Which buckets tell grades apart; of each, having: rows that have it, sums: of their grades."""
    errors = np.abs(sums / np.maximum(having, 1) - grades.mean()) * np.sqrt(having) / max(float(grades.std()), 1e-9)
    return (having >= LEAST_DOCS) & (errors >= LEAST_ERRORS)


def likelihood(x: np.ndarray, at: np.ndarray, of: np.ndarray, column: np.ndarray, shapes: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with the ridge, and its gradient. x holds, cut at `at`, the weights
    of the buckets, those of the shapes, the first threshold and the logs of the gaps to the next.
    Row of[i] has the bucket column[i]."""
    cuts, n = GRADES - 1, len(grades)
    gaps = np.exp(x[at[3] :])
    thresholds = x[at[2]] + np.concatenate([[0.0], np.cumsum(gaps)])
    score = np.bincount(of, x[column], n) + shapes @ x[at[1] : at[2]]
    edge = 1 / (1 + np.exp(np.clip(score[:, None] - thresholds[None, :], -60, 60)))  # P(grade < j)
    full = np.concatenate([np.zeros((n, 1)), edge, np.ones((n, 1))], axis=1)
    slope = full * (1 - full)
    rows_at = np.arange(n)
    p = np.maximum(full[rows_at, grades + 1] - full[rows_at, grades], 1e-12)
    to_score = (slope[rows_at, grades + 1] - slope[rows_at, grades]) / p / n
    to_edges = np.zeros((n, GRADES + 1))
    to_edges[rows_at, grades + 1] -= slope[rows_at, grades + 1] / p
    to_edges[rows_at, grades] += slope[rows_at, grades] / p
    to_cuts = to_edges[:, 1:-1].sum(axis=0) / n
    weights = x[: at[1]]
    gradient = np.concatenate(
        [
            np.bincount(column, to_score[of], at[1]) + RIDGE * weights,
            shapes.T @ to_score,
            [to_cuts.sum()],
            [to_cuts[j + 1 :].sum() * gaps[j] for j in range(cuts - 1)],
        ]
    )
    return float(-np.log(p).mean() + 0.5 * RIDGE * weights @ weights), gradient


def fit(of: np.ndarray, bucket: np.ndarray, shapes: np.ndarray, grades: np.ndarray, steps: int = STEPS) -> CumulativeLink:
    """Row of[i] has bucket[i]; shapes (square roots of the shares) and grades by row. Adam on all rows."""
    used, column = np.unique(bucket, return_inverse=True)
    # Thresholds are a first one and the logs of the gaps between them, so that they ascend.
    at = np.cumsum([0, len(used), len(SHAPES), 1, GRADES - 2])
    x = np.zeros(at[-1])
    x[at[2]] = -1.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        _, gradient = likelihood(x, at, of, column, shapes, grades)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BUCKETS_LOG2)
    weights[used] = x[: at[1]]
    return CumulativeLink(weights, x[at[1] : at[2]], x[at[2]] + np.concatenate([[0.0], np.cumsum(np.exp(x[at[3] :]))]))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> CumulativeLink | None:
    """A model of the ratings labels (doc_id, quality, toxic) of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    rated = labels.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"), "quality", "toxic")
    rated = rated.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    if not n:
        return None

    def share(n: int, *of) -> Column:
        """Whether a hash of `of` is among the first sample_docs of n, about."""
        return F.pmod(F.xxhash64(*of, F.lit(10)), F.lit(1 << 30)) < int(min(1.0, sample_docs / n) * (1 << 30))

    drawn = F.broadcast(rated.where(share(n, "doc_id")))  # about sample_docs rows of two numbers
    # Documents that share an id are drawn among one another, by their texts.
    printed = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    prints = materialize(printed.join(drawn, "doc_id").select("doc_id", "print", "grade").distinct(), "drawn")
    chosen = F.broadcast(prints.where(share(max(1, prints.count()), "doc_id", "print")))  # about sample_docs, too

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # no more than are chosen
        for b in batches:
            keys = list(zip(b.column("doc_id").to_pylist(), b.column("print").to_pylist(), strict=True))
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            b = b.take(pa.array(new, pa.int64()))
            found = [text_features(x.as_py() or b"") for x in b.column("text")]
            buckets, shares = (pa.array([f[i] for f in found], t) for i, t in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.float64()))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("print"), buckets, shares, b.column("grade")], ["doc_id", "print", "buckets", "shares", "grade"])

    texts = printed.join(chosen, ["doc_id", "print"])
    texts = texts.select("doc_id", "print", F.col("text").cast("binary").alias("text"), F.col("grade").cast("int").alias("grade"))
    made = texts.mapInArrow(features, "doc_id long, print long, buckets array<long>, shares array<double>, grade int")
    sample = materialize(made.dropDuplicates(["doc_id", "print"]).drop("print"), "features")
    rows = sample.select("grade").toArrow()
    if not rows.num_rows:
        return None
    grades = rows.column("grade").to_numpy().astype(np.int64)
    counts = sample.select(F.explode("buckets").alias("bucket"), "grade").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("sum")).toArrow()
    having, sums = np.zeros(1 << BUCKETS_LOG2), np.zeros(1 << BUCKETS_LOG2)
    having[counts.column("bucket").to_numpy()], sums[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy(), counts.column("sum").to_numpy()
    known = spark.sparkContext.broadcast(telling(having, sums, grades))  # a flag for each bucket

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("buckets")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))
            flags = known.value[flat]
            kept = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(flags))[ends], pa.int32()), pa.array(flat[flags], pa.int64()))
            yield pa.RecordBatch.from_arrays([kept if c == "buckets" else b.column(c) for c in b.schema.names], b.schema.names)

    found = sample.mapInArrow(keep, sample.schema).toArrow().combine_chunks()
    found = found.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    lists = found.column("buckets").combine_chunks()
    of = np.repeat(np.arange(found.num_rows), pc.list_value_length(lists).to_numpy())
    shares = found.column("shares").combine_chunks().flatten().to_numpy().reshape(-1, len(SHAPES))
    return fit(of, lists.flatten().to_numpy(), np.sqrt(shares), found.column("grade").to_numpy().astype(np.int64))


def graded(docs: DataFrame, model: CumulativeLink | None) -> DataFrame:
    """docs' rows with score, expected_grade, p_acceptable (grade >= 1), p_good (grade >= 2), selected."""
    spark = docs.sparkSession
    ship(spark)
    model = model or CumulativeLink(np.zeros(1 << BUCKETS_LOG2), np.zeros(len(SHAPES)), np.log([0.5, 2.0]))
    shared = spark.sparkContext.broadcast(model)  # 2 MB, whatever docs' size
    columns = docs.columns
    place = columns.index("text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    extra = ["score", "expected_grade", "p_acceptable", "p_good", "selected"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for _, run in chunks(b.column(place).cast(pa.binary()), 4 << 20) for t in run]
            score = shared.value.scores(texts)
            tails = shared.value.tails(score)
            blank = np.array([not t.strip() for t in texts], bool)
            out = [score, tails.sum(axis=1), tails[:, 0], tails[:, -1], (tails[:, -1] >= SELECT_AT) & ~blank]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out)], [*columns, *extra])

    return docs.mapInArrow(judge, f"{types}, score double, expected_grade double, p_acceptable double, p_good double, selected boolean")


def grade(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, score, expected_grade, p_acceptable, p_good, selected for every row of docs."""
    return graded(docs.select("doc_id", "text"), learn(docs, labels, sample_docs)).drop("text")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The selected rows of docs, with all their columns."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*["text" if c == "text" else v for c, v in names.items()])
    kept = graded(inner, learn(docs, labels)).where("selected")
    return kept.select([F.col("text" if k == "text" else v).alias(k) for k, v in names.items()])
