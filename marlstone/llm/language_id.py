"""Language ID by interpolated Kneser-Ney character models, one for each language.

A text is its runs of letters (Unicode category L), lower-cased; each run is scored between boundary
marks, so a run's log probability depends on nothing else and is kept. The models are sorted arrays
of n-gram hashes with a column for each language. The language of the lowest cross-entropy by
character wins; its score is a calibrated softmax over the languages.

The models learn from a bounded sample: about SAMPLE_CHARS characters of each language, in pieces of
at most PIECE_CHARS characters of its texts, drawn by a hash of the row's id and text and of the piece's
place. So no text is too long to be learned from, and the bound holds however often an id repeats.
Whole texts are judged.

Rejection is calibrated on texts of their own: one in CALIBRATE_ONE_IN documents, drawn by a hash, is
never learned from. How far their cross-entropies lie above their language's mean, in deviations for
their length, gives the limit that FALSE_REJECTION of them exceed; a text beyond it is rejected.
With too few of them (under LEAST_CALIBRATED) only letterless texts are. Rows that are equal in doc_id,
text and lang are learned from, or calibrate, once.

Defined results: null or letterless texts (numerals, signs and marks are no letters) get `und`, score
0 and are rejected. A null doc_id is judged, not held out, and never learned from. Repeated rows get
equal results. If no row can be learned from, every text gets `und`. Ties go to the alphabetically
first language. Empty tables give an empty result. Of the columns only doc_id, text and (for
learning) lang are read. Languages are as many as there are labels, a column of the models each; with
more than MOST_LANGUAGES, learning stops with an error before anything is fitted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import chunks, ship, worker_cache

ORDER = 5
UNKNOWN = "und"

#: Characters of each language that the sample has, about, and the longest pieces in it.
SAMPLE_CHARS = 1_500_000
PIECE_CHARS = 4_000
#: Documents that calibrate: so many of all, pieces of them for each language, about, and for all at least.
CALIBRATE_ONE_IN = 10
CALIBRATE_PIECES = 400
LEAST_CALIBRATED = 100
#: Distinct values of lang that models are fitted to.
MOST_LANGUAGES = 1_000
#: Words of the excerpts that calibrate for short texts, and the share of calibrating texts beyond the limit.
EXCERPT_WORDS = 8
FALSE_REJECTION = 0.002

CACHE_WORDS = 600_000
#: Bytes of text that are scored together.
CHUNK_BYTES = 1 << 19
#: A-Z become a-z, all other ASCII characters spaces: none of them is part of a run of letters.
_ASCII = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in range(256))
_LETTERS = regex.compile(r"\p{L}+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_START, _END = 1, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_runs(word: str) -> list[str]:
    return _LETTERS.findall(word.lower())


def _symbols(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all runs between boundary marks, and where each run starts."""
    text = "".join(f"{chr(_START)}{r}{chr(_END)}" for r in runs)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, runs), np.int64, len(runs)) + 2
    return codes, np.cumsum(sizes) - sizes


def _grams(codes: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, places, hashes, hashes without the last symbol, without the first) for n = 1, 2, ... of
    the n-grams that end at places."""
    inside = _inside(codes, starts)
    value, shorter, power = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            first = np.zeros(len(codes), np.uint64)
            first[n - 1 :] = codes[: max(0, len(codes) - n + 1)]
            shorter, value = value, value + (first + np.uint64(7)) * power
            power = power * _BASE
            at = np.flatnonzero(inside >= max(n - 1, 1))
            yield n, at, value[at], shorter[at - 1], shorter[at]


def _inside(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The place of each symbol in its run."""
    return np.arange(len(codes), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(codes))))


@dataclass
class Models:
    """For each order: sorted n-gram hashes and log2 probabilities, sorted context hashes and log2
    weights of what is left to the shorter context; a column for each language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    name: str = ""
    temperature: float = 1.0
    mean: np.ndarray | None = None
    #: Variance of a text's cross-entropy: of all texts, and by symbol.
    variance: tuple[float, float] = (0.0, 1.0)
    #: Deviations above the mean beyond which a text is rejected.
    limit: float = np.inf

    def score(self, runs: list[str]) -> np.ndarray:
        """log2 probability of each run by language."""
        codes, starts = _symbols(runs)
        logs = np.tile(self.floor, (len(codes), 1))
        for n, at, value, context, _ in _grams(codes, starts, len(self.grams)):
            keys, weights = self.contexts[n - 1]
            where, there = _find(keys, context)
            lower = logs[at]
            lower[there] += weights[where[there]]
            keys, known = self.grams[n - 1]
            where, there = _find(keys, value)
            found = known[where[there]]
            lower[there] = np.where(np.isnan(found), lower[there], found)
            logs[at] = lower
        logs[starts] = 0.0
        return np.add.reduceat(logs, starts, axis=0) if len(runs) else np.zeros((0, len(self.languages)))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return where, keys[where] == wanted


def _kneser_ney(words: list[str], counts: np.ndarray, order: int, symbols: int) -> tuple[list, list]:
    """For each order (hashes, log2 probabilities) and (context hashes, log2 weights) of a language."""
    codes, starts = _symbols(words)
    weight = np.repeat(counts.astype(np.float32), np.diff(np.append(starts, len(codes))))
    inside = _inside(codes, starts)
    levels = []
    for n, at, value, context, suffix in _grams(codes, starts, order):
        distinct, first = np.unique(value, return_index=True)
        raw = np.bincount(np.searchsorted(distinct, value), weight[at])
        opening = inside[at[first]] == n - 1  # begins with the mark, so nothing can stand before it
        levels.append((distinct, raw, opening, suffix[first], context[first]))
    grams, contexts = [], []
    shorter: dict[str, np.ndarray] = {}
    for n, (distinct, raw, opening, suffix, context) in enumerate(levels, 1):
        count = raw
        if n < order:  # how many symbols stand before it, except at the beginning of a word
            longer_suffix = levels[n][3]
            where, there = _find(distinct, longer_suffix)
            before = np.bincount(where[there], minlength=len(distinct)).astype(np.float64)
            count = np.where(opening | (before == 0), raw, before)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))
        keys, group = np.unique(context, return_inverse=True)
        total = np.bincount(group, count)
        left = discount * np.bincount(group) / total
        lower = np.full(len(distinct), 1.0 / symbols)
        if n > 1:
            where, there = _find(shorter["keys"], suffix)
            lower[there] = shorter["p"][where[there]]
        p = np.maximum(count - discount, 0) / total[group] + left[group] * lower
        shorter = {"keys": distinct, "p": p}
        grams.append((distinct, np.log2(p)))
        contexts.append((keys, np.log2(left)))
    return grams, contexts


def fit(rows: pa.Table, order: int = ORDER) -> Models:
    """rows: lang, run, n."""
    languages = sorted(pc.unique(rows.column("lang")).to_pylist())
    own = {lang: rows.filter(pc.equal(rows.column("lang"), lang)).sort_by("run") for lang in languages}
    symbols = len(set().union(*(set("".join(t.column("run").to_pylist())) for t in own.values()))) + 2
    parts = []
    for lang in languages:
        t = own.pop(lang)  # one language at a time
        parts.append(_kneser_ney(t.column("run").to_pylist(), t.column("n").to_numpy(), order, symbols))

    def joined(which: int, n: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([p[which][n][0] for p in parts]))
        values = np.full((len(keys), len(parts)), missing)
        for i, p in enumerate(parts):
            values[np.searchsorted(keys, p[which][n][0]), i] = p[which][n][1]
        return keys, values

    return Models(
        languages,
        [joined(0, n, np.nan) for n in range(order)],
        [joined(1, n, 0.0) for n in range(order)],
        np.full(len(languages), -np.log2(symbols)),
    )


def text_scores(models: Models, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """log2 probability by language, and symbols scored, of each text. Words are kept in a cache."""
    known, table = worker_cache(f"languages {models.name}", lambda: ({}, np.zeros((CACHE_WORDS + 1, len(models.languages) + 1), np.float32)))
    split = [t.translate(_ASCII).split() for t in texts]  # letter_runs does the same for other characters
    new = set().union(*split).difference(known)
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = set().union(*split)
        if len(new) > CACHE_WORDS:
            table = np.zeros((len(new) + 1, table.shape[1]), np.float32)
    if new:
        words = sorted(new)
        runs = [letter_runs(w.decode("utf-8", "replace")) for w in words]
        flat = [r for rs in runs for r in rs]
        scores = np.zeros((len(words), table.shape[1]))
        if flat:
            of = np.repeat(np.arange(len(words)), [len(rs) for rs in runs])
            for i, column in enumerate(models.score(flat).T):
                scores[:, i] = np.bincount(of, column, len(words))
            scores[:, -1] = np.bincount(of, np.fromiter(map(len, flat), np.int64, len(flat)) + 1, len(words))
        base = len(known)
        table[base : base + len(words)] = scores
        known.update(zip(words, range(base, base + len(words)), strict=True))
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    out = np.zeros((len(texts), table.shape[1]))
    some = np.flatnonzero(sizes)
    if len(some):
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        begins = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.add.reduceat(table[ids], begins, axis=0, dtype=np.float64)
    if len(known) > CACHE_WORDS:
        known.clear()
    return out[:, :-1], out[:, -1]


def entropies(models: Models, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    logs, symbols = text_scores(models, texts)
    return -logs / np.maximum(symbols, 1)[:, None], symbols


def deviations(models: Models, best: np.ndarray, entropy: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """How far texts lie above the mean of their language."""
    fixed, each = models.variance
    return (entropy - models.mean[best]) / np.sqrt(fixed + each / np.maximum(symbols, 1))


def decide(models: Models, entropy: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score, rejected); rows without symbols are to be marked by the caller."""
    best, least = entropy.argmin(axis=1), entropy.min(axis=1)
    # Entropies of a text vary less, the longer it is.
    sharp = models.temperature * np.sqrt(np.maximum(symbols, 1))
    odds = np.exp(-(entropy - least[:, None]) * sharp[:, None])
    score = 1.0 / odds.sum(axis=1)
    rejected = (symbols == 0) | (deviations(models, best, least, symbols) > models.limit)
    return best, np.where(symbols > 0, score, 0.0), rejected


def calibrate(models: Models, rows: pd.DataFrame) -> None:
    """Temperature, means, variance and limit, from labelled texts (lang, text) that the models have not
    learned from. An excerpt of each stands for short texts."""
    rows = rows[rows["lang"].isin(models.languages)]  # a language may have no letters
    short = rows.assign(text=[" ".join(t.split()[:EXCERPT_WORDS]) for t in rows["text"]])
    rows = pd.concat([rows, short])
    texts = pa.array(rows["text"].tolist(), pa.string()).cast(pa.binary())
    parts = [entropies(models, own) for _, own in chunks(texts, CHUNK_BYTES)] or [entropies(models, [])]
    entropy, symbols = (np.concatenate(x) for x in zip(*parts, strict=True))
    truth = rows["lang"].map({x: i for i, x in enumerate(models.languages)}).to_numpy()
    use = symbols > 0
    entropy, symbols, truth = entropy[use], symbols[use], truth[use]
    models.mean = np.full(len(models.languages), 0.0)
    if not len(truth):
        return
    own = entropy[np.arange(len(truth)), truth]
    pooled = np.average(own, weights=symbols)
    for i in range(len(models.languages)):
        mine = truth == i
        models.mean[i] = np.average(own[mine], weights=symbols[mine]) if mine.sum() >= 8 else pooled
    gap = entropy - own[:, None]
    losses = {}
    for t in (0.25, 0.5, 1.0, 2.0, 4.0):
        losses[t] = np.log(np.exp(np.clip(-gap * t * np.sqrt(symbols)[:, None], -50, 50)).sum(axis=1)).mean()
    models.temperature = min(losses, key=losses.get)
    if len(truth) < LEAST_CALIBRATED:
        return
    # (entropy - mean)^2 is about fixed + each / symbols; the least squares of the two shares.
    squares = (own - models.mean[truth]) ** 2 * symbols
    design = np.stack([symbols, np.ones(len(symbols))], axis=1) / np.sqrt(symbols)[:, None]
    fixed, each = np.linalg.lstsq(design, squares / np.sqrt(symbols), rcond=None)[0]
    models.variance = (float(max(fixed, 1e-4)), float(max(each, 1e-2)))
    best = entropy.argmin(axis=1)
    models.limit = float(np.quantile(deviations(models, best, entropy.min(axis=1), symbols), 1 - FALSE_REJECTION, method="higher"))


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[tuple[str, str]] = Counter()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            held.update((lang, r) for r in letter_runs(text))
    langs, runs = zip(*held, strict=True) if held else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "run", "n"])


def learn(docs: DataFrame, order: int = ORDER) -> Models | None:
    """Models of docs (doc_id, text, lang), without those held out."""
    ship(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("row")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    apart = F.pmod(F.xxhash64("row", F.lit("apart")), F.lit(CALIBRATE_ONE_IN)) == 0
    pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / PIECE_CHARS))
    chars = F.sum(F.when(~apart, F.length("text")).otherwise(0))
    different = [F.least(F.lit(1.0), F.try_divide(F.approx_count_distinct(F.when(c, F.col("row"))), F.count_if(c))).alias(n) for n, c in (("new", ~apart), ("new_apart", apart))]
    sizes = [chars.alias("chars"), F.sum(F.length("text")).alias("all"), F.sum(F.when(apart, pieces).otherwise(0)).alias("pieces")]
    found = usable.groupBy("lang").agg(*sizes, *different).limit(MOST_LANGUAGES + 1).collect()
    if not found:
        return None
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} distinct values")
    # A language that only such documents have is learned from them.
    apart = apart & ~F.col("lang").isin([r["lang"] for r in found if not r["chars"]])
    rate = F.lit(0.0)
    for r in found:  # equal rows are drawn together and count once
        sizes = r["pieces"] * (r["new_apart"] or 1.0), r["chars"] * r["new"] if r["chars"] else r["all"] * (r["new_apart"] or 1.0)
        of = F.when(apart, min(1.0, CALIBRATE_PIECES / max(1, sizes[0]))).otherwise(min(1.0, SAMPLE_CHARS / max(1, sizes[1])))
        rate = F.when(F.col("lang") == r["lang"], of).otherwise(rate)

    def drawn(place: Column) -> Column:
        return F.pmod(F.xxhash64("row", place), F.lit(1 << 30)) < F.floor(F.col("rate") * (1 << 30))

    places = F.explode(F.filter(F.sequence(F.lit(0), (pieces - 1).cast("int")), drawn)).alias("place")
    cut = F.substr(F.col("text"), F.col("place") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("text")
    sample = usable.select("*", apart.alias("apart"), rate.alias("rate")).select("doc_id", "row", "lang", "text", "apart", places)
    sample = sample.select("doc_id", "row", "place", "lang", "apart", cut).distinct()
    counted = sample.where("not apart").select("lang", "text").mapInArrow(_count_runs, "lang string, run string, n long")
    counted = counted.groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return None
    models = fit(counted, order)
    models.name = f"{counted.num_rows}:{pc.sum(counted.column('n')).as_py()}:{abs(hash(tuple(np.round(models.grams[-1][1][:50].ravel(), 6).tolist())))}"
    calibrate(models, sample.where("apart").select("doc_id", "place", "lang", "text").toPandas().sort_values(["doc_id", "place", "lang", "text"]))
    worker_cache("", lambda: None)  # the driver keeps no words
    return models


def predictions(docs: DataFrame, models: Models | None) -> DataFrame:
    """docs' rows with lang_pred, score and rejected added."""
    spark = docs.sparkSession
    ship(spark)
    if models is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(models)  # sized by the sample, not by docs
    columns = docs.columns
    place = columns.index("text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        names = np.array([*models.languages, UNKNOWN], dtype=object)
        for b in batches:
            preds, scores, outs = [], [], []
            for _, texts in chunks(b.column(place).cast(pa.binary()), CHUNK_BYTES):
                entropy, symbols = entropies(models, texts)
                best, score, rejected = decide(models, entropy, symbols)
                preds += names[np.where(symbols > 0, best, len(models.languages))].tolist()
                scores.append(score)
                outs.append(rejected)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(outs) if outs else [], pa.bool_())],
                [*columns, "lang_pred", "score", "rejected"],
            )

    return docs.mapInArrow(judge, f"{types}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs (doc_id, text, lang)."""
    models = models or learn(docs)
    judged = predictions(docs.select("doc_id", "text"), models)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*["text" if c == "text" else v for c, v in names.items()])
    kept = predictions(inner, learn(docs)).where(~F.col("rejected"))
    return kept.select([F.col("text" if k == "text" else v).alias(k) for k, v in names.items()])
