"""The operators on documents, held against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import bestfit_packing as packing
from marlstone.llm import components, exact_dedup, language_id, sentencepiece_codec, simhash_neardup, suffix_tree_lm
from marlstone.llm import quality_classifier as quality
from marlstone.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits long, rejected string, place int, length string"
WORD_BPE, PIECE_BPE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def make(spark, texts, langs=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, (langs or {}).get(i, "en"), "s", len(t or ""), 1, "x", 2, "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    near = [prose[0] + " end", prose[0].upper(), prose[1] + "\n", " " + prose[1]]
    long = " ".join(rng.choice(words) for _ in range(9000))
    texts = [None, "", " \t\n", "one", "two words", "a b c d", "é ß 日本 😀", "x" * 5000, long, long, *prose, *near]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "nameless text here"), (7, "x" * 5000), (3, "one"), (3, "one")]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, odd_texts()).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


# Exact dedup -------------------------------------------------------------------------------------


def bare(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def test_exact_groups(odd):
    groups = defaultdict(list)
    for i, t in odd_texts():
        groups[bare(t)].append((-len(t or ""), i is None, i or 0))
    want = Counter()
    for key, rows in groups.items():
        best = min(rows)
        for r in rows:
            want[None if r[1] else r[2], None if best[1] else best[2], len(rows), hashlib.sha256(key.encode()).hexdigest()] += 1
    got = exact_dedup.groups(odd, owners_log2=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_keeps_columns(odd, empty):
    kept = exact_dedup.dedup(odd)
    assert kept.dtypes == odd.dtypes
    texts = [bare(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({bare(t) for _, t in odd_texts()})
    assert exact_dedup.dedup(empty).count() == exact_dedup.groups(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_codes(n):
    rng = np.random.default_rng(n)
    low, width = 5 << 61, 1 << 61
    hashes = np.unique(rng.integers(low, low + width, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
    k, unary, bits = exact_dedup.encode(hashes, low, width)
    assert (exact_dedup.decode(len(hashes), low, k, unary, bits) == hashes).all()
    if n == 1000:
        assert len(unary) + len(bits) < 8 * n


# SimHash -----------------------------------------------------------------------------------------


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [words] if len(words) < 4 else [words[i : i + 4] for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar_components(texts):
    """The least place in the component of each text, linked from a similarity of 0.8 on."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and len(a & b) >= 0.8 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_simhash_components(odd, empty):
    rows = odd_texts()
    prints = [simhash(t) for _, t in rows]
    roots = plain_components(prints, 4)
    least = defaultdict(list)
    for r, (i, _) in zip(roots, rows, strict=True):
        least[r] += [] if i is None else [i]
    want = Counter((i, f"{p:016x}", min(least[r], default=None)) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert Counter(map(tuple, simhash_neardup.components_of(odd).collect())) == want
    kept = simhash_neardup.dedup(odd)
    assert kept.dtypes == odd.dtypes
    assert kept.count() == len(set(similar_components([t for _, t in rows])))
    assert simhash_neardup.components_of(empty).count() == simhash_neardup.dedup(empty).count() == 0


@pytest.mark.parametrize(("at_once", "most"), [(200, 10**9), (10**9, 10**9), (10**9, 30)])
def test_balls_lose_no_link(spark, at_once, most):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for s in seeds for _ in range(12)} | {0, 2**64 - 1}
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "bits long")
    found = dict(components.components(simhash_neardup.links(df, len(prints), 4, at_once, most)).collect())
    got, want = defaultdict(set), defaultdict(set)
    for p, s, r in zip(prints, signed, plain_components(prints, 4), strict=True):
        got[found.get(s, s)].add(p)
        want[r].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("most", [8, 10**6])
def test_crowded_bands_are_divided(spark, monkeypatch, most):
    """Copies of one text with a few other words: linked like any, however many a prefix may have."""
    monkeypatch.setattr(simhash_neardup, "MOST_NODES", most)
    monkeypatch.setattr(simhash_neardup, "MOST_SUSPECTS", most)
    rng = random.Random(30)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    base = rng.choices(words, k=150)
    texts = [" ".join(w if rng.random() > 0.006 else rng.choice(words) for w in base) for _ in range(80)]
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(80)]
    kept = {r.doc_id for r in simhash_neardup.dedup(make(spark, enumerate(texts))).collect()}
    assert kept == set(similar_components(texts))


@pytest.mark.parametrize("most", [16, 10**6])
def test_pairs_of_one_crowded_variant(spark, monkeypatch, most):
    """100 pairs that meet in a single variant of a single band: each is linked, whatever the limit."""
    monkeypatch.setattr(simhash_neardup, "MOST_NODES", most)
    monkeypatch.setattr(simhash_neardup, "MOST_SUSPECTS", most)
    rng = np.random.default_rng(31)
    one = rng.integers(0, 2**63, (100, 16), np.uint64)
    one[:, 0] &= ~np.uint64(2**32 - 1)  # the first band of all is zero
    two = one.copy()
    for row in two:
        for bit in rng.choice(np.arange(32, 1024), 100, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    two[:, 0] = one[:, 0] ^ np.uint64(2**40)
    pairs = {frozenset((int(a), int(b))) for a, b in zip(one[:, 0].view(np.int64), two[:, 0].view(np.int64), strict=True)}
    signs = [x.tobytes() for x in np.concatenate([one, two])]
    found = simhash_neardup.near_links(spark.createDataFrame([(x, 1) for x in signs], "signature binary, bands long")).collect()
    assert {frozenset((r.key, r.parent)) for r in found} == pairs
    nodes = spark.createDataFrame([(int.from_bytes(x[:8], "little", signed=True), x) for x in signs], "bits long, signature binary")
    suspected = {r.bits for r in simhash_neardup.suspects(nodes).collect() if r.bands & 1}
    assert suspected == {k for p in pairs for k in p}


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 200)] + [(500, 300), (500, 400), (600, 400)], "key long, parent long")
    found = dict(components.components(links).collect())
    assert found == {i: 0 for i in range(1, 200)} | {400: 300, 500: 300, 600: 300}


# Packing -----------------------------------------------------------------------------------------


def test_packing(odd, empty):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, t in odd_texts():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = packing.pack_documents(odd, WORD_BPE).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 2048) + 1
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_words_encode_like_whole_texts():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    encoder = packing.WordEncoder(tokenizer.to_str())
    texts = ["it's we'LL o'ree, x.", "a<|endoftext|>b <|ENDOFTEXT|>", "Σίσυφος ΣΣ é é", "\x00 \x00a", "ab\x1cde\x1ff", "A.B,, 12,5. don't.", "　x y"]
    texts += ["", " lead and trail \n", "\x0b\x0c", None]
    ids, ends = encoder.encode(pa.array(texts))
    for text, first, last in zip(texts, [0, *ends], ends, strict=False):
        assert ids[first:last].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_equal_pieces_are_spread(spark):
    cut = spark.range(600).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "700L length", "1L ids_crc32")
    sizes = Counter(r.sequence_id >> 40 for r in packing.pack(cut, per_bucket=100).collect())
    assert len(sizes) == 6
    assert max(sizes.values()) < 2 * 100


def test_bins_close_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 closes, the fuller one
    assert bins.place(4) == (0, 6)
    assert bins.place(2) == (2, 8)


# Language ID -------------------------------------------------------------------------------------


def test_languages(spark, empty):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["ó", "ción", "lla", "ñe"]}
    rows, langs = [], {}
    for i in range(240):
        lang = rng.choice(sorted(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(30)) + "."))
        langs[i] = lang
    more = [(1000, None), (1001, "12 !? 34"), (1002, ""), (None, rows[0][1]), (5, rows[5][1])]
    docs = make(spark, rows + more, langs | {None: None, 1000: None})
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) + len(more)
    held = [r for r in got if r.held_out and r.doc_id in langs]
    assert len(held) > 30
    assert all(r.lang_pred == langs[r.doc_id] and 0 <= r.score <= 1 for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    kept = language_id.accepted(docs)
    assert kept.dtypes == docs.dtypes
    assert kept.count() == len(rows) + 2
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(make(spark, [(1, "no labels")], {1: None})).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    import pandas as pd

    rows = pd.DataFrame([("x", w, n) for w, n in [("ab", 3), ("abc", 1), ("ca", 2), ("bab", 1)]], columns=["lang", "run", "n"])
    models = language_id.fit(pa.Table.from_pandas(rows), 3)
    letters = "abc"
    total = sum(2.0 ** models.score([a + b + c + d])[0, 0] for a in letters for b in ["", *letters] for c in ([""] if b == "" else ["", *letters]) for d in ([""] if c == "" else ["", *letters]))
    assert 0.5 < total <= 1.0 + 1e-9


def plain_kneser_ney(words, order, symbols):
    """log2 probability of a run by an interpolated model over dictionaries of counts."""
    grams = [Counter() for _ in range(order + 1)]
    for w, c in words.items():
        marked = f"\x01{w}\x02"
        for i in range(1, len(marked)):
            for n in range(1, min(order, i + 1) + 1):
                grams[n][marked[i - n + 1 : i + 1]] += c
    counts = [None]
    for n in range(1, order + 1):
        before = Counter(g[1:] for g in grams[n + 1]) if n < order else {}
        counts.append({g: c if g[0] == "\x01" or not before.get(g) else before[g] for g, c in grams[n].items()})
    discounts = [None]
    for c in counts[1:]:
        ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
        discounts.append(min(0.95, max(0.1, ones / max(1, ones + 2 * twos))))

    def probability(context, x):
        n = len(context) + 1
        below = 1 / symbols if n == 1 else probability(context[1:], x)
        own = [c for g, c in counts[n].items() if g[:-1] == context]
        if not own:
            return below
        d = discounts[n]
        return max(counts[n].get(context + x, 0) - d, 0) / sum(own) + d * len(own) / sum(own) * below

    def score(run):
        marked = f"\x01{run}\x02"
        return sum(math.log2(probability(marked[max(0, i - order + 1) : i], marked[i])) for i in range(1, len(marked)))

    return score


def test_kneser_ney_like_plain_counts():
    import pandas as pd

    rng = random.Random(12)
    both = {lang: Counter("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(80)) for lang, letters in (("x", "aabbc"), ("y", "abcdd"))}
    rows = pd.DataFrame([(lang, w, n) for lang, c in both.items() for w, n in c.items()], columns=["lang", "run", "n"])
    models = language_id.fit(pa.Table.from_pandas(rows), 4)
    runs = [*list(both["x"])[:20], *list(both["y"])[:20], "zzz", "a", "ab" * 30]
    got = models.score(runs)
    for i, lang in enumerate(models.languages):
        plain = plain_kneser_ney(both[lang], 4, len(set("".join(rows["run"]))) + 2)
        assert np.allclose(got[:, i], [plain(r) for r in runs])


def test_long_texts_are_learned_and_numerals_are_no_letters(spark):
    rng = random.Random(15)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"]}
    rows, langs = [], {}
    for i in range(120):
        lang = "bb" if i % 6 == 0 else "aa"  # all texts of bb are long
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(6000 if lang == "bb" else 20))))
        langs[i] = lang
    odd = [(500, "½ ² ① ٣ _ 12"), (501, "ka½to"), (502, "ka to mi " * 40_000)]
    got = {r.doc_id: r for r in language_id.identify(make(spark, rows + odd, langs | dict.fromkeys((500, 501, 502)))).collect()}
    assert all(got[i].lang_pred == langs[i] for i in langs)
    assert (got[500].lang_pred, got[500].score, got[500].rejected) == ("und", 0.0, True)
    assert got[501].lang_pred == got[502].lang_pred == "aa"


def test_rejection_catches_other_languages(spark):
    rng = random.Random(16)
    rows, langs = [], {}
    for i in range(900):
        letters = "aeiounst" if i % 3 else "aeiokmrl"
        rows.append((i, " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(rng.randint(5, 40)))))
        langs[i] = "x" if i % 3 else "y"
    other = [(5000 + i, " ".join("".join(rng.choices("pqwvzghj", k=5)) for _ in range(30))) for i in range(100)]
    got = language_id.identify(make(spark, rows + other, langs | {i: None for i, _ in other})).collect()
    assert sum(r.rejected for r in got if r.doc_id < 5000) <= 9
    assert sum(r.rejected for r in got if r.doc_id >= 5000) >= 95


def test_languages_of_repeated_ids(spark, monkeypatch):
    """30,000 rows of one doc_id don't all come to the driver, whether their texts are equal or not."""
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 20_000)
    monkeypatch.setattr(language_id, "CALIBRATE_PIECES", 50)
    taken = []
    calibrate = language_id.calibrate
    monkeypatch.setattr(language_id, "calibrate", lambda models, rows: (taken.append(len(rows)), calibrate(models, rows))[1])
    for changing in (True, False):
        text = F.concat(F.lit("some words "), F.translate((F.col("id") if changing else F.lit(7)).cast("string"), "0123456789", "abcdefghij"))
        hot = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), text.alias("text"), F.lit("x").alias("lang"))
        others = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit("anderes wort").alias("text"), F.lit("y").alias("lang"))
        models = language_id.learn(hot.unionByName(others))
        assert models.languages == ["x", "y"]
        assert taken.pop() <= 200
    many = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"))
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 50)
    with pytest.raises(ValueError, match="more than 50"):
        language_id.learn(many)


# Quality -----------------------------------------------------------------------------------------


def test_quality_of_repeated_ids(spark, monkeypatch):
    """30,000 rows of one doc_id, of equal texts or not: the sample keeps to its bound."""
    fitted = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda of, column, shapes, grades: (fitted.append(len(grades)), fit(of, column, shapes, grades))[1])
    others = spark.range(1, 150).select(F.col("id").alias("doc_id"), F.concat(F.lit("fine words "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(150).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    for changing in (True, False):
        text = F.concat(F.lit("zzbad "), (F.col("id") if changing else F.lit(7)).cast("string"))
        hot = spark.range(30_000).select(F.lit(0).cast("long").alias("doc_id"), text.alias("text"))
        quality.learn(hot.unionByName(others), labels, sample_docs=1000)
        n = fitted.pop()
        assert 850 <= n <= 1150 if changing else n == 150


def test_quality(spark, empty):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    rows, grades = [], {}
    for i in range(900):
        grade = rng.choice([0, 1, 2, 2])
        text = [rng.choice(words) for _ in range(40)]
        if grade == 0:
            text[7] = rng.choice(["zzbad", "yyworse"])
        elif grade == 1:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        grades[i] = grade
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, g in grades.items() if i % 3] + [(2, None, 0), (4, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make(spark, rows + [(2000, None), (2001, " "), (None, rows[0][1])])
    got = quality.grade(docs, labels).collect()
    assert len(got) == len(rows) + 3
    unseen = [r for r in got if r.doc_id in grades and r.doc_id % 3 == 0]
    assert sum(r.selected == (grades[r.doc_id] == 2) for r in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.expected_grade <= 2 and r.p_good <= r.p_acceptable for r in got)
    assert not any(r.selected for r in got if r.doc_id in (2000, 2001))
    assert quality.accepted(docs, labels).dtypes == docs.dtypes
    assert quality.grade(empty, labels).count() == 0
    assert not any(r.selected for r in quality.grade(docs, labels.limit(0)).collect())


def test_likelihood_of_cumulative_links():
    """Against the plain sum over rows, and against differences of itself."""
    rng = np.random.default_rng(9)
    of, column = np.repeat(np.arange(12), 3), rng.integers(0, 5, 36)
    shapes, grades = rng.random((12, len(quality.SHAPES))), rng.integers(0, 3, 12)
    at = np.cumsum([0, 5, len(quality.SHAPES), 1, 1])
    x = rng.normal(0, 0.7, at[-1])

    def plain(x):
        cuts = [x[at[2]], x[at[2]] + math.exp(x[at[3]])]
        total = 0.0
        for i, g in enumerate(grades):
            score = sum(x[c] for r, c in zip(of, column, strict=True) if r == i) + sum(a * b for a, b in zip(shapes[i], x[5 : at[2]], strict=True))
            reach = [1.0, *(1 / (1 + math.exp(c - score)) for c in cuts), 0.0]
            total -= math.log(reach[g] - reach[g + 1])
        return total / len(grades) + quality.RIDGE / 2 * sum(w * w for w in x[:5])

    value, gradient = quality.likelihood(x, at, of, column, shapes, grades)
    assert math.isclose(value, plain(x), rel_tol=1e-9)
    for i in range(len(x)):
        step = np.zeros(len(x))
        step[i] = 1e-5
        assert math.isclose(gradient[i], (plain(x + step) - plain(x - step)) / 2e-5, rel_tol=1e-4, abs_tol=1e-8)


def test_quality_of_long_and_repeated_rows(spark):
    rng = random.Random(18)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(100)]
    rows = [(i, " ".join([*rng.choices(words, k=9000 if i % 4 == 0 else 30), "zzbad" if i % 2 else "fine"])) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows if i < 160], "doc_id long, quality int, toxic int")
    got = quality.grade(make(spark, rows + rows[:3]), labels).collect()
    assert len(got) == 203
    assert all(r.selected == (r.doc_id % 2 == 0) for r in got)
    assert len({(r.doc_id, r.score) for r in got}) == 200
    # The score is the plain sum over the text's buckets and shapes.
    model = quality.learn(make(spark, rows), labels)
    text = rows[4][1].encode()
    buckets, shares = set(), [0.0] * len(quality.SHAPES)
    split = text.split()
    for w, last in zip(split, [None, *split], strict=False):
        a, b, shape = quality.word_features(w)
        buckets |= {a, b} - {-1}
        shares[shape] += 1
        shares[-1] += w == last
    plain = sum(model.weights[b] for b in buckets) + sum(math.sqrt(n / len(split)) * w for n, w in zip(shares, model.shape_weights, strict=True))
    assert math.isclose(model.scores([text])[0], plain)


# SentencePiece -----------------------------------------------------------------------------------


def test_pieces_like_the_library(spark, odd, empty):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as protobuf

    vocabulary = sentencepiece_codec.vocabulary(PIECE_BPE)
    model = protobuf.ModelProto()
    with open(PIECE_BPE, "rb") as f:
        model.ParseFromString(f.read())
    for piece, score in zip(model.pieces, sentencepiece_codec.log_scores(model), strict=True):
        piece.score = score
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = sentencepiece_codec.Codec(vocabulary)
    texts = [t or "" for _, t in odd_texts()] + ["a  b", " a", "a ", "\n x\n\n  y\tz", "  ", "日本語\x00", "w" * 40]
    for t in texts:
        ids = np.frombuffer(codec.encode(t.encode()), "<i4").tolist()
        other = library.encode(t)
        # Equal but for ties: the same total score, and the same text.
        assert math.isclose(sum(vocabulary.scores[i] for i in ids if not vocabulary.is_byte[i]), sum(vocabulary.scores[i] for i in other if not vocabulary.is_byte[i]), rel_tol=1e-5, abs_tol=1e-5)
        assert codec.decode(ids) == library.decode(ids) == t
    got = sentencepiece_codec.encode_and_decode(odd, vocabulary)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got.collect())
    assert got.count() == len(odd_texts())
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, vocabulary), vocabulary)
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter((i, t or "") for i, t in odd_texts())
    assert sentencepiece_codec.encode(empty, vocabulary).count() == 0


def test_parts_run_together():
    """Parts that run through the Viterbi together have the pieces that each has alone."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.vocabulary(PIECE_BPE))
    rng = random.Random(11)
    alphabet = "abcdeéß日本😀\t\x00▁ .,Ω"
    texts = [" ".join("".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(200)).encode() for _ in range(5)]
    words = sorted({w for t in texts for w in t.split(b" ") if w})
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(sentencepiece_codec.MARK + w)
    for parts in by_length.values():
        assert codec.together(parts) == [codec.best(p) for p in parts]
    codec.learn(texts)
    assert set(words) <= set(codec.marked)


def test_any_ids_decode(spark):
    vocabulary = sentencepiece_codec.vocabulary(PIECE_BPE)
    ids = np.frombuffer(sentencepiece_codec.Codec(vocabulary).encode(b"a b"), "<i4").tolist()
    coded = spark.createDataFrame([(1, None), (2, []), (3, [*ids, None, -1, 10**9, *ids])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in sentencepiece_codec.decode(coded, vocabulary).collect()}
    assert got == {1: None, 2: "", 3: "a b\ufffd\ufffd\ufffd a b"}


def test_double_array():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b\xff": 4, b"\x00": 5}
    trie = sentencepiece_codec.DoubleArray.build(keys)

    def look(key):
        node = 0
        for b in key:
            child = trie.base[node] + b
            if trie.check[child] != node:
                return None
            node = child
        return int(trie.value[node])

    assert {k: look(k) for k in keys} == keys
    assert look(b"b") == -1
    assert look(b"c") is None


# LM scoring --------------------------------------------------------------------------------------


@pytest.mark.parametrize("common", [5, 10**6])
def test_lm_base_scores(odd, empty, monkeypatch, common):
    monkeypatch.setattr(suffix_tree_lm, "COMMON_WORDS", common)
    rows = [(i, (t or "").encode().lower().split()) for i, t in odd_texts()]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    counts, texts = Counter(), 0
    for i, words in rows:
        if not held[i]:
            counts.update(words)
            texts += 1
    n, distinct = sum(counts.values()) + texts, len(counts) + 1
    want = defaultdict(list)
    for i, words in rows:
        each = [math.log10((c + 0.5) / (n + 0.5 * (distinct + 1))) for c in [*(counts[w] for w in words), texts]]
        want[i].append((sum(each), len(words) + 1, 1 + sum(w in counts for w in words)))
    got = suffix_tree_lm.score(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        base, tokens, known = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], tokens, known, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert -math.inf < r.score < 0
    assert suffix_tree_lm.score(empty).count() == 0


def test_suffix_tree_learns_contexts(spark):
    rng = random.Random(2)
    pairs = {"a": "b c", "d": "e f", "g": "h i"}
    rows = [(i, " ".join(f"{k} {pairs[k]}" for k in rng.choices(sorted(pairs), k=30))) for i in range(300)]
    got = suffix_tree_lm.score(make(spark, rows)).where("held_out").collect()
    assert got
    assert all(r.score > 0.6 * r.base_score for r in got)
    states = suffix_tree_lm._smooth(np.array([5.0, 0, 1]), np.array([0.2, 0.5, 0.3]))[0]
    assert math.isclose(states.sum(), 1.0)


def plain_tree(rows, held, v, depth):
    """log10 of each text by a suffix tree of dictionaries; v: the words that are symbols and their counts."""
    lm = suffix_tree_lm
    frequent = min(lm.FREQUENT, v.common)

    def reduced(s):
        return s if s < frequent or s >= v.end else frequent + (s * 2654435761 >> 15) % lm.GROUPS

    def symbols(text):
        return [*(v.index.get(w, v.common + zlib.crc32(w) % lm.CLASSES) for w in (text or "").lower().encode().split()), v.end]

    def histories(text):
        s = symbols(text)
        return [(tuple(([v.start] * depth + s)[i + depth - 1 : (i - 1 if i else None) : -1]), x) for i, x in enumerate(s)]

    learnt = [t for i, t in rows if not held(i)]
    root, words = defaultdict(lambda: 0.5), Counter(w for t in learnt for w in (t or "").lower().encode().split())
    counts, small, twos = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for t in learnt:
        for h, x in histories(t):
            root[x] += 1
            small[h[0]][reduced(x)] += 1
            twos[h[:2]][reduced(x)] += 1
            for d in range(1, depth + 1):
                counts[h[:d]][x] += 1
    n = sum(words.values()) + len(learnt)
    total = n + 0.5 * (v.end + 1)
    whole = defaultdict(float)
    for s in range(v.end + 1):
        whole[reduced(s)] += root[s] / total

    def smoothed(c, parent):
        size = sum(c.values())
        p = {x: (max(c[x] - 0.5, 0) + 0.5 * len(c) * q) / size for x, q in parent.items()}
        return p if size >= 2 and sum(k * math.log(p[x] / parent[x]) for x, k in c.items()) > 0.5 * len(c) * math.log(size) else parent

    first = {c: smoothed(small[c], whole) for c in list(small) if c < frequent or c == v.start}
    held_pairs = [h for h, c in twos.items() if h[0] < frequent and (h[1] < frequent or h[1] == v.start) and sum(c.values()) >= max(2, lm.HOT_SHARE * n)]
    second = {h: smoothed(twos[h], first[h[0]]) for h in held_pairs}

    def probability(h, x, d):
        least = 99 if h[0] == v.start else 1 if h[0] >= frequent else 3 if h[:2] in second else 2
        if d < least:
            state = second.get(h[:2], first.get(h[0], whole))
            return root[x] / total * state[reduced(x)] / whole[reduced(x)]
        above, c = probability(h, x, d - 1), counts[h[:d]]
        size = sum(c.values())
        if size < 2:
            return above
        ups = {y: probability(h, y, d - 1) for y in c}
        p = {y: (max(c[y] - 0.5, 0) + 0.5 * len(c) * q) / size for y, q in (ups | {x: above}).items()}
        gain = sum(k * math.log(p[y] / ups[y]) for y, k in c.items())
        return p[x] if gain > 0.5 * len(c) * math.log(size) else above

    def share(w):
        c = zlib.crc32(w) % lm.CLASSES
        own = [k for u, k in words.items() if u not in v.index and zlib.crc32(u) % lm.CLASSES == c]
        return (words[w] + 0.5) / (sum(own) + 0.5 * (len(own) + 1))

    out = []
    for i, t in rows:
        rare = [w for w in (t or "").lower().encode().split() if w not in v.index]
        out.append((i, sum(math.log10(probability(h, x, depth)) for h, x in histories(t)) + sum(math.log10(share(w)) for w in rare)))
    return out


@pytest.mark.parametrize(("frequent", "share", "common", "owner"), [(1023, 2.0, 10**6, 10**6), (3, 0.01, 10**6, 200), (4, 1e-9, 10, 50), (0, 0.5, 6, 10**6)])
def test_suffix_tree_scores(spark, monkeypatch, frequent, share, common, owner):
    """Scores are those of a plain tree, whatever is in the head and however subtrees are dealt out."""
    monkeypatch.setattr(suffix_tree_lm, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_tree_lm, "GROUPS", 2)
    monkeypatch.setattr(suffix_tree_lm, "CLASSES", 4)
    monkeypatch.setattr(suffix_tree_lm, "HOT_SHARE", share)
    monkeypatch.setattr(suffix_tree_lm, "COMMON_WORDS", common)
    monkeypatch.setattr(suffix_tree_lm, "SENT_AT_ONCE", 97)
    monkeypatch.setattr(suffix_tree_lm, "MANY_COPIES", 3 if owner < 10**6 else 100)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["p m q", "r m s", "t p", "q", "R m s T"]) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(i, " ".join(rng.choices("uvwxyz", k=20))) for i in range(40, 60)] + [(60, None), (61, ""), (62, rows[3][1] + " rare"), (63, rows[3][1]), (None, "p m q")]
    rows += [(70 + i, rows[5][1]) for i in range(9)]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    docs = make(spark, rows).repartition(3)
    counts = suffix_tree_lm.count_words(docs)
    v = suffix_tree_lm.vocabulary(counts, sum(not held(i) for i, _ in rows))
    assert bool(v.class_tokens.sum()) == (common < 100)
    want = dict(plain_tree(rows, held, v, 4))
    got = suffix_tree_lm.score(docs, 4, owner).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-5, abs_tol=1e-6)


@pytest.mark.parametrize("common", [10**6, 40])
def test_head_tells_all_symbols_apart(spark, monkeypatch, common):
    """Behind a hot context every symbol, frequent or not, has a probability of its own."""
    monkeypatch.setattr(suffix_tree_lm, "CLASSES", 16)
    monkeypatch.setattr(suffix_tree_lm, "COMMON_WORDS", common)
    rng = random.Random(6)
    after = {"the": range(0, 300, 9), "of": range(1, 300, 11), "to": range(2, 300, 7)}
    rows = [(i, " ".join(f"{w} w{rng.choice(after[w])}" for w in rng.choices([*after], k=rng.randint(5, 40)))) for i in range(80)]
    rows += [(80 + i, " ".join(f"of the w{rng.choice((i, 250 + i))} end" for _ in range(20))) for i in range(12)]

    def held(i):
        return zlib.crc32(str(i).encode()) % 5 == 1

    docs = make(spark, rows).repartition(3)
    v = suffix_tree_lm.vocabulary(suffix_tree_lm.count_words(docs), sum(not held(i) for i, _ in rows))
    assert bool(v.class_tokens.sum()) == (common < 100)
    with monkeypatch.context() as m:  # the plain tree knows each symbol by itself
        m.setattr(suffix_tree_lm, "FREQUENT", 10**6)
        m.setattr(suffix_tree_lm, "GROUPS", 1 << 20)
        want = dict(plain_tree(rows, held, v, 3))
    monkeypatch.setattr(suffix_tree_lm, "FREQUENT", 3)
    for share in (1e-3, 0.1):
        monkeypatch.setattr(suffix_tree_lm, "HOT_SHARE", share)
        monkeypatch.setattr(suffix_tree_lm, "COUNTED_AT_ONCE", 500, raising=False)
        monkeypatch.setattr(suffix_tree_lm, "PIECE", 60, raising=False)
        for r in suffix_tree_lm.score(docs, 3, 300).collect():
            assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-5, abs_tol=1e-6)


def test_weights_of_any_size():
    """Copies are counted whole, also beyond what three bytes hold."""
    columns = [np.array([1, 2**24 - 1, 0]), np.array([5, 6, 7])]
    for weight in ([1, 0, 2**24 - 1], [2**24, 3, 2**40 + 2**24 + 9]):
        got, above = suffix_tree_lm._unpack(suffix_tree_lm._pack(columns, np.array(weight)), 3, 3)
        assert (got[:2] == columns).all()
        assert (got[2] + (0 if above is None else above)).tolist() == weight


def test_contexts_stay_as_texts_are_added(spark):
    """A text that occurs twice is told apart, however much else is learned from."""
    rng = random.Random(7)
    twice = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    for more in (200, 2000):
        rows = [(i, twice) for i in (1000000, 1000001)] + [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(60))) for i in range(more)]
        got = {r.doc_id: r.score / r.base_score for r in suffix_tree_lm.score(make(spark, rows)).collect()}
        assert got[1000000] < 0.3 < np.median(list(got.values()))


def test_suffix_tree_memory_of_workers(spark, monkeypatch):
    """A task holds little beside its batch, however large that is, and no Python workers run beside the operator's."""
    import tracemalloc
    from types import SimpleNamespace

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30_000)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(1000)]
    batch = pa.record_batch({"doc_id": range(1000), "held_out": [False] * 1000, "place": range(1000), "text": texts})
    counted = suffix_tree_lm.count_words(make(spark, [(0, "a b")]))
    v = suffix_tree_lm.vocabulary(counted, 1)
    task = suffix_tree_lm.coded(SimpleNamespace(mapInArrow=lambda f, schema: f), SimpleNamespace(value=v))
    rows, before = 0, pa.total_allocated_bytes()
    tracemalloc.start()
    for made in task(iter([batch])):
        rows += made.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    del made
    assert rows == 1000
    assert peak < 40 << 20
    assert pa.total_allocated_bytes() - before < 1 << 20
    with monkeypatch.context() as m:
        m.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("rows through Python workers"))
        made = suffix_tree_lm.score(spark.range(60).selectExpr("id as doc_id", "concat('a b ', id) as text"))
    assert made.count() == 60


def test_suffix_tree_symbols_as_bytes():
    """Symbols come back as they were, also from a slice of the rows."""
    sizes = np.array([1, 3, 2, 700])
    symbols = np.random.default_rng(1).integers(0, 1 << 20, sizes.sum()).astype(np.int32)
    packed = suffix_tree_lm._packed(symbols, np.cumsum(sizes) - sizes, sizes)
    for a, b in ((0, 4), (1, 3), (3, 4), (2, 2)):
        got, first, n = suffix_tree_lm._flat(pa.record_batch({"symbols": packed}).slice(a, b - a))
        assert got.tolist() == symbols[sizes[:a].sum() : sizes[:b].sum()].tolist()
        assert (n.tolist(), first.tolist()) == (sizes[a:b].tolist(), (np.cumsum(sizes[a:b]) - sizes[a:b]).tolist())


# Near-dedup by shingles --------------------------------------------------------------------------


def test_stage_leaves_no_similar_texts(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([40, 120]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, "two words")]
    docs = make(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    after = stages["simhash_neardup"](spark, docs, "")
    assert after.dtypes == docs.dtypes
    assert {r.doc_id for r in after.collect()} == {rows[i][0] for i in similar_components([t for _, t in rows])}
    twice = make(spark, [(2, "a b c d e f"), (1, "a b  c d e f"), (1, "a b  c d e f"), (None, "g")])
    assert sorted(str(r.doc_id) for r in simhash_neardup.dedup(twice).collect()) == ["1", "None"]
