"""Spelling variants and the Jaccard join, held against plain versions, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from marlstone.llm import jaccard_join, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, key long, node long, hashes string"


def make(spark, texts, parts=5):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, "h") for i, t in texts], SCHEMA).repartition(parts)


# Spelling variants -------------------------------------------------------------------------------


def plain_words(texts):
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(texts):
    n = plain_words(texts)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def worded_texts():
    rng = random.Random(5)
    letters = "abcdeÀéÿß×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    made = list(base)
    for w in base:  # added, removed, exchanged and swapped letters
        i, c = rng.randrange(len(w)), rng.choice(letters)
        made += [w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + w[i:][1:2] + w[i] + w[i + 2 :], w.upper()]
    texts = [(i, " ".join(rng.choices(made, weights=[1 + 9 * (j < 60) for j in range(len(made))], k=40))) for i in range(80)]
    long = "z" * 50_000
    odd = [None, "", " \n", "1234 !?", "abc", "日本 ﬁne", long, long + "z", f"{long} {long}, {long}z {long}z", "aaaaa aaaaa aaaaa aaaab aaaab aaaab"]
    return texts + [(100 + i, t) for i, t in enumerate(odd)] + [(None, "nameless nameless nameless"), *texts[:3]]


def got_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_agree_with_loops(spark):
    texts = worded_texts()
    df = spelling_variants.variants(make(spark, texts), spoil=True)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(texts)
    assert got_variants(df) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] for v in want.values() if v[0])
    assert {len(w) for w in want} >= {5, 50_000, 50_001}


def test_crowded_keys_lose_no_pair(spark):
    texts = [(i, t) for i, t in worded_texts() if not t or len(t) < 10_000]
    assert got_variants(spelling_variants.variants(make(spark, texts), spoil=True, crowded=2)) == plain_variants(texts)


def test_each_near_pair_comes_once(spark):
    counts = spark.createDataFrame([("aaaaa", 9), ("aaaab", 4), ("aaaaaa", 3), ("abaaa", 3), ("aabaa", 3)], "word string, n long")
    for crowded in (1, 256):
        pairs = [(r.word, r.word2) for r in spelling_variants.near_pairs(counts, crowded).collect()]
        assert sorted(pairs) == [("aaaaa", "aaaaaa"), ("aaaaa", "aaaab"), ("aaaaa", "aabaa"), ("aaaaa", "abaaa")]


def test_ties_go_to_the_smaller_word(spark):
    texts = [(1, "house " * 3 + "mouse " * 6 + "rouse " * 6)]
    found = got_variants(spelling_variants.variants(make(spark, texts)))
    assert found["house"][0] == "mouse" and found["rouse"][0] is None


def test_no_words_no_rows(spark):
    assert spelling_variants.variants(make(spark, []), spoil=True).collect() == []
    assert spelling_variants.variants(make(spark, [(1, None), (2, "once only words")])).collect() == []


# Jaccard join ------------------------------------------------------------------------------------


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    sets = [plain_set(t) for _, t in texts]
    of = list(range(len(texts)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                of[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(texts))


def linked_texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    shared = prose(60)
    texts = []
    for size in (6, 12, 40, 120, 300, 900):
        for _ in range(4):
            base = prose(size)
            for rate in (0, 0.005, 0.01, 0.02, 0.04, 0.06, 0.1):  # copies near and beyond the limit
                texts.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in base))
            texts += [" ".join(base[: int(size * x)]) for x in (0.79, 0.8, 0.82, 0.9)]
            texts.append(" ".join(base + shared))
    crowd = prose(80)  # many near copies of one text
    texts += [" ".join(crowd[:i] + ["x"] + crowd[i + 1 :]) for i in range(80)]
    texts += [" ".join(shared + prose(rng.randint(5, 40))) for _ in range(60)]
    long = " ".join(prose(20_000))
    odd = [None, "", " \t\n", "one", "ONE", "two words", "Two\nwords ", "é É", long, long + " end", "x" * 50_000]
    texts = list(enumerate(texts + odd))
    rng.shuffle(texts)
    return [*texts, (None, "nameless one"), (None, None), texts[0], texts[0], (None, texts[5][1])]


@pytest.fixture(scope="module")
def linked():
    texts = linked_texts()
    return texts, plain_components(texts)


@pytest.mark.parametrize("settings", [{}, {"most_nodes": 16}, {"most_nodes": 16, "rounds": 0}])
def test_components_agree_with_loops(spark, linked, settings):
    texts, want = linked
    df = jaccard_join.components_of(make(spark, texts), **settings)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, df.collect())) == want
    assert sum(n for (d, _, c), n in want.items() if d != c) > 150


def test_bounds_never_undercut():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400, np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        if min(len(a), len(b)) * 100 < max(len(a), len(b)) * 80:
            continue
        width = min(jaccard_join.bitmap_bits(len(x)) for x in (a, b))
        one, two = (jaccard_join.folded(jaccard_join.bitmap(x), width) for x in (a, b))
        bound = (len(a) + len(b) - int(jaccard_join.bits_apart(one, two))) // 2
        assert bound >= len(np.intersect1d(a, b))
        assert abs(jaccard_join.band_of(len(a)) - jaccard_join.band_of(len(b))) <= 1


def test_sets_of_many_texts_are_those_of_each():
    """Texts are hashed together; each keeps to its own words, in any order and neighbourhood."""
    from xxhash import xxh64_intdigest

    def plain(text):
        words, out = text.lower().split(), set()
        for i in range(max(1, len(words) - 4) if words else 0):
            h = sum(xxh64_intdigest(w) * int(f) for w, f in zip(words[i : i + 5], jaccard_join._FACTORS, strict=False)) % 2**64
            h = (h ^ (h >> 32)) * int(jaccard_join._FACTORS[0]) % 2**64
            out.add(h ^ (h >> 29))
        return sorted(out)

    texts = [(t or "").encode() for _, t in linked_texts() if len(t or "") < 5000]
    for some in (texts, texts[::-1], [b""], [b"", b"one", b"", b"a b c d", b"a b c d e", b"x y\x0bz " * 9, b" \t"], []):
        got = jaccard_join.shingle_sets(some)
        assert [x.tolist() for x in got] == [plain(t) for t in some]
        assert all(x.dtype == np.uint64 for x in got)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    for n in range(1, 200):
        a = rng.choice(2**40, n, replace=False).astype(np.uint64)
        keep = -(-n * 8 // 9)
        b = np.concatenate([a[:keep], rng.choice(2**40, n - keep).astype(np.uint64) + np.uint64(2**41)])
        shared = len(np.intersect1d(a, b))
        if jaccard_join.similar(shared, n, len(b)):
            first = [set(np.sort(x)[: jaccard_join.prefix_size(len(x))].tolist()) for x in (a, b)]
            assert first[0] & first[1]
        assert jaccard_join.least_shared(np.array([2 * n]))[0] == next(s for s in range(n + 1) if jaccard_join.similar(s, n, n))


def test_one_set_name_for_two_sets_is_noticed(spark, monkeypatch):
    """A hash that gives two sets one name: another seed is taken."""
    described = jaccard_join.described

    def patched(docs, seed):
        rows = described(docs, seed)
        return rows.withColumn("node", rows.node * 0 + 1) if seed == jaccard_join.SEED else rows

    monkeypatch.setattr(jaccard_join, "described", patched)
    texts = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "a b c d e f")]
    assert sorted(map(tuple, jaccard_join.components_of(make(spark, texts)).collect())) == [(1, 2, 1), (2, 2, 2), (3, 2, 1)]


def test_empty_tables(spark):
    assert jaccard_join.components_of(make(spark, [])).collect() == []
    assert jaccard_join.components_of(make(spark, [(3, None)])).collect()[0] == (3, 0, 3)


def test_sql_agrees_with_loops(linked):
    """The SQL that the queries are compared with, on the same hard cases."""
    texts = [(i, t) for i, t in linked[0] if i is not None and (not t or len(t) < 50_000)]
    seen = {i: (i, t) for i, t in texts}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(seen.values()))
    got = Counter(map(tuple, con.execute(jaccard_join.ORACLE_SQL).fetchall()))
    assert got == plain_components(list(seen.values()))
