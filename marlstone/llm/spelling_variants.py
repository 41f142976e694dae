"""Spelling variants by anagram hashing.

A word's anagram key is the sum of a power of each of its letters: words of the same letters have one
key, and adding, removing or exchanging a letter adds, takes away or exchanges one letter's value. So
two words differ by one added letter only if the key of one is the key of the other less a letter's
value, and by one exchanged letter only if both keys less a letter's value are equal.

1. Words are counted over all texts; counts are combined in each task before they are shuffled.
2. Every word gives its own key and its key less each of its letters. These meet in an equi-join. The
   first or the second half of the letters is no part of a change of one letter, so each key goes with
   either half: permutations of the same letters don't meet unless they share a half.
3. A key with more than CROWDED words is divided further: its words meet on the whole word less one
   letter and that letter's place, which at most one word for each letter of the alphabet share.
4. Letter order is verified (edit distance of one) on the words themselves.
5. A word's form is its most frequent near word of at least FACTOR times its count, so counts grow by
   that factor along a chain of forms; roots are found by doubling the steps taken.

Defined results: a null text has no words; a null doc_id is the empty text where words are altered.
Repeated rows count as often as they come. Ties go to the smaller word in code-point order. An empty
table, or texts whose words are all rare, give an empty result. Texts and runs of any length are read
whole. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import drop, materialize
from marlstone.scratch import spread

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT, FACTOR = 5, 3, 2
#: One run of so many loses a letter.
ALTERED = 97
#: Letter values are this power of the code point; sums are taken modulo a prime, so that none overflows.
POWER, MODULUS = 5, (1 << 61) - 1
#: Words that may share a key and a half before the key is divided.
CROWDED = 256


def lowered(c: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def without_letter(word: Column, at: Column) -> Column:
    """word without its code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def altered(doc_id: Column, run: Column) -> Column:
    """One run of ALTERED, by a hash of document and run, loses a letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    return F.when(h % ALTERED == 0, without_letter(run, (h % F.char_length(run)).cast("int"))).otherwise(run)


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, spoil: bool = False) -> DataFrame:
    """word, n of the runs of letters in docs (doc_id, text); with `spoil`, some runs lose a letter first."""
    # A run shorter than the least word can't become one; longer runs match from their first letter.
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0))
    # explode would add a filter on the array's size, and so search every text twice.
    split = docs.select("doc_id", F.explode_outer(runs).alias("run")).where("run is not null")
    low = split.select("doc_id", lowered(F.col("run")).alias("run"))
    made = low.select(altered(F.col("doc_id"), F.col("run")).alias("word") if spoil else F.col("run").alias("word"))
    counted = made.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def letter_value(c: Column) -> Column:
    code = F.ascii(c).cast("long")
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value


def keyed(counts: DataFrame) -> DataFrame:
    """word, n, own (the key is the word's own), size (letters that the key is of), key, half, part: two
    rows for the word's own key and two for the key less each of its letters."""
    letters = counts.withColumn("letters", F.split("word", "")).withColumn("size", F.char_length("word"))
    whole = F.aggregate("letters", F.lit(0).cast("long"), lambda acc, c: (acc + letter_value(c)) % MODULUS)
    less = F.transform(F.array_distinct("letters"), lambda c: F.struct(F.lit(False).alias("own"), F.pmod(F.col("whole") - letter_value(c), F.lit(MODULUS)).alias("key")))
    own = F.array(F.struct(F.lit(True).alias("own"), F.col("whole").alias("key")))
    rows = letters.withColumn("whole", whole).select("word", "n", "size", F.explode(F.concat(own, less)).alias("k"))
    rows = rows.select("word", "n", "k.own", (F.col("size") - (~F.col("k.own")).cast("int")).alias("size"), "k.key")
    half = F.floor(F.col("size") / 2).cast("int")
    first, second = F.left("word", half), F.right("word", F.col("size") - half)
    parts = F.array(F.struct(F.lit(1).alias("half"), F.xxhash64(first).alias("part")), F.struct(F.lit(2).alias("half"), F.xxhash64(second).alias("part")))
    return rows.withColumn("p", F.explode(parts)).select("word", "n", "own", "size", "key", "p.half", "p.part")


MEET = ["size", "key", "half", "part"]


def _one_apart(pairs: DataFrame) -> DataFrame:
    return pairs.where(~(F.col("own") & F.col("own2")) & (F.levenshtein("word", "word2", 1) == 1))


def _met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different words that meet, the smaller first."""
    other = rows.select(*keys, F.col("word").alias("word2"), F.col("n").alias("n2"), F.col("own").alias("own2"))
    return rows.join(other, keys).where("word < word2")


def near_pairs(counts: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """word, n, word2, n2: each pair of words that differ by one letter, once."""
    rows = materialize(keyed(counts), "anagrams")
    sizes = materialize(rows.groupBy(*MEET).agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "met")
    few, many = sizes.where(F.col("met") <= crowded).drop("met"), sizes.where(F.col("met") > crowded).drop("met")
    pairs = _one_apart(_met(rows.join(few, MEET, "left_semi"), MEET))
    # Where both halves are equal, the pair has met in the first.
    head = F.floor(F.col("size") / 2).cast("int")
    pairs = pairs.where((F.col("half") == 1) | (F.left("word", head) != F.left("word2", head)))
    pairs = pairs.select("word", "n", "word2", "n2")
    if many.limit(1).count():
        # The words of crowded keys meet on what is left without one letter, and where it stood; a word's
        # own row stands for a letter missing at each place.
        place = F.explode(F.sequence(F.lit(0), F.col("size"))).alias("at")
        spread = rows.join(many, MEET, "left_semi").select("word", "n", "own", "size").distinct().select("word", "n", "own", "size", place)
        rest = F.when(F.col("own"), F.col("word")).otherwise(without_letter(F.col("word"), F.col("at")))
        exact = spread.select("word", "n", "own", "size", "at", rest.alias("rest"))
        divided = _one_apart(_met(exact, ["size", "at", "rest"])).select("word", "n", "word2", "n2")
        pairs = pairs.unionByName(divided).distinct()
    return pairs


def forms(counts: DataFrame, crowded: int = CROWDED, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n for each word of counts (word, n)."""
    pairs = near_pairs(counts, crowded)
    both = F.explode(F.array(F.struct("word", "n", F.col("word2").alias("near"), F.col("n2").alias("near_n")), F.struct(F.col("word2").alias("word"), F.col("n2").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    ends = pairs.select(both.alias("e")).select("e.word", "e.near", "e.near_n")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = counts.join(best, "word", "left")
    taken = -F.col("best.less") >= factor * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"),
        F.when(taken, -F.col("best.less")).alias("form_n"),
    )


def with_roots(found: DataFrame) -> DataFrame:
    """found (word, form, ...) with root, the end of the chain of forms."""
    steps = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        ahead = materialize(ahead, "steps")
        drop(steps)
        steps = ahead.select("word", "root")
        if not ahead.where("moved").limit(1).count():
            return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, spoil: bool = False, crowded: int = CROWDED) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text)."""
    counts = materialize(words(spread(docs.select("doc_id", "text")), spoil=spoil), "words")
    found = materialize(forms(counts, crowded), "forms")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 in SQL: for each byte, eight steps of the reflected polynomial. All characters are below 256.
_BYTES = "flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] END))"
ORACLE_SQL = rf"""WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
         '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents
), counted AS (
  SELECT doc || ':' || run AS s, run, length(run) AS size, count(*) AS times FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY 1, 2, 3
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(flatten(list_transform({_BYTES}, lambda b: [b::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
         lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT)) AS h FROM counted
), spoilt AS (
  SELECT CASE WHEN h % {ALTERED} = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM spoilt WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(times) >= {LEAST_COUNT}
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(generate_series(1, length(word))) AS g(i)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS r FROM near
), found AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {FACTOR} * w.n THEN r.near END AS form,
         CASE WHEN r.near_n >= {FACTOR} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1
), chain AS (
  SELECT word, word AS reached, 0 AS steps FROM found
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN found f ON f.word = c.reached WHERE f.form IS NOT NULL
), roots AS (SELECT word, arg_max(reached, steps) AS root FROM chain GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM found JOIN roots USING (word)"""
