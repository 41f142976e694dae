"""The retrieval operators against plain specifications and hand-made cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.functions import names, text
from marlstone.operators import answer, bm25, chunk, citations, clean, dense, evaluate, fusion, graph, qc, registry
from marlstone.operators.ranking import ranked


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first().x


# Text --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("raw", "lines"),
    [
        ("ab-\ncd", ["abcd"]),
        ("ab-\r\ncd", ["ab-", "cd"]),
        ("\xa0x \t y\n— 12 —\n•••\n\n12345\n", ["x y", "12345"]),
        ("жа-\nба​\x00z", ["жаба z"]),
        ("", []),
    ],
)
def test_clean_lines(spark, raw, lines):
    assert one(spark, raw, text.clean_lines) == lines


@pytest.mark.parametrize(("token", "pages"), [("7", [7]), ("12-14", [12, 13, 14]), ("12–14", [12, 13, 14]), ("12-40", [12, 40]), ("5-3", [5, 3]), ("a-3", []), ("", []), (" 4 ", [4]), ("3-4-5", [])])
def test_page_numbers(spark, token, pages):
    assert one(spark, token, text.page_numbers) == pages


def test_refusals(spark):
    assert one(spark, "«В  источниках нет\nответа» на вопрос", text.refuses)
    assert not one(spark, "«В источниках нет ответа» на вопрос", text.is_refusal)
    assert one(spark, "\x1b[1mВ источниках нет ответа.\x1b[0m", text.is_refusal)
    assert not one(spark, "", text.refuses)


def test_names(spark):
    keys = {"Dir/Тестовый ё-1.PDF": "тестовыи е 1", "ō  Book(2).pdf": "o book 2", "a.pdf.pdf": "a pdf"}
    for raw, key in keys.items():
        assert one(spark, raw, names.registry_key) == key
    assert one(spark, '"x%20y%2B+.PDF#page=3"', names.evaluation_key) == "x y++.pdf"
    assert one(spark, "a\\b\\Straße.pdf?x", names.evaluation_key) == "strasse.pdf"
    assert one(spark, None, names.evaluation_key) == ""
    assert one(spark, " Été: один!! ", names.slug) == "été_один"
    assert one(spark, "!!", names.slug) == "unknown_doc"
    assert one(spark, "ftp://x.y/", names.is_public_url) is False
    assert one(spark, "http://localhost/a", names.is_public_url) is False
    assert one(spark, "https://x.y/a", names.is_public_url) is True
    url = names.source_url("http://b/", F.lit("k"), F.lit("raw/a b+c.pdf"), F.lit("s"), F.lit(3))
    assert spark.range(1).select(url.alias("u")).first().u == "http://b/k/raw/a%20b%2Bc.pdf#page=3&zoom=page-fit"


def test_point_id(spark):
    import hashlib

    want = str(int.from_bytes(hashlib.sha1(b"f.pdf:c1").digest()[:8], "big"))
    assert spark.range(1).select(names.point_id(F.lit("f.pdf"), F.lit("c1")).alias("p")).first().p == want


@pytest.mark.parametrize("of_a_task", [0, 10**6])
def test_ranks_in_large_groups(spark, monkeypatch, of_a_task):
    monkeypatch.setattr("marlstone.operators.ranking.ROWS_OF_A_TASK", of_a_task)
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(0, 30, 3)] + [(None, 1), (None, 0)]
    random.Random(0).shuffle(rows)
    got = {(r.k, r.v): r.n for r in ranked(spark.createDataFrame(rows, "k string, v int").where("k is not null"), ["k"], ["v"], "n").collect()}
    assert got == {("a", i): i + 1 for i in range(500)} | {("b", 3 * i): i + 1 for i in range(10)}


# Cleaning ----------------------------------------------------------------------------------------


def test_headers_and_footers(spark):
    pages = [("d", p, f"The Book\nText {p}a\nMore {p} , x\nEven ( {p} )\nlines {p}\nlast {p}\nfoot" if p <= 3 else "") for p in range(1, 11)]
    pages += [("e", p, "Same\nx y\nSame") for p in range(1, 5)]
    lined = clean.page_lines(spark.createDataFrame(pages, "doc_id string, page_num int, text string"))
    found = clean.repeated_lines(lined)
    assert {(r.doc_id, r.line, r.kind) for r in found.collect()} == {("d", "the book", "header"), ("d", "foot", "footer")}
    rows = {(r.doc_id, r.page_num): r for r in clean.cleaned(lined, found).collect()}
    assert rows["d", 1].text == "Text 1a\nMore 1, x\nEven (1)\nlines 1\nlast 1"
    assert rows["d", 1].dropped_lines == 2
    assert rows["e", 1].text == "Same\nx y\nSame"
    totals = {r.doc_id: (r.total_pages, r.text_pages) for r in clean.report(clean.cleaned(lined, found)).collect()}
    assert totals == {"d": (10, 3), "e": (4, 4)}


# Chunks ------------------------------------------------------------------------------------------


def sentence(n, end="."):
    return "A" + "b" * (n - 2) + end


def test_small_page_stays_whole():
    assert chunk.page_chunks("One  two.\n \nThree.\r\n\r\n\r\nFour.") == ["One two.\n\nThree.\n\nFour."]
    assert chunk.page_chunks(" \n\t\n") == []


def test_paragraph_ends():
    full, short = sentence(540), sentence(539)
    rest = sentence(500)
    assert chunk.page_chunks(f"{full}\n\n{rest}") == [full, rest]
    assert chunk.page_chunks(f"{short}\n\n{sentence(300)}\n\n{rest}") == [f"{short} {sentence(300)}", rest]


def test_long_sentences():
    clauses = ", ".join("c" * 90 for _ in range(12))
    got = chunk.page_chunks(clauses)
    assert all(len(c) <= 900 for c in got[:-1])
    assert " ".join(got) == clauses
    assert [len(c) for c in chunk.page_chunks("w" * 1950)] == [900, 1051]  # 900, 900 and a tail of 150
    assert [len(c) for c in chunk.page_chunks("w" * 1990)] == [900, 900, 190]


def test_tails():
    a = sentence(900)
    assert [len(c) for c in chunk.page_chunks(f"{a} {sentence(179)}")] == [1080]
    assert [len(c) for c in chunk.page_chunks(f"{a} {sentence(180)}")] == [900, 180]


def test_chunks_lose_nothing():
    rng = random.Random(7)
    for _ in range(200):
        words = ["".join(rng.choice("abcЯя") for _ in range(rng.choice([1, 5, 9, 30, 1000]))) + rng.choice(["", "", ",", ".", "!", ";"]) for _ in range(rng.randint(1, 200))]
        page = "".join(w.capitalize() + rng.choice([" ", " ", "  ", "\n", "\n\n", "\n \n"]) for w in words)
        chunks = chunk.page_chunks(page)
        assert "".join("".join(chunks).split()) == "".join(page.split())
        assert all(len(c) <= 900 for c in chunks[:-1])
        assert not chunks or len(chunks[-1]) <= 1215


def test_chunk_rows(spark):
    pages = spark.createDataFrame([("d", "T", "d.pdf", 1, "x " * 600), ("d", "T", "d.pdf", 2, None), ("d", "T", "d.pdf", 3, "y")], "doc_id string, title string, source_pdf string, page_num int, text string")
    rows = chunk.chunked(pages)
    assert [(r.chunk_id, r.chunk_index, r.chars) for r in rows.orderBy("chunk_id").collect()] == [("d_p0001_c001", 1, 899), ("d_p0001_c002", 2, 299), ("d_p0003_c001", 1, 1)]
    assert chunk.stats(rows).first().total_pages_with_text == 2


# Search ------------------------------------------------------------------------------------------


def test_bm25_by_hand(spark):
    texts = {"a": "cat cat dog", "b": "dog", "c": "!", "d": "cat dog bird bird", "e": "dog"}
    page = {"a": 3, "b": 2, "c": 1, "d": None, "e": 2}
    chunks = spark.createDataFrame([(i, t, page[i]) for i, t in texts.items()], "chunk_id string, text string, page_num int")
    asked = spark.createDataFrame([(1, "cat CAT dog"), (2, "zebra"), (3, ""), (4, "dog")], "query_id long, query string")
    got = [(r.query_id, r.rank, r.chunk_id, r.score) for r in bm25.search(bm25.build(chunks), asked, chunks, 3).orderBy("query_id", "rank").collect()]
    lengths = {i: len(t.replace("!", "").split()) for i, t in texts.items()}
    mean = sum(lengths.values()) / 5

    def score(i, query):
        total = 0
        for t, n in Counter(query).items():
            df = sum(t in x.split() for x in texts.values())
            tf = texts[i].split().count(t)
            total += n * math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths[i] / mean))
        return round(total, 6)

    for q, query in ((1, ["cat", "cat", "dog"]), (4, ["dog"])):
        order = sorted((i for i in texts if score(i, query) > 0), key=lambda i: (-score(i, query), page[i] or 10**9, i))[:3]
        assert [(r, c, s) for i, r, c, s in got if i == q] == [(n, c, score(c, query)) for n, c in enumerate(order, 1)]
    assert {g[0] for g in got} == {1, 4}


def test_dense_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [1.0, None]), (7, [2.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 1.0]), (8, None)], "query_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in dense.search(vectors, asked, 3).orderBy("rank").collect()] == [(2, 1.0), (7, 1.0), (1, 0.707107)]


def test_fusion_ties_and_repeats(spark):
    schema = "query_id long, rank int, chunk_id string, score double"
    near = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "b", 0.8)], schema)
    sparse = spark.createDataFrame([(1, 1, "c", 5.0), (1, 2, "b", 4.0), (2, 1, "z", 1.0)], schema)
    got = [(r.query_id, r.chunk_id, r.dense_score, r.sparse_score) for r in fusion.fuse(near, sparse, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, "b", 0.8, 4.0), (1, "a", 0.9, 0.0), (1, "c", 0.0, 5.0), (2, "z", 0.0, 1.0)]
    with pytest.raises(ValueError, match="unknown mode"):
        fusion.retrieve("other", near, sparse, 3)


# Graph -------------------------------------------------------------------------------------------


def test_graph_and_expansion(spark):
    rows = [("d", 1, "a"), ("d", 1, "b"), ("d", 1, "c"), ("d", 2, "e"), ("d", 4, "f"), ("d", None, "n"), ("x", 1, "solo")]
    chunks = spark.createDataFrame(rows, "doc_id string, page_num int, chunk_id string")
    links = graph.edges(chunks)
    kinds = {(r.src, r.dst): r.edge_type for r in links.collect()}
    assert {k for k, v in kinds.items() if v == "prev_next"} == {p for a, b in zip("abcef", "bcefn", strict=True) for p in ((a, b), (b, a))}
    assert kinds["a", "c"] == "same_page"
    assert kinds["e", "a"] == kinds["a", "e"] == "adjacent_page"
    s = graph.stats(chunks, links).first()
    assert 2 * s.prev_next + 2 * s.same_page + s.adjacent_page == s.total_edges_directed == len(kinds)
    nodes = graph.nodes(chunks, links)
    assert {r.chunk_id: r.neighbors for r in nodes.collect()}["solo"] == []
    seeds = spark.createDataFrame([(1, 1, "b", 1.0), (1, 2, "c", 0.5), (2, 1, "solo", 0.3), (3, 1, "f", 1.0), (3, 2, "f", 0.9)], "query_id long, rank int, chunk_id string, score double")

    def found(k, **more):
        out = {}
        for r in graph.expand(seeds, nodes, k, **more).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        return out

    assert found(5) == {1: [("b", 1.0), ("c", 0.5), ("a", 0.95), ("e", 0.95)], 2: [("solo", 0.3)], 3: [("f", 1.0), ("e", 0.95), ("n", 0.95)]}
    assert found(3)[1] == [("b", 1.0), ("c", 0.5), ("a", 0.95)]
    assert found(1)[1] == [("b", 1.0)]
    assert found(4, per_seed=1)[1] == [("b", 1.0), ("c", 0.5), ("a", 0.95), ("e", 0.475)]


# Citations ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("said", "n", "text_", "used"),
    [
        ("x [3] y [1][3] z [9].", 3, "x [1] y [1][2] z .", [2, 0]),
        ("[2][1][2] a", 2, "[1][2] a", [1, 0]),
        ("no  [7] cite", 3, "no  [7] cite", []),
        ("[0] [2]", 2, "[1]", [1]),
        (None, 2, "", []),
        ("[99999999999999999999] [1]", 1, "[1]", [0]),
    ],
)
def test_renumber(spark, said, n, text_, used):
    changed, order = citations.renumber(F.col("c"), F.lit(n))
    row = spark.createDataFrame([(said,)], "c string").select(changed.alias("t"), order.alias("u")).first()
    assert (row.t, row.u) == (text_, used)


def test_assignment(spark):
    chunks = spark.createDataFrame([(1, 0, "The green fox runs home"), (1, 1, "A blue whale swims and a green fox runs"), (1, 2, "The green fox runs home")], "query_id long, idx int, text string")
    said = "The green fox runs home. [2] Green fox runs . Blue whale swims! Nothing matches here at all? zz"
    answers = spark.createDataFrame([(1, said), (2, ""), (3, None)], "query_id long, answer string")
    rows = {r.query_id: r for r in citations.assign(answers, chunks).collect()}
    assert rows[1].answer == "The green fox runs home. Green fox runs. [1] Blue whale swims! [2] Nothing matches here at all? zz"
    assert rows[1].used == [0, 1]
    assert rows[2].answer == rows[3].answer == ""


def test_envelope(spark):
    hits = spark.createDataFrame(
        [(1, 1, "d", "c1", 0.5, 2, 2, "Alpha beta gamma.", "T\x01", "d.pdf", "u"), (1, 2, "d", "c2", 0.25, 3, 4, "Delta epsilon zeta.", "", "e.pdf", "v"), (2, 1, "d", "c1", 0.5, None, 0, "Alpha.", None, None, None)],
        "query_id long, rank int, doc_id string, chunk_id string, score double, page_start int, page_end int, text string, title string, source_pdf string, url string",
    )
    context = {r.query_id: r.context for r in answer.contexts(hits).collect()}
    assert context[1] == "[1] doc_id=d chunk=c1 score=0.5000 page=2\nAlpha beta gamma.\n\n[2] doc_id=d chunk=c2 score=0.2500 pages=3-4\nDelta epsilon zeta."
    assert context[2] == "[1] doc_id=d chunk=c1 score=0.5000\nAlpha."
    asked = spark.createDataFrame([(1, "q"), (2, "refuse"), (3, "nothing found")], "query_id long, question string")

    def say(question, context, n, force):
        if question == "refuse":
            return "В источниках нет ответа на это"
        return "Delta epsilon zeta. Alpha beta gamma [2]." if force else "no citation"

    rows = {r.query_id: r for r in answer.envelopes(asked, hits, say).collect()}
    assert rows[1].answer == "Delta epsilon zeta. [1] Alpha beta gamma. [2]"
    assert [(s.n, s.title, s.filename, s.page_start, s.url) for s in rows[1].sources] == [(1, "e.pdf", "e.pdf", 3, "v"), (2, "T", "d.pdf", 2, "u")]
    assert (rows[2].answer, rows[2].sources, rows[2].retrieved) == (text.REFUSAL_ANSWER, [], 1)
    assert (rows[3].answer, rows[3].retrieved) == (text.REFUSAL_ANSWER, 0)


# Evaluation --------------------------------------------------------------------------------------


def test_evaluation(spark):
    ref = "struct<source_filename:string,source_pages:array<int>>"
    gold = spark.createDataFrame(
        [("q1", True, ("A.pdf", [1, 2]), [("b.pdf", [7])]), ("q2", True, ("a.pdf", []), None), ("q3", False, ("", [1]), None), ("q4", True, ("a.pdf", [1]), [])],
        f"question_id string, answerable boolean, primary_reference {ref}, alternative_references array<{ref}>",
    )
    runs = spark.createDataFrame(
        [
            ("q1", "ok", "x [2]", [(1, "a.pdf", [1, 2]), (2, "B%2Epdf", [7])]),
            ("q2", "ok", "y", [(1, "a.pdf", [3])]),
            ("q3", "cli_error", "В источниках нет ответа.", []),
            ("q4", "timeout", None, None),
        ],
        "question_id string, status string, model_answer string, sources array<struct<index:int,filename:string,page_numbers:array<int>>>",
    )
    judged = evaluate.records(gold, runs)
    rows = {r.question_id: r for r in judged.collect()}
    q1 = rows["q1"]
    assert (q1.page_hit, q1.page_hit_any, q1.exact_cited_pages_match_any, q1.gold_source_match_found, q1.gold_source_match_found_any) == (False, True, True, False, True)
    assert (q1.answer_citations, q1.cited_source_pages_all, q1.matched_gold_references) == ([2], [7], 1)
    assert not any(rows["q2"][f] for f in ("page_hit", "all_gold_pages_covered", "exact_cited_pages_match", "page_hit_legacy"))
    assert rows["q2"].gold_source_match_found
    assert (rows["q3"].answerability_match, rows["q3"].refusal_match, rows["q3"].gold_source_match_found_any) == (True, True, False)
    s = evaluate.summary(judged).first()
    assert (s.total_questions, s.ok, s.cli_error, s.timeout, s.other_errors) == (4, 2, 1, 1, 1)
    assert (s.answerability_accuracy_proxy, s.no_answer_accuracy, s.citation_presence_rate, s.page_hit_rate_on_answerable) == (1.0, 1.0, 0.3333, 0.5)
    assert (s.gold_source_match_found_rate_primary, s.gold_source_match_found_rate_any) == (0.5, 1.0)
    assert evaluate.summary(judged.where("false")).first().no_answer_accuracy is None


def test_quality_control(spark):
    long = "word " * 20
    docs = {"good": [long] * 9 + [""], "half": [long] * 7 + [""] * 3, "bad": [long] * 4 + [""] * 6, "short": ["tiny"] + [""] * 9, "none": ["", " \n"]}
    pages = [(d, p, t) for d, texts in docs.items() for p, t in enumerate(texts, 1)]
    df = spark.createDataFrame(pages, "doc_id string, page_num int, text string")
    assert {r.doc_id: r.status for r in qc.status(df).collect()} == {"good": "good", "half": "acceptable", "bad": "bad", "short": "acceptable", "none": "bad"}
    verdicts = {r.doc_id: (r.begin_page, r.verdict) for r in qc.samples(df).collect()}
    assert verdicts["good"] == (1, "everywhere")
    assert verdicts["none"] == (None, "poor")


def test_registry(spark):
    files = spark.createDataFrame([("Ā.pdf", "old", 1), ("x/a.PDF", "new", 2), (" ", "no", 3)], "filename string, doc_id string, line long").selectExpr("*", "'b' as s3_bucket", "'k' as s3_key", "'s' as source")
    chunks = spark.createDataFrame([("a.pdf", "c1"), ("other.pdf", "c2")], "source_pdf string, chunk_id string")
    assert {r.chunk_id: (r.registry_doc_id, r.registry_filename) for r in registry.enrich(chunks, files).collect()} == {"c1": ("new", "a.PDF"), "c2": (None, None)}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, registry.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


# Transcripts -------------------------------------------------------------------------------------


def test_transcripts(spark):
    from marlstone.operators import transcripts

    told = "noise\nОтвет: да [2]\nещё\n\n\n\nstill [1]\nИсточники:\nignored\n[1] One.pdf, стр. 3, 5-6\nhttp://h/q#page=9\n2. filename=b%20c.pdf | title=T  x | pages=4–5, 7, x | url=http://h/z.pdf\n(3) no\n4] page: 12-40"
    rows = {r.question_id: r for r in transcripts.parse(spark.createDataFrame([(1, told), (2, ""), (3, "just text\nSources:\n"), (4, "В ИСТОЧНИКАХ НЕТ ОТВЕТА на это"), (5, None)], "question_id long, stdout string")).collect()}
    assert rows[1].model_answer == "да [2]\nещё\n\nstill [1]"
    assert [(s["index"], s.filename, s.page_numbers, s.url) for s in rows[1].sources] == [(1, "One.pdf", [3, 5, 6, 9], None), (2, "b%20c.pdf", [4, 5, 7], "http://h/z.pdf\n(3) no"), (4, None, [12, 40], None)]
    assert rows[1].sources[1].title == "T x"
    assert (rows[2].model_answer, rows[2].sources) == ("", None)
    assert (rows[3].model_answer, rows[4].model_answer, rows[5].model_answer) == ("just text", text.REFUSAL_ANSWER, "")


def test_messages():
    from marlstone.operators.transcripts import cut_message

    assert cut_message("short\n") == ["short\n"]  # a text that fits stays as it is
    assert cut_message("") == []
    assert cut_message("aaa\nbbb\nccc ddd", 8) == ["aaa\nbbb", "ccc ddd"]
    assert cut_message("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def ranks(scores, k):
    """The k best of each query, with all that tie with the last."""
    by_query = {}
    for r in scores.collect():
        by_query.setdefault(r.query_id, []).append((-r.score, r.chunk_id))
    out = {}
    for q, rows in by_query.items():
        rows.sort()
        last = rows[min(k, len(rows)) - 1][0]
        out[q] = [(c, round(s, 5)) for s, c in rows if s <= last + 1e-9]
    return out


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_pruned_scores_rank_as_full_ones(spark, monkeypatch, k):
    rng = random.Random(8)
    words = [f"w{i:03d}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(300)]
    texts += texts[:5] + ["", None, "w000", "w000 w000"]  # copies tie
    chunks = spark.createDataFrame([(f"c{i:03d}", t, i) for i, t in enumerate(texts)], "chunk_id string, text string, page_num int")
    asked = [texts[i] for i in range(0, 60, 4)] + ["w000", "w000 w001", "unknown words", "", "w290 w291 w000 w000", None]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = bm25.build(chunks)
    seen = []
    write = bm25.materialize
    monkeypatch.setattr(bm25, "materialize", lambda df, label: seen.append((label, out := write(df, label))) or out)
    pruned = bm25.best(index, queries, k, full_postings=0)
    full = bm25.score(index, queries)
    assert ranks(pruned, k) == ranks(full, k)
    stayed = dict(seen)["missing"].select("query_id", "chunk_id").distinct().count()
    assert k > 4 or stayed < 0.1 * full.count()


def test_runs_stand_for_the_whole_graph(spark):
    rng = random.Random(2)
    rows = [(d, rng.choice([None, 0, -1, 1, 1, 2, 2, 2, 3, 5, 6, 9]), f"{d}{i:03d}") for d in "abc" for i in rng.sample(range(1000), 40)]
    rows += [("solo", 4, "solo"), ("blank", None, "b1"), ("blank", None, "b2"), ("blank", -1, "b3")]
    for chosen in (rows, [r for r in rows if r[0] == "solo"], [], [*rows, ("z", 1, rows[0][2])]):  # the last: an id that repeats
        chunks = spark.createDataFrame(chosen, "doc_id string, page_num int, chunk_id string")
        want = graph.stats(chunks, graph.edges(chunks)).first()
        assert graph.run_stats(chunks).first().asDict() == want.asDict()
    chunks = spark.createDataFrame(rows, "doc_id string, page_num int, chunk_id string")
    ids = [r[2] for r in rows]
    seeds = spark.createDataFrame([(q, r, rng.choice(ids), 1.0 / r) for q in range(30) for r in (1, 2, 3)], "query_id long, rank int, chunk_id string, score double")
    nodes, held = graph.nodes(chunks, graph.edges(chunks)), graph.runs(chunks)
    for settings in ((5, 2, 2), (9, 3, 4), (1, 1, 1)):
        full = sorted(map(tuple, graph.expand(seeds, nodes, *settings).collect()))
        assert sorted(map(tuple, graph.expand_runs(seeds, held, *settings).collect())) == full


@pytest.mark.parametrize("small", [False, True])
def test_search_moves_no_postings(spark, monkeypatch, small):
    """Hits are those of the full scores, ties by page and id, in blocks of any size; neither postings nor scores of
    pairs are written, and a saved index, which has no rows of chunks, gives the same."""
    rng = random.Random(5)
    words = [f"w{i:03d}" for i in range(80)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(80)], k=rng.randint(0, 40))) for _ in range(200)]
    texts += texts[:30] + [None, "w001 w001"]
    chunks = spark.createDataFrame([(f"c{i:03d}", t, rng.choice([None, -1, 1, 2, 3])) for i, t in enumerate(texts)], "chunk_id string, text string, page_num int").cache()
    page = {r.chunk_id: r.page_num if r.page_num and r.page_num > 0 else bm25.LAST_PAGE for r in chunks.collect()}
    queries = spark.createDataFrame(list(enumerate([*texts[:40:2], "w000 w000 w079", "none", None])), "query_id long, query string")
    index = bm25.build(chunks)
    if small:
        for name, value in {"QUERIES_AT_ONCE": 9, "TOKENS_AT_ONCE": 50, "SCORES_AT_ONCE": 64, "DENSE_WORDS": 3}.items():
            monkeypatch.setattr(bm25, name, value)
    scores = {}
    for r in bm25.score(index, queries).collect():
        scores.setdefault(r.query_id, []).append((-r.score, page[r.chunk_id], r.chunk_id))
    want = sorted((q, n, c, -s) for q, found in scores.items() for n, (s, _, c) in enumerate(sorted(found)[:7], 1))
    seen, write = [], bm25.materialize
    monkeypatch.setattr(bm25, "materialize", lambda df, label: seen.append(label) or write(df, label))
    for held in (index, bm25.Bm25Index(index.postings, index.terms, index.stats)):
        got = bm25.search(held, queries, chunks, 7).collect()
        assert sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in got) == want
    assert seen == ["query_terms", "weights", "query_terms", "rows", "weights"]


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of one row group has one task read all its rows, however many splits it has."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from marlstone import scratch

    pq.write_table(pa.table({"i": list(range(20_000))}), f"{tmp_path}/x.parquet", row_group_size=1 << 20)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        df = spark.read.parquet(f"{tmp_path}/x.parquet")
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in scratch.spread(df).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 10_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edges_are_not_grouped(spark):
    """Edges are distinct as they are made: nothing holds them all to group them, unless chunk ids repeat."""
    rng = random.Random(3)
    rows = [(d, rng.choice([None, 0, -1, 1, 1, 2, 3, 3, 5, 6]), f"{d}{i:03d}") for d in "ab" for i in rng.sample(range(1000), 30)]
    for chosen in (rows, [*rows, ("z", 1, rows[0][2]), ("z", 2, rows[0][2]), ("z", 2, "z1")]):
        found = {}
        keyed = {}
        for d, p, c in chosen:
            keyed.setdefault(d, []).append((p if p and p > 0 else graph.LAST_PAGE, c, p))
        for held in keyed.values():
            held.sort(key=lambda x: x[:2])
            for i, (_, a, p) in enumerate(held):
                for j, (_, b, r) in enumerate(held):
                    known = p is not None and r is not None
                    kind = 0 if abs(i - j) == 1 else 1 if known and p == r and a != b else 2 if known and abs(p - r) == 1 and a != b else None
                    if kind is not None:
                        found[a, b] = min(kind, found.get((a, b), 9))
        got = graph.edges(spark.createDataFrame(chosen, "doc_id string, page_num int, chunk_id string"))
        assert sorted(map(tuple, got.collect())) == sorted((a, b, graph.KINDS[k]) for (a, b), k in found.items())
        if chosen is rows:
            assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_cut_in_slices(spark, monkeypatch):
    """A task holds some bytes of text at once, not a batch; the chunks are the same."""
    rng = random.Random(6)
    texts = [None, "", *(" ".join(rng.choices(["Word", "и", "end.", "next;"], k=rng.randint(1, 400))) for _ in range(60))]
    pages = spark.createDataFrame([("d", "t", "p", i, t) for i, t in enumerate(texts)], "doc_id string, title string, source_pdf string, page_num int, text string")
    want = sorted((i, n, c) for i, t in enumerate(texts) for n, c in enumerate(chunk.page_chunks(t or ""), 1))
    for at_once in (1, 1000, 1 << 20):
        monkeypatch.setattr(chunk, "CUT_AT_ONCE", at_once)
        assert sorted(map(tuple, chunk.chunked(pages).select("page_num", "chunk_index", "text").collect())) == want
