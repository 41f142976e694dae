"""The operators on vectors, pages and conversations, and the pipeline."""

import json
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import chat_formatting as chat
from marlstone.llm import exact_topk, queries, url_filters

SF = "/root/testdata/sf0.001"


# Exact top-k -------------------------------------------------------------------------------------


def plain_topk(rows, k):
    whole = [(p, i, [math.floor(1024 * float(x)) for x in v]) for p, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for p, i, v in whole:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for q, j, w in whole if q != p and len(w) == len(v))
            out.update((i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1))
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, place int, score string")


@pytest.mark.parametrize(("tile_rows", "block_bytes"), [(7, 200), (1000, 1 << 24)])
def test_topk(spark, tile_rows, block_bytes):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(350)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(200, rows[200][1]), (400, rows[3][1])]
    rows += [(500, None), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (800, [1.0, 2.0]), (801, [-1.0, 2.5]), (None, rows[0][1]), (900, [])]
    got = exact_topk.search(vectors(spark, rows), F.pmod("vec_id", F.lit(100)) == 0, tile_rows=tile_rows, block_bytes=block_bytes)
    assert Counter(map(tuple, got.collect())) == plain_topk(rows, 10)


def test_topk_of_huge_components(spark):
    rows = [(100, [3e9, 1.0]), (1, [2e3, -5.0]), (2, [2e3, -5.001])]
    got = exact_topk.search(vectors(spark, rows), F.col("vec_id") == 100)
    assert Counter(map(tuple, got.collect())) == plain_topk([(i, np.array(v, np.float32).tolist()) for i, v in rows], 10)
    assert exact_topk.search(vectors(spark, []), F.col("vec_id") == 100).count() == 0


def test_topk_beyond_64_bits(spark):
    """Components beyond 64 bits take no part, scores beyond them are held at their end."""
    rows = [(100, [1e15, 1.0]), (1, [1e20, 0.0]), (2, [1e15, 0.0]), (3, [2e15, 0.0]), (4, [-1e15, 0.0]), (5, [0.0, 1.0])]
    got = [(r.vec_id, r.score) for r in exact_topk.search(vectors(spark, rows), F.col("vec_id") == 100).orderBy("rank").collect()]
    assert got == [(2, 2**63 - 1), (3, 2**63 - 1), (5, 1024 * 1024), (4, -(2**63))]


def test_threshold_spares_products():
    """On clustered vectors most tiles are passed over before any product is made, and none that counts."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 400, (40, 32))
    matrix = np.floor(np.repeat(centres, 250, axis=0) + rng.normal(0, 20, (10_000, 32)))
    own = []
    for rows in exact_topk.tiles_of(matrix, 128):
        v = matrix[rows]
        c = v.mean(axis=0)
        radii = np.array([np.sqrt(((v[:, x] - c[x]) ** 2).sum(axis=1)).max() for x in exact_topk.list_cuts(32, 4)])
        own.append(exact_topk.Tile(32, rows, rows, np.zeros(len(rows), bool), v, c, radii))
    assert sum(len(t.ids) for t in own) == len(matrix)
    queries = matrix[::100]
    every = queries @ matrix.T
    block = exact_topk.Block(np.arange(len(queries)), np.arange(len(queries)), queries, np.sort(every, axis=1)[:, -10])
    wanted = exact_topk.collected(block, own, 4)
    assert wanted.mean() < 0.1
    for t, tile in enumerate(own):
        assert wanted[:, t][(every[:, tile.ids] >= block.cutoffs[:, None]).any(axis=1)].all()


def admitted_share(matrix, queries, lists=4, k=10):
    """What the local scores admit of all products, in tiles that bounds don't spare; every row that reaches a cutoff is in."""
    every = queries @ matrix.T
    cutoffs = np.sort(every, axis=1)[:, -k]
    made = 0
    for rows in exact_topk.tiles_of(matrix, 128):
        v = matrix[rows]
        tile = exact_topk.Tile(matrix.shape[1], rows, rows, np.zeros(len(rows), bool), v, v.mean(axis=0), np.zeros(lists))
        wanted = exact_topk.admitted(queries, cutoffs, tile, lists)
        assert wanted[every[:, rows] >= cutoffs[:, None]].all()
        a, b = np.nonzero(wanted)
        assert (exact_topk.pair_scores(queries, v, a, b) == every[a, rows[b]]).all()
        made += wanted.sum()
    return made / every.size


def test_entries_spare_products(spark):
    """Of the given vectors, where no tile is spared, few products are resolved."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas()
    matrix = np.floor(1024 * np.stack(rows.embedding).astype(np.float64))
    assert admitted_share(matrix, matrix[rows.vec_id % 100 == 0]) < 0.1


@pytest.mark.parametrize("largest", [3, 2**20, 2**40])
def test_entries_that_tie_or_are_huge(largest):
    """Rounding of local scores never keeps out a row that reaches its cutoff."""
    rng = np.random.default_rng(largest)
    matrix = rng.integers(-largest, largest + 1, (300, 7)).astype(object)
    queries = matrix[::30]
    every = queries @ matrix.T
    cutoffs = np.array(np.sort(every, axis=1)[:, -10], np.float64)
    cutoffs = np.where(np.abs(cutoffs) < 2.0**53, cutoffs, cutoffs - 2.0**-50 * np.abs(cutoffs))
    v = matrix.astype(np.int64)
    tile = exact_topk.Tile(7, np.arange(300), np.arange(300), np.zeros(300, bool), v, np.zeros(7), np.zeros(4))
    wanted = exact_topk.admitted(queries.astype(np.int64), cutoffs, tile, 4)
    assert wanted[(every >= cutoffs[:, None]).astype(bool)].all()


# URL filters -------------------------------------------------------------------------------------


def test_urls(spark):
    cases = [
        ("http://a.example.com/en/70/x?q#f", "a.example.com", "/en/70/x", "example.com/en/7", "allow"),
        ("http://EXAMPLE.com/en/6", "example.com", "/en/6", "com/en/", "block"),
        ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("http://x.example.net/de/8", "x.example.net", "/de/8", "example.net/de/8", "block"),
        ("http://com.de/en/7", "com.de", "/en/7", None, "allow"),
        ("http://org/es/", "org", "/es/", "org/es/", "block"),
        ("http://org", "org", "", None, "allow"),
        ("http://org?/es/", "org", "", None, "allow"),
        ("a://b://org/es/", "b:", "//org/es/", None, "allow"),
        ("org/es/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://" + "a." * 5000 + "org/es/" + "z" * 9000, "a." * 5000 + "org", "/es/" + "z" * 9000, "org/es/", "block"),
        ("http://É.org/ES/", "É.org", "/ES/", None, "allow"),
    ]
    rows = [(i, c[0], "h", "p") for i, c in enumerate(cases)] + [(None, cases[0][0], "h", "p"), (0, cases[0][0], "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    want = Counter((i, *c[1:]) for i, c in enumerate(cases)) + Counter([(None, *cases[0][1:]), (0, *cases[0][1:])])
    assert Counter(map(tuple, url_filters.judge(pages).collect())) == want
    assert url_filters.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, []).collect()} == {"allow"}


def test_url_rules_are_those_of_the_contract(spark):
    """Each rule of op7's contract by an address that it alone decides; the SQL gives the same verdicts."""
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert dict(url_filters.RULES) == contract
    pages = spark.createDataFrame(list(enumerate(f"http://{rule}" for rule in contract)), "page_id long, url string")
    # With block as the default a rule that allows can be told from none.
    assert {r.rule: r.verdict for r in url_filters.judge(pages, default="block").collect()} == contract
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    found = con.sql(url_filters.ORACLE_SQL).to_arrow_table().to_pylist()
    assert {r["rule"]: r["verdict"] for r in found} == contract


def test_url_plan_is_native(spark):
    plan = queries.op7_url_filters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "html" not in plan


SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.mark.parametrize("operator", ["urls", "fingerprints"])
def test_rows_of_a_hot_key_are_split(spark, monkeypatch, operator):
    """One key holds nine tenths of the rows; Spark splits them in the last join."""
    from marlstone import scratch
    from marlstone.llm import simhash_neardup

    monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
    before = {k: spark.conf.get(k, None) for k in SKEWED}
    try:
        for k, v in SKEWED.items():
            spark.conf.set(k, v)
        i = F.col("id")
        if operator == "urls":
            pages = spark.range(0, 40_000, 1, 8).select(i.alias("page_id"), F.when(i % 10 > 0, "http://a.com/en/x").otherwise(F.concat(F.lit("http://b"), i, F.lit(".net/de/8"))).alias("url"))
            got = url_filters.judge(pages)
            want = Counter({("com/en/", "block"): 36_000, ("net/de/", "allow"): 4_000})
            rows = Counter((r.rule, r.verdict) for r in got.collect())
        else:
            docs = spark.range(0, 40_000, 1, 8).select(i.alias("doc_id"), F.when(i % 10 > 0, "the same text here").otherwise(F.md5(i.cast("string"))).alias("text"))
            got = simhash_neardup.components_of(docs)
            rows = Counter(r.component_id == 1 for r in got.collect())
            want = Counter({True: 36_000, False: 4_000})
        assert rows == want
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Chat --------------------------------------------------------------------------------------------

TOOLS = {"find": {"type": "object", "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1}, "after": {"type": "array", "items": {"type": "string"}}}, "required": ["q"], "additionalProperties": False}}


def call(i, **arguments):
    return {"id": i, "name": "find", "arguments": arguments}


def test_tool_calls(spark):
    talk = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": [call("b", q="x", after=["$call:a"]), call("a", q="ü", n=2)]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [1.5, None]}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "first"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "ghost", "content": 1})),
        (1, 6, "tool", "no json"),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("a", n=0), {"name": "other", "arguments": "{}"}, 7]})),
        (3, 0, "assistant", json.dumps({"tool_calls": [call("x", q="$call:y"), call("y", q="$call:x")]})),
        (4, None, None, None),
        (None, 0, "assistant", "{not json"),
        (None, 1, "assistant", "[" * 100000),
        (None, 1, "user", "same"),
        (None, 1, "user", "same"),
    ]
    turns = spark.createDataFrame([(*t, 1, "x") for t in talk], "conv_id long, turn long, role string, text string, level int, json string")
    rows = chat.format_turns(turns, TOOLS).collect()
    by = {(r.conv_id, r.kind, r.call_id): r for r in rows if r.status != "duplicate"}
    assert by[1, "call", "a"].status == by[1, "result", "b"].status == by[1, "result", "a"].status == "linked"
    place = {k: (r.level, r.depth, r.turn, r["sub"]) for k, r in by.items()}
    assert place[1, "call", "a"] < place[1, "result", "a"] < place[1, "call", "b"] < place[1, "result", "b"]
    assert by[1, "result", "ghost"].status == "orphan"
    assert [json.loads(r.json)["content"] for r in rows if r.status == "duplicate"] == ["again"]
    assert by[2, "call", "a"].status == "unanswered"
    assert by[2, "call", "a"].error == "$.q: missing"
    assert {r.error for r in rows if r.conv_id == 2} == {"$.q: missing", "unknown tool", "not a call"}
    assert by[3, "call", "x"].status == by[3, "call", "y"].status == "cyclic"
    assert by[1, "result", "b"].json == '{"content":{"a":[1.5,null],"z":1},"role":"tool","tool_call_id":"b"}'
    assert by[1, "call", "a"].json == '{"role":"assistant","tool_call":{"arguments":{"n":2,"q":"ü"},"id":"a","name":"find"}}'
    assert sum(r.conv_id is None for r in rows) == 4
    whole = {r.conv_id: json.loads(r.json) for r in chat.conversations(chat.format_turns(turns, TOOLS)).collect()}
    assert len(whole[1]) == 9
    parts = {(r.conv_id, r.piece): json.loads(r.json) for r in chat.conversations(chat.format_turns(turns, TOOLS), 4).collect()}
    assert [x for p in range(3) for x in parts[1, p]] == whole[1] and len(parts[1, 2]) == 1
    assert chat.format_turns(turns.limit(0), TOOLS).count() == 0


def test_turns_repeat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "user", "")], "conv_id long, turn long, role string, text string")
    got = Counter((r.kind, r.status, r.valid) for r in chat.format_turns(turns, chat.REPLY, "turns").collect())
    assert got == Counter([("call", "linked", True), ("call", "duplicate", True), ("result", "linked", True), ("result", "orphan", True), ("call", "unanswered", False)])


def test_ranges_of_calls(spark):
    """An outlying turn, or all calls in one turn, leaves ranges of about the size asked for."""
    for turn in (lambda t: 10**9 if t == 399 else t, lambda t: 5):
        calls = spark.createDataFrame([("1", f"{t:04}", turn(t), None) for t in range(400)], "conv string, call_id string, turn long, answered long")
        wants = calls.where("call_id < '0399'").select("conv", "call_id", F.lit("0399").alias("dep"))
        sizes = [r["count"] for r in chat._ranges(wants, calls, 20).groupBy("part").count().collect()]
        assert len(sizes) == 20 and max(sizes) <= 21
    many = [{"id": str(i), "name": "find", "arguments": {"q": f"$call:{i + 1}"}} for i in range(200)]
    turns = spark.createDataFrame([(1, 5, "assistant", json.dumps({"tool_calls": many}))], "conv_id long, turn long, role string, text string")
    rows = {r.call_id: (r.level, r.depth) for r in chat.format_turns(turns, TOOLS, part_calls=80).collect()}
    assert rows == {str(i): (5, 199 - i) for i in range(200)}


@pytest.mark.parametrize("part_calls", [400, 10**6])
def test_long_chains_and_a_cycle(spark, part_calls):
    """Each call of a long conversation refers to the next one; two refer to each other at its end."""
    n = 3000

    def said(t):
        ref = {n - 1: n - 2}.get(t, t + 1)
        return json.dumps({"tool_calls": [{"id": str(t), "name": "find", "arguments": {"q": f"$call:{ref}"}}]})

    chain = [(1, t, "assistant", json.dumps({"tool_calls": [{"id": str(t), "name": "find", "arguments": {"q": f"$call:{t + 1}"}}]})) for t in range(n)]
    cycle = [(2, t, "assistant", said(t)) for t in range(n - 40, n)]
    turns = spark.createDataFrame([*chain, *cycle], "conv_id long, turn long, role string, text string")
    rows = {(r.conv_id, r.turn): r for r in chat.format_turns(turns, TOOLS, part_calls=part_calls).collect()}
    # The last of the chain refers to a call that is not there, so it waits for nothing.
    assert all((rows[1, t].level, rows[1, t].depth) == (n - 1, n - 1 - t) for t in range(n))
    assert all(rows[2, t].status == "cyclic" and rows[2, t].depth == 0 for t in range(n - 40, n))


def test_schemas():
    assert chat.schema_error({"a": [1, True]}, {"properties": {"a": {"type": "array", "items": {"type": "integer"}}}}) == "$.a[1]: not of type integer"
    assert chat.schema_error(5, {"enum": [1, 2]}) == "$: not in enum"
    assert chat.schema_error(5, {"type": "number", "maximum": 4}) == "$: range"
    assert chat.schema_error({"x": None}, {"type": "object"}) is None
    assert chat.canonical({"b": "\ud800", "a": "é\n"}) == '{"a":"é\\n","b":"?"}'


# Pipeline ----------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    from marlstone.llm import bestfit_packing, language_id, quality_classifier
    from marlstone.llm.runtime import materialize
    from tests.llm.test_documents import bare, similar_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF), name)
        assert after.dtypes == docs.dtypes
        kept[name] = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in after.collect()}
        if name == "language_id":
            want = {r.doc_id for r in language_id.identify(docs).where("not rejected").collect()}
            assert kept[name][1] == want
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert kept[name][1] == {r.doc_id for r in quality_classifier.grade(docs, labels).where("selected").collect()}
        if name == "exact_dedup":
            groups = defaultdict(list)
            for i, t in kept[name][0].items():
                groups[bare(t)].append((-len(t), i))
            assert kept[name][1] == {min(g)[1] for g in groups.values()}
        if name == "simhash_neardup":
            before = sorted(kept[name][0].items())
            assert kept[name][1] == {before[i][0] for i in similar_components([t for _, t in before])}
        docs = after
    pieces = {(r.doc_id, r.piece, r.ids_crc32) for r in bestfit_packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json")).collect()}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == pieces
    assert {p[0] for p in pieces} == kept["simhash_neardup"][1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits long, rejected string, signature int, place int, length string"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and columns with the operators' own names."""
    rng = random.Random(21)
    words = ["".join(rng.choices("aeiounstrl", k=rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(30, 80))) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=40)) for _ in range(60)]
    rows = [*enumerate(texts), *((200 + i, t) for i, t in enumerate(bad))]
    long = " ".join(rng.choices(words, k=60_000))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "12 34 ½"), (None, " ".join(rng.choices(words, k=50))), (304, long), (0, texts[0]), (0, texts[0]), (305, texts[1] + " "), (306, long + " more")]
    docs = spark.createDataFrame([(i, t, "xx", "s", 1, 2, "r", 3, 4, "y") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows[:180]], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = Counter(r.doc_id for r in got if r.piece == 0)
    assert set(kept.values()) == {1}
    assert set(kept).isdisjoint({300, 301, 302, 303, 306, *range(200, 260)})
    # Of texts that are equal but for space the longest stays; long ones are packed whole.
    assert {0, 305, 304, None} <= set(kept) and 1 not in kept
    assert len(kept) >= 118
    assert sum(r.length for r in got if r.doc_id == 304) > 60_000
    for name, df in (("documents", docs), ("labels", labels)):
        df.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_random_links_stay_whole(spark):
    """Turns of random conversations link as a plain reading says."""
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["", "x", None])) for c in range(30) for t in range(rng.randint(1, 9))]
    at = {(c, t): role for c, t, role, _ in rows}
    want = Counter()
    for c, t, role, _ in rows:
        other = {"user": (t + 1, "assistant"), "assistant": (t - 1, "user")}.get(role)
        want["message" if other is None else "linked" if at.get((c, other[0])) == other[1] else "unanswered" if role == "user" else "orphan"] += 1
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(r.status for r in chat.format_turns(df, chat.REPLY, "turns").collect()) == want
