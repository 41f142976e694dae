"""Model hooks, commands, ordered sinks and the other edges of the engine."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone import __main__ as shell
from marlstone.operators import models, resume, transcripts
from marlstone.settings import Settings
from marlstone.sources import readers, writers

FAILURES = (PySparkException, Py4JJavaError)


def count_letters(texts):
    return [[float(t.count(c)) for c in "abc"] for t in texts]


def echo(messages):
    return f"{messages[0]['content']} | {messages[1]['content'].splitlines()[1]} [1]"


def put(folder, name, *rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")


def test_embeddings_come_in_batches(spark):
    rows = spark.createDataFrame([(i, "ab" * i, 1) for i in range(40)], "id long, text string, embedding int")
    got = models.embedded(rows, count_letters, dims=3).collect()
    assert all(r.embedding == [r.id, r.id, 0.0] for r in got)
    with pytest.raises(FAILURES, match="not of length"):
        models.embedded(rows, count_letters, dims=4).collect()
    with pytest.raises(FAILURES, match="another number"):
        models.embedded(rows, lambda texts: []).collect()


def test_prompts(spark, tmp_path):
    (tmp_path / "system.txt").write_text("\nUse {n_sources} sources.\n")
    system = models.load_prompt(spark, str(tmp_path / "system.txt"))
    said = models.messages("q?", "ctx", 3, system, "Cite.", True)
    assert said[0]["content"] == "Use 3 sources.\n\nCite.\n\nLANGUAGE RULE: answer strictly in Russian only."
    assert said[1]["content"].startswith("ВОПРОС:\nq?\n\nИСТОЧНИКИ:\nctx")
    assert models.prompted(echo, system, "Cite.")("q?", "ctx", 2, False) == "Use 2 sources. | q? [1]"


def test_pages_to_any_depth(spark, tmp_path):
    deep = {"filename": "f.pdf", "pages": [{"title": "T", "items": [{"records": [{"pages": [{"page": 9, "text": "deep"}]}, {"page": 2, "text": " x "}]}]}, "no page", {"page": "0", "text": "y"}, {"page": 1}]}
    put(tmp_path / "a", "x.jsonl", deep)
    (tmp_path / "a" / "y.json").write_text(json.dumps([{"page": 1, "text": "whole"}], indent=1))
    rows = {(r.doc_id, r.title, r.source_pdf, r.page_num, r.text) for r in readers.read_pages(spark, str(tmp_path / "a")).collect()}
    assert rows == {("f", "T", "f.pdf", 9, "deep"), ("f", "T", "f.pdf", 2, "x"), ("y", "y", "y.pdf", 1, "whole")}
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_pages(spark, str(tmp_path / "none"))


def test_documents_by_an_extractor(spark, tmp_path):
    (tmp_path / "One Book.pdf").write_bytes(b"p1\x0cp2")
    (tmp_path / "broken.pdf").write_bytes(b"\xff")
    rows = readers.read_documents(spark, str(tmp_path), lambda data: data.decode().split("\x0c")).collect()
    assert sorted((r.page_num, r.text) for r in rows) == [(1, "p1"), (2, "p2")]


def test_sinks_are_ordered(spark, tmp_path):
    pages = spark.createDataFrame([(d, p, f"{d}{p}") for d in "cab" for p in (11, 2, 30)], "doc_id string, page_num int, text string").repartition(3)
    writers.write_pages(pages, str(tmp_path / "p"))
    lines = [json.loads(x) for f in sorted((tmp_path / "p").glob("part*")) for x in f.read_text().splitlines()]
    assert [(r["doc_id"], r["page_num"]) for r in lines] == [(d, p) for d in "abc" for p in (2, 11, 30)]
    chunks = spark.createDataFrame([("f", None, 1, 2, "b"), ("f", 3, None, None, "d"), ("f", None, 1, 1, "c"), ("a", 9, None, 1, "z")], "source_pdf string, page_start int, page_num int, chunk_index int, chunk_id string")
    writers.write_chunks(chunks, str(tmp_path / "c"))
    lines = [json.loads(x)["chunk_id"] for f in sorted((tmp_path / "c").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == ["z", "c", "b", "d"]


def test_vectors_of_a_wrong_length_stop(spark, tmp_path):
    path = str(tmp_path / "i")
    writers.create_index_table(spark, path, 2)
    good = spark.createDataFrame([("p", "s", "c", [1.0, 2.0])], writers.VECTOR)
    writers.append_vectors(good, path)
    assert spark.read.schema(writers.VECTOR).parquet(f"{path}/vectors").count() == 1
    with pytest.raises(FAILURES, match="no vector of length 2"):
        writers.append_vectors(good.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), path)
    assert writers.drop_index_table(spark, path)
    assert not writers.drop_index_table(spark, path)


def test_sources_are_uploaded_once(spark, tmp_path):
    files, registry, objects = tmp_path / "f", str(tmp_path / "r"), str(tmp_path / "o")
    files.mkdir()
    (files / "a.pdf").write_bytes(b"A")
    (files / "copy.pdf").write_bytes(b"A")
    assert readers.read_registry(spark, registry).count() == 0
    assert writers.upload_sources(spark, str(files), objects, registry, "b") == 1
    (files / "b.txt").write_bytes(b"B")
    assert writers.upload_sources(spark, str(files), objects, registry, "b") == 1
    assert writers.upload_sources(spark, str(files), objects, registry, "b") == 0
    rows = {r.sha256: r.s3_key for r in readers.read_registry(spark, registry).collect()}
    assert sorted(k[-4:] for k in rows.values()) == [".pdf", ".txt"]
    assert {bytes(r.content) for r in spark.read.parquet(f"{objects}/b").collect()} == {b"A", b"B"}


def test_commands(spark, tmp_path, monkeypatch, capsys):
    put(tmp_path / "pages", "book.jsonl", {"page": 1, "text": "The aaa fox runs."}, {"page": 2, "text": "The bbb whale swims."})
    monkeypatch.setattr(shell, "local_session", lambda: spark)
    for name, value in {"EMBED": "tests.test_surface:count_letters", "CHAT": "tests.test_surface:echo", "LOGS": str(tmp_path / "logs"), "REGISTRY": str(tmp_path / "none"), "DIMS": "3"}.items():
        monkeypatch.setenv(f"MARLSTONE_{name}", value)
    index = str(tmp_path / "i")
    assert shell.main(["build", str(tmp_path / "pages"), index]) == 0
    for mode in ("sparse", "dense", "hybrid", "graph"):
        assert shell.main(["search", index, "bbb", "--mode", mode, "--k", "2"]) == 0
        assert "whale" in capsys.readouterr().out
    assert shell.main(["ask-log", index, "bbb?", "--mode", "dense"]) == 0
    assert "bbb?" in capsys.readouterr().out
    assert shell.main(["search-log", index, "bbb"]) == 0
    log = spark.read.json(f"{tmp_path}/logs/answers").first()
    assert (log.question, log.k, log.config.mode) == ("bbb?", 5, "dense")
    assert spark.read.json(f"{tmp_path}/logs/searches").first().chunks[0].chunk_id == "book_p0002_c001"
    put(tmp_path / "chunks", "c.jsonl", {"chunk_id": "1", "source_pdf": "f.pdf", "page_num": 2, "chunk_index": 1, "text": "a chunk of ccc"})
    assert shell.main(["ingest-chunks", str(tmp_path / "chunks"), f"{index}2"]) == 0
    assert shell.main(["search", f"{index}2", "ccc"]) == 0
    assert shell.main(["save-manifest", str(tmp_path), "run"]) == 0
    assert shell.main(["create-index", f"{index}3"]) == shell.main(["drop-index", f"{index}3"]) == 0


def test_settings():
    s = Settings.load({"MARLSTONE_K": "7", "MARLSTONE_MODE": "graph", "OTHER": "x"})
    assert (s.k, s.mode, s.bucket) == (7, "graph", "sources")


def plain_parts(text, limit):
    out = []
    while len(text) > limit:
        at = max((i for i in range(1, limit) if text[i] == "\n"), default=limit)
        out, text = [*out, text[:at].strip()], text[at:].strip()
    return [*out, text] if text else out


@pytest.mark.parametrize("text", ["", " ", " hi ", "   " + "a" * 39, "a\nb\n" * 30, "\n" * 50 + "x", "x" * 101, "word " * 40, "a" * 40 + "\n" + "b" * 40 + " \n ", "\n" + "c" * 45])
def test_messages_are_cut(text):
    assert transcripts.cut_message(text, 40) == plain_parts(text, 40)


def test_full_records(spark):
    from marlstone.operators import evaluate

    ref = "struct<source_filename:string,source_pages:array<int>,gold_answer:string>"
    gold = spark.createDataFrame(
        [("1", " What ", True, ("F.pdf", [1, 2], "a"), [("g.pdf", [9], None)], "n"), ("2", " ", False, ("x.pdf", [1], None), None, None)],
        f"question_id string, question string, answerable boolean, primary_reference {ref}, alternative_references array<{ref}>, comment string",
    )
    runs = spark.createDataFrame(
        [("1", "ok", "Yes [1][2].", [(1, "f.pdf", [2]), (2, "dir/G.PDF", [9]), (3, "f.pdf", [1])], 1.5, ["run", "x"], "out"), ("2", "ok", "", [], None, None, None)],
        "question_id string, status string, model_answer string, sources array<struct<index:int,filename:string,page_numbers:array<int>>>, duration_sec double, command array<string>, stdout string",
    )
    rows = {r.question_id: r for r in evaluate.full_records(gold, runs, "run7").collect()}
    assert len(rows["1"]) == 47
    one = rows["1"]
    assert (one.run_id, one.question, one.notes, one.command_str, one.stdout_raw, one.stderr_raw) == ("run7", "What", "n", "run x", "out", None)
    assert (one.cited_source_indexes_all, one.cited_source_indexes_gold_doc, one.cited_source_indexes_any_gold) == ([1, 2], [1], [1, 2])
    assert (one.cited_source_filenames_all, one.cited_source_filenames_gold_doc, len(one.debug_all_filenames)) == (["f.pdf", "dir/G.PDF"], ["f.pdf"], 3)
    assert [(r.ref_kind, r.source_filename, r.gold_answer) for r in one.gold_references] == [("primary", "F.pdf", "a"), ("alternative", "g.pdf", "")]
    assert [r.ref_kind for r in one.matched_gold_references] == ["primary", "alternative"]
    assert (one.page_hit, one.all_gold_pages_covered, one.all_gold_pages_covered_any) == (True, False, True)
    assert (rows["2"].status, rows["2"].matched_gold_references) == ("invalid_input", [])


def test_signed_links(spark):
    def sign(bucket, key):
        if key == "lost":
            raise OSError("away")
        return f"https://{bucket}/{key}?signed"

    hits = spark.createDataFrame([(1, "b", "k.pdf", 3), (2, "b", "lost", 1), (3, None, None, 1), (4, "b", "k.pdf", None)], "rank int, s3_bucket string, s3_key string, page_start int")
    got = {r.rank: r.url for r in models.signed_links(hits, sign).collect()}
    assert got == {1: "https://b/k.pdf?signed#page=3&zoom=page-fit", 2: "", 3: "", 4: "https://b/k.pdf?signed"}


def test_commands_answer_questions(spark):
    import sys

    code = "import sys, time; q = sys.argv[1]; time.sleep(9 * (q == 'slow')); print('Answer:', q); sys.exit(q == 'bad')"
    asked = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "slow"), ("4", " ")], "question_id string, question string")
    rows = {r.question_id: r for r in models.asked_by_command(asked, [sys.executable, "-c", code], 3.0).collect()}
    assert [rows[i].status for i in "1234"] == ["ok", "cli_error", "timeout", "invalid_input"]
    assert (rows["1"].stdout, rows["2"].returncode, rows["3"].duration_sec >= 3) == ("Answer: good\n", 1, True)
    assert {r.question_id: r.model_answer for r in transcripts.parse(spark.createDataFrame([("1", rows["1"].stdout)], "question_id string, stdout string")).collect()} == {"1": "good"}


def test_calls_are_tried_again():
    def flaky(errors):
        def call(x):
            if errors:
                raise errors.pop(0)
            return x + 1

        return call

    soon = resume.Retry(attempts=3, first_wait=0.001, per_second=1000)
    assert resume.retried(flaky([TimeoutError(), ConnectionError()]), soon)(1) == 2
    with pytest.raises(TimeoutError):
        resume.retried(flaky([TimeoutError()] * 3), soon)(1)
    wrong = [ValueError(), ValueError()]
    with pytest.raises(ValueError):
        resume.retried(flaky(wrong), soon)(1)
    assert len(wrong) == 1  # errors of other kinds aren't tried again


def test_lost_runs_go_on(spark, tmp_path):
    """A run that is lost in its second batch, then one that ends: each question is asked once, but for
    those of the batch that was lost and those that failed."""
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    (tmp_path / "down").touch()
    asked = spark.createDataFrame([(str(i), f"q{i % 30}") for i in range(40)] + [("n", None), ("e", "")], "question_id string, question string")

    def model(question, attempt):
        import uuid

        (calls / f"{question}-{attempt}-{uuid.uuid4().hex}").touch()
        if len(list(calls.iterdir())) > 20 and (tmp_path / "down").exists():
            raise RuntimeError("lost")
        return "timeout" if question == "q3" and attempt == 1 else "error" if question == "q4" else "ok"

    def ask(part):
        def run(frames):
            for f in frames:
                f = f[f.question != "q5"]
                yield f.assign(status=[model(q, a) for q, a in zip(f.question, f.attempt, strict=True)])[["question_id", "status"]]

        return part.mapInPandas(run, "question_id string, status string")

    with pytest.raises(FAILURES, match="lost"):
        resume.answered(asked, ask, ledger, batch_questions=8, attempts=2)
    kept = spark.read.parquet(ledger).count()
    assert 0 < kept < 31
    (tmp_path / "down").unlink()
    before = len(list(calls.iterdir()))
    rows = resume.answered(asked, ask, ledger, batch_questions=8, attempts=2).collect()
    assert len(list(calls.iterdir())) - before <= 31 - kept + 2
    got = {r.question_id: (r.status, r.attempt) for r in rows}
    assert len(rows) == 42 and got["3"] == got["33"] == ("ok", 2) and got["4"] == ("error", 2) and got["5"] == (None, 2)
    assert all(v == ("ok", 1) for k, v in got.items() if k not in ("3", "33", "4", "34", "5", "35"))
    before = len(list(calls.iterdir()))
    assert {(r.question_id, r.status) for r in resume.answered(asked, ask, ledger, attempts=2).collect()} == {(k, v[0]) for k, v in got.items()}
    assert len(list(calls.iterdir())) == before  # nothing is left to ask
    assert resume.answered(asked.where("false"), ask, str(tmp_path / "none")).count() == 0
