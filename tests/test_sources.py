"""Readers, writers, streams, the engine and the registered queries."""

import json
import mimetypes
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from marlstone import engine
from marlstone.functions import media, names
from marlstone.operators import qc, reports
from marlstone.sources import readers, writers
from marlstone.streaming import ingest

#: How a failed job is raised differs with where it fails.
FAILURES = (PySparkException, Py4JJavaError)


def put(folder, name, *rows, bom=False):
    folder.mkdir(parents=True, exist_ok=True)
    text = "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows)
    (folder / name).write_text(("﻿\n" if bom else "") + text, encoding="utf-8")


def test_page_files(spark, tmp_path):
    put(tmp_path / "a", "One Book.jsonl", {"page": "3", "content": " Hi "}, "", {"page_num": 0, "pdf_page": 4, "text": "x"}, {"page": 5, "text": " "}, {"text": "no number"})
    put(tmp_path / "b" / "c", "z.jsonl", {"doc_id": "D", "title": "T", "filename": "f.pdf", "pages": [{"page_no": 1, "text": "p1"}, {"title": "Own", "items": [{"page_number": 2, "page_text": "p2"}]}]})
    rows = {(r.doc_id, r.title, r.source_pdf, r.page_num, r.text) for r in readers.read_pages(spark, str(tmp_path)).collect()}
    assert rows == {
        ("one_20book", "One%20Book", "One%20Book.pdf", 3, "Hi"), ("one_20book", "One%20Book", "One%20Book.pdf", 4, "x"), ("D", "T", "f.pdf", 1, "p1"), ("D", "Own", "f.pdf", 2, "p2"),
    } or rows == {("one_book", "One Book", "One Book.pdf", 3, "Hi"), ("one_book", "One Book", "One Book.pdf", 4, "x"), ("D", "T", "f.pdf", 1, "p1"), ("D", "Own", "f.pdf", 2, "p2")}


def test_bad_lines_stop(spark, tmp_path):
    put(tmp_path, "x.jsonl", {"page": 1, "text": "a"}, "{broken")
    with pytest.raises(FAILURES):
        readers.read_pages(spark, str(tmp_path)).collect()


def test_lines_are_numbered_over_the_parts_of_files(spark, tmp_path):
    """Files that several tasks read in parts: numbers are those of the file, and errors name them."""
    lines = [json.dumps({"chunk_id": str(i % 7), "source_pdf": "f.pdf", "text": f"{i} " + "x" * (i % 50)}) for i in range(400)]
    put(tmp_path / "c", "a.jsonl", "", *lines[:150], bom=True)
    put(tmp_path / "c", "b.jsonl", *lines[150:300], "", " ", *lines[300:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
    try:
        rows = readers.raw_lines(spark, str(tmp_path / "c"))
        assert rows.rdd.getNumPartitions() > 5
        got = {r._file.rsplit("/", 1)[1][0] + str(r._line): r.value for r in rows.collect()}
        want = {f"a{i + 3}": x for i, x in enumerate(lines[:150])} | {f"b{i + 1}": x for i, x in enumerate(lines[150:300])} | {f"b{i + 153}": x for i, x in enumerate(lines[300:])}
        assert got == want
        last = {r.chunk_id: int(r.text.split()[0]) for r in readers.last_by_id(readers.read_chunks(spark, str(tmp_path / "c"))).collect()}
        assert last == {str(i % 7): i for i in range(393, 400)}
        put(tmp_path / "bad", "c.jsonl", *lines[:200], '{"text": ', *lines[200:])
        with pytest.raises(FAILURES, match=r"c\.jsonl:201: no JSON"):
            readers.read_chunks(spark, str(tmp_path / "bad")).select("chunk_id").collect()
        with pytest.raises(FAILURES, match=r"c\.jsonl:201: "):
            readers.read_pages(spark, str(tmp_path / "bad")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["a.pdf", "A.PDF", "b.tar.gz", "b.tgz", "c.TGZ", "d.txt.gz", "e.svgz", ".bashrc", "..x", "noext", "f.", "g.docx", "h.unknown", "i.jpeg", "j.md", "k.html", "l.tar.Z", "m.gz"])
def test_media_types(spark, name):
    want = mimetypes.MimeTypes().guess_type(name)[0] or "application/octet-stream"
    row = spark.createDataFrame([(f"/some.dir/{name}",)], "path string").select(media.mime(F.col("path")).alias("mime"), media.suffix(names.basename(F.col("path"))).alias("suffix")).first()
    assert (row.mime, row.suffix) == (want, "" if name == "f." else os.path.splitext(name)[1])


def test_reports(spark, tmp_path):
    docs = spark.createDataFrame([("b",), ("a",), ("a",)], "doc_id string")
    repeated = spark.createDataFrame([("a", "z", "header"), ("a", "c", "header")], "doc_id string, line string, kind string")
    writers.write_report(reports.header_report(docs, repeated), str(tmp_path / "r"))
    written = "".join(f.read_text() for f in sorted((tmp_path / "r").glob("part-*.txt"))).split("\n")
    rule = "=" * 120
    assert written == [rule, "Файл: a", "Headers найдено: 2", "[HEADER] c", "[HEADER] z", "Footers найдено: 0", "[FOOTER] нет", "", rule, "Файл: b", "Headers найдено: 0", "[HEADER] нет", "Footers найдено: 0", "[FOOTER] нет", "", ""]
    pages = spark.createDataFrame([("d", 1, None), ("d", 2, "hello there")], "doc_id string, page_num int, text string")
    lines = [r.line for r in reports.sample_report(qc.samples(pages)).orderBy("at").collect()]
    assert lines[:7] == [rule, "Файл: d", "Всего страниц: 2", "", "[НАЧАЛО]", "Страница: 2", "Фрагмент: hello there"]
    assert lines[-2:] == ["Статус: текст найден в начале, середине и конце документа.", ""]


def test_chunks_registry_graph_gold(spark, tmp_path):
    put(tmp_path / "c", "c.jsonl", {"chunk_id": "1", "source_pdf": "d/f.pdf", "page_num": 2, "text": "old"}, {"chunk_id": "1", "source_pdf": "f.pdf", "page_start": 3, "text": "new"}, {"chunk_id": "2", "text": " "}, {"text": "nameless"})
    chunks = readers.read_chunks(spark, str(tmp_path / "c"))
    assert {(r.chunk_id, r.doc_id, r.title, r.page_start, r.text) for r in chunks.collect()} == {("1", "f", "f", 2, "old"), ("1", "f", "f", 3, "new"), (None, None, None, None, "nameless")}
    assert [r.text for r in readers.last_by_id(chunks).collect()] == ["new"]
    with pytest.raises(FAILURES, match="no source"):
        readers.require_sources(chunks).collect()
    put(tmp_path / "r", "sources.jsonl", {"file": "a.pdf", "bucket": "b", "key": "k", "sha256": "s"}, bom=True)
    row = readers.read_registry(spark, str(tmp_path / "r")).first()
    assert (row.filename, row.s3_bucket, row.s3_key, row.sha256) == ("a.pdf", "b", "k", "s")
    put(tmp_path / "g", "graph.jsonl", {"chunk_id": "1", "neighbors": ["2", " ", None]}, {"chunk_id": " ", "neighbors": []}, {"chunk_id": "3"})
    assert {r.chunk_id: r.neighbors for r in readers.read_graph(spark, str(tmp_path / "g")).collect()} == {"1": ["2"], "3": []}
    put(tmp_path / "q", "gold.jsonl", {"question_id": "old", "source_filename": "f.pdf", "source_pages": [1, 2]}, {"question_id": "new", "answerable": True, "primary_reference": {"source_filename": "g.pdf"}})
    gold = {r.question_id: r for r in readers.read_gold(spark, str(tmp_path / "q")).collect()}
    assert (gold["old"].primary_reference.source_pages, gold["old"].answerable) == ([1, 2], False)
    assert gold["new"].primary_reference.source_filename == "g.pdf"


def test_latest_run_and_files(spark, tmp_path):
    import os

    for i, n in enumerate(["baseline_1.jsonl", "baseline_2.jsonl", "baseline_3.analysis.jsonl", "other.jsonl"]):
        put(tmp_path, n, {"a": i})
        os.utime(tmp_path / n, (1000 + i, 1000 + i))
    assert readers.latest_file(spark, str(tmp_path)).endswith("baseline_2.jsonl")
    assert readers.read_files(spark, str(tmp_path)).count() == 4


def test_documents_are_replaced(spark, tmp_path):
    out = str(tmp_path / "t")
    writers.write_by_document(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int"), out)
    writers.write_by_document(spark.createDataFrame([("b", 2), ("c", 2)], "doc_id string, v int"), out)
    assert {(r.doc_id, r.v) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    writers.append_json(spark.range(2), str(tmp_path / "log"))
    writers.append_json(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    writers.write_csv(spark.createDataFrame([('say "x"\n', None)], "a string, b string"), str(tmp_path / "csv"))
    assert '"say ""x""\n"' in next((tmp_path / "csv").glob("*.csv")).read_text()
    assert spark.read.json(writers.write_manifest(spark, str(tmp_path), "run", {"k": "5"})).first().config.k == "5"


def test_streams(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(source)
    ingest.dedupe_into(spark, source, "doc_id long, text string", out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(4, "a"), (5, "b")], "doc_id long, text string").write.mode("append").parquet(source)
    ingest.dedupe_into(spark, source, "doc_id long, text string", out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    ingest.replace_documents(stream, str(tmp_path / "docs"), str(tmp_path / "state2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 5


def test_engine(spark, tmp_path):
    pages = spark.createDataFrame(
        [("d", "Title", "d.pdf", 1, "The red fox runs. It is fast."), ("d", "Title", "d.pdf", 2, "The blue whale swims."), ("e", "Other", "e.pdf", 1, "A fox and a whale meet.")],
        "doc_id string, title string, source_pdf string, page_num int, text string",
    )
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "d_p0001_c001"), (2, [0.0, 1.0], "d_p0002_c001"), (3, [1.0, 1.0], "e_p0001_c001")], "vec_id long, embedding array<float>, chunk_id string")
    engine.save(engine.build_index(pages, vectors), str(tmp_path / "i"))
    index = engine.load(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "red fox", [1.0, 0.1]), (2, "nothing", None)], "query_id long, query string, embedding array<float>")
    found = {m: [r.chunk_id for r in engine.search(index, asked, m, 2).where("query_id = 1").orderBy("rank").collect()] for m in engine.MODES}
    assert found["sparse"] == found["dense"] == found["hybrid"] == ["d_p0001_c001", "e_p0001_c001"]
    assert found["graph"][0] == "d_p0001_c001"
    rows = {r.query_id: r for r in engine.ask(index, asked, "hybrid", 2).collect()}
    assert rows[1].answer.startswith("The red fox runs. [1]")
    assert rows[2].retrieved == 0
    with pytest.raises(ValueError, match="unknown mode"):
        engine.search(index, asked, "magic")
    with pytest.raises(ValueError, match="needs vectors"):
        engine.search(engine.load(spark, str(tmp_path / "i"), with_vectors=False), asked, "dense")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scratch_is_cleared():
    import subprocess
    import sys

    code = "from marlstone.session import local_session; from marlstone import scratch; s = local_session(1); d = scratch.materialize(s.range(3), 'x'); assert d.count() == 3; assert scratch.clear(s); assert not scratch.clear(s)"
    root = str(__import__("pathlib").Path(engine.__file__).parents[1])
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)


def test_plans_push_down(spark):
    """Columns that a query does not need are not read; few queries are broadcast."""
    plan = __spark_entry__.queries()["bm25_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan
    assert "WindowGroupLimit" in plan or "TakeOrdered" in plan


def test_everything_runs_without_the_optional_parts(tmp_path):
    """Nothing outside of llm imports it, and without it the other queries are there and run."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(engine.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "marlstone.llm" not in f.read_text(), f
    shutil.copytree(root, tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root.parent / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root.parent / "__spark_entry__.py", tmp_path)
    code = (
        "import __spark_entry__ as e; from marlstone.session import local_session; s = local_session(2, partitions=2); q = e.queries(); "
        "assert len(q) > 40 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q); "
        "assert q['bm25_topk'](s, '/root/testdata/sf0.001').count() == 20 and q['cleaned_pages'](s, '/root/testdata/sf0.001').count() == 200"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=300)
