"""The jobs: growing input, runs that fail and are repeated, and odd rows."""

import hashlib
import json
import pathlib
import types
from collections import Counter

import pytest

from jobs import ingest_passages as ingest
from jobs import prepare_corpus as prepare
from jobs import settings
from marlstone.operators.chunk import page_chunks

SCHEMA = "doc_id long, text string, source string, batch string, sha256 string, page_num string"
PROSE = "One sentence stands here. Another one follows it, and ends. " * 40


def put(spark, folder, *rows):
    """One more file of documents, with columns whose names clash with the job's own."""
    spark.createDataFrame([(i, t, s, "b", "x", "p") for i, t, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def cut(*texts, size=900):
    return Counter((f"{digest(t)[:16]}_{i:04d}", digest(t), i, c, len(c)) for t in set(texts) for i, c in enumerate(page_chunks(t or "", size), 1))


def held(df):
    return Counter(tuple(r) for r in df.select("passage_id", "sha256", "chunk_index", "text", "chars").collect())


def test_only_new_files_are_taken(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    put(spark, source, (1, PROSE, "a"), (2, "short", "a"), (3, "short", "b"), (4, None, None), (None, " \n", "c"))
    assert held(ingest.ingest_passages(spark, source, store)) == cut(PROSE, "short")
    put(spark, source, (5, "short", "a"), (6, "quite new", "a"), (6, "quite new", "a"))
    put(spark, source, (1, PROSE, "a"))
    grown = ingest.ingest_passages(spark, source, store)
    assert held(grown) == cut(PROSE, "short", "quite new")
    assert {r.batch for r in grown.where("text in ('short')").collect()} == {0}  # not cut again
    registry = spark.read.parquet(f"{store}/registry")
    assert {r.batch: r["count"] for r in registry.groupBy("batch").count().collect()} == {0: 5, 1: 4}
    files = sorted(grown.inputFiles())
    again = ingest.ingest_passages(spark, source, store)
    assert held(again) == held(grown) and sorted(again.inputFiles()) == files
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_files_come_in_batches(spark, tmp_path):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    for i in range(4):
        put(spark, source, (i, f"text {i % 3}", "a"), (10 + i, f"own {i}", "a"))
    out = ingest.ingest_passages(spark, source, store, f"{tmp_path}/mark", files_per_batch=1, size="900")
    assert held(out) == cut(*(f"text {i}" for i in range(3)), *(f"own {i}" for i in range(4)))
    assert spark.read.parquet(f"{store}/registry").select("batch").distinct().count() == 4


def test_a_failed_batch_is_taken_again_whole(spark, tmp_path, monkeypatch):
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    put(spark, source, (1, "first", "a"))
    ingest.ingest_passages(spark, source, store)
    put(spark, source, (2, "second", "a"), (3, "first", "a"))
    take = ingest.take

    def broken(session, rows, number, store, size):
        take(session, rows, number, store, size)
        raise RuntimeError("lost after it wrote")

    with monkeypatch.context() as m:
        m.setattr(ingest, "take", broken)
        with pytest.raises(Exception, match="lost after it wrote"):
            ingest.ingest_passages(spark, source, store)
    assert held(ingest.ingest_passages(spark, source, store)) == cut("first", "second")
    assert spark.read.parquet(f"{store}/registry").count() == 3


def test_a_batch_twice_is_a_batch_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, PROSE, "a"), (2, PROSE, "a")], "doc_id long, text string, source string")
    for _ in range(2):
        ingest.take(spark, rows, 0, str(tmp_path), 900)
    assert held(spark.read.schema(ingest.PASSAGES).parquet(f"{tmp_path}/passages")) == cut(PROSE)


def test_nothing_to_ingest(spark, tmp_path):
    put(spark, f"{tmp_path}/in")
    assert held(ingest.ingest_passages(spark, f"{tmp_path}/in", f"{tmp_path}/store")) == Counter()


def pages_of(*texts, source="a", start=0):
    return [(start + i, t, source) for i, t in enumerate(texts)]


def listed(df):
    return Counter(tuple(r) for r in df.select("doc_id", "page_num", "chunk_index", "text").collect())


def test_prepared_corpus(spark, tmp_path):
    source, corpus = f"{tmp_path}/in", f"{tmp_path}/corpus"
    body = ["\n".join(["HEAD OF BOOK", *(f"line {'x' * (9 * i + j)} of this page" for j in range(8))]) for i in range(1, 6)]
    put(spark, source, *pages_of(*body), *pages_of(None, "", " \n", source="empty", start=50), (90, "lost", None), (91, "alone on its page", "b"))
    chunks = prepare.prepare_corpus(spark, source, corpus)
    got = listed(chunks)
    assert {r[0] for r in got} == {"a", "b"} and all("HEAD" not in r[3] for r in got) and len(got) == 6
    report = {r.doc_id: r for r in spark.read.json(f"{corpus}/report").collect()}
    assert (report["a"].chunks, report["a"].total_pages, report["a"].dropped_lines) == (5, 5, 5)
    assert (report["empty"].chunks, report["empty"].status, report["b"].text_pages) == (0, "bad", 1)
    assert spark.read.parquet(f"{corpus}/pages").count() == 9
    assert listed(prepare.prepare_corpus(spark, source, corpus)) == got  # again, the same


def test_some_sources_are_prepared_again(spark, tmp_path):
    corpus = f"{tmp_path}/corpus"
    put(spark, f"{tmp_path}/one", *pages_of("old text", "older text"), *pages_of("stays as it is", source="b", start=9))
    prepare.prepare_corpus(spark, f"{tmp_path}/one", corpus)
    put(spark, f"{tmp_path}/two", *pages_of("new text"), *pages_of("must not be read", source="b", start=9))
    got = listed(prepare.prepare_corpus(spark, f"{tmp_path}/two", corpus, sources="a"))
    assert got == Counter([("a", 1, 1, "new text"), ("b", 1, 1, "stays as it is")])
    put(spark, f"{tmp_path}/three", *pages_of(None))  # now without text: its chunks go
    assert listed(prepare.prepare_corpus(spark, f"{tmp_path}/three", corpus)) == Counter([("b", 1, 1, "stays as it is")])


def test_no_documents(spark, tmp_path):
    put(spark, f"{tmp_path}/in")
    assert prepare.prepare_corpus(spark, f"{tmp_path}/in", f"{tmp_path}/corpus").collect() == []


def test_settings_are_restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), settings.conf(spark, spark__sql__shuffle__partitions="3", spark__marlstone__x="1"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.marlstone.x", None) is None


def test_command_line(tmp_path, monkeypatch):
    """The file's settings, those of the command line before them; the session is stopped."""
    seen, session = {}, types.SimpleNamespace(stop=lambda: seen.setdefault("stopped", True))
    builder = types.SimpleNamespace(appName=lambda _: builder, config=lambda *_: builder, getOrCreate=lambda: session)
    monkeypatch.setattr(settings, "SparkSession", types.SimpleNamespace(builder=builder))
    (tmp_path / "c.json").write_text(json.dumps({"documents": "d", "store": "s"}), encoding="utf-8")

    def job(spark, **given):
        seen.update(given)

    settings.main(job, "doc", [f"{tmp_path}/c.json", "store=elsewhere"])
    assert seen == {"documents": "d", "store": "elsewhere", "stopped": True}


JOBS = pathlib.Path(settings.__file__).parent


def test_shipped_settings_fit_the_jobs():
    for job in (ingest.ingest_passages, prepare.prepare_corpus):
        given = json.loads((JOBS / f"config/{job.__name__}.json").read_text(encoding="utf-8"))
        assert set(given) <= set(job.__code__.co_varnames[: job.__code__.co_argcount])


def test_jobs_use_no_optional_part():
    for f in JOBS.glob("*.py"):
        assert "marlstone.llm" not in f.read_text(encoding="utf-8") and "corpus_pipeline" not in f.read_text(encoding="utf-8")


@pytest.mark.parametrize("broadcast", [True, False])
def test_prepared_texts_are_not_written_on_the_way(spark, tmp_path, monkeypatch, broadcast):
    """Texts go into pages and chunks alone; with numbers that are too many to broadcast the rows are the same."""
    from marlstone import scratch

    if not broadcast:
        monkeypatch.setattr(scratch, "BROADCAST_BYTES", -1)
    seen, write = [], prepare.materialize
    monkeypatch.setattr(prepare, "materialize", lambda df, label: seen.append(df.columns) or write(df, label))
    put(spark, f"{tmp_path}/in", *pages_of(*(f"text {i}\nmore" for i in range(40))), *pages_of("\x1c", source="blank", start=90), *pages_of("x", source="", start=95))
    got = listed(prepare.prepare_corpus(spark, f"{tmp_path}/in", f"{tmp_path}/corpus"))
    assert got == Counter([*(("a", i + 1, 1, f"text {i} more") for i in range(40)), (None, 1, 1, "x")])
    assert seen and all("text" not in columns for columns in seen)
    put(spark, f"{tmp_path}/two", *pages_of("now text", source="blank", start=90))
    prepare.prepare_corpus(spark, f"{tmp_path}/two", f"{tmp_path}/corpus")
    put(spark, f"{tmp_path}/three", *pages_of("\x1c", source="blank", start=90))  # no chunk again: the old one goes
    assert listed(prepare.prepare_corpus(spark, f"{tmp_path}/three", f"{tmp_path}/corpus")) == got
