"""python -m marlstone COMMAND: the engine from the shell.

build PAGES INDEX             cut page texts (JSON, JSONL) into an index
ingest-chunks CHUNKS INDEX    an index of ready chunks (JSONL), enriched from the registry
create-index PATH, drop-index PATH
search INDEX QUERY, ask INDEX QUERY            --mode sparse, dense, hybrid or graph; --k N
search-log INDEX QUERY, ask-log INDEX QUERY    the same, appended to a log with the settings
sources-upload FOLDER         put new files where objects are, by their digests, and into the registry
save-manifest FOLDER [NAME]   the settings of a run
queries SF_DIR [NAME...]      run registered queries and show some rows

Settings come from MARLSTONE_* (see settings.py); models are named there as module:function.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import engine
from marlstone.operators import answer, models
from marlstone.plans import catalog
from marlstone.session import local_session
from marlstone.settings import Settings
from marlstone.sources import readers, writers

COMMANDS = ("build", "ingest-chunks", "create-index", "drop-index", "search", "ask", "search-log", "ask-log", "sources-upload", "save-manifest", "queries")


def _vectors(chunks: DataFrame, s: Settings) -> DataFrame | None:
    if not s.embed:
        return None
    rows = models.embedded(chunks.select("chunk_id", "text"), models.named_function(s.embed), dims=s.dims or None)
    return rows.select(F.xxhash64("chunk_id").alias("vec_id"), "embedding", "chunk_id")


def _asked(spark: SparkSession, text: str, mode: str, s: Settings) -> DataFrame:
    rows = spark.createDataFrame([(0, text)], "query_id long, query string")
    if mode == "sparse":
        return rows
    if not s.embed:
        raise SystemExit(f"{mode} search needs an embedding model: set MARLSTONE_EMBED")
    return models.embedded(rows, models.named_function(s.embed), "query", s.dims or None)


def _answer_fn(spark: SparkSession, s: Settings) -> answer.AnswerFn:
    if not s.chat:
        return answer.first_sentences
    prompts = [models.load_prompt(spark, p) if p else "" for p in (s.system_prompt, s.force_prompt)]
    return models.prompted(models.named_function(s.chat), *prompts)


def main(args: list[str] | None = None) -> int:
    s = Settings.load()
    parser = argparse.ArgumentParser(prog="marlstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("path")
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--k", type=int, default=s.k)
    parser.add_argument("--mode", choices=engine.MODES, default=s.mode)
    given = parser.parse_args(args)
    spark, text = local_session(), " ".join(given.rest)
    if given.command in ("build", "ingest-chunks"):
        if given.command == "build":
            index = engine.build_index(readers.read_pages(spark, given.path))
        else:
            index = engine.index_chunks(readers.last_by_id(readers.require_sources(readers.read_chunks(spark, given.path))), files=readers.read_registry(spark, s.registry))
        index.vectors = _vectors(index.chunks, s)
        engine.save(index, given.rest[0])
    elif given.command == "create-index":
        writers.create_index_table(spark, given.path, s.dims)
    elif given.command == "drop-index":
        writers.drop_index_table(spark, given.path)
    elif given.command == "sources-upload":
        print(f"{writers.upload_sources(spark, given.path, s.objects, s.registry, s.bucket)} new files")
    elif given.command == "save-manifest":
        print(writers.write_manifest(spark, given.path, text or "dev", s.shown()))
    elif given.command == "queries":
        for name in given.rest or sorted(catalog.QUERIES):
            print(name)
            catalog.QUERIES[name](spark, given.path).show(5)
    else:
        index = engine.load(spark, given.path, with_vectors=given.mode != "sparse")
        asked = _asked(spark, text, given.mode, s)
        config = F.create_map(*(F.lit(x) for pair in (s.shown() | {"mode": given.mode}).items() for x in pair))
        if given.command.startswith("search"):
            hits = engine.search(index, asked, given.mode, given.k)
            hits.orderBy("rank").select("rank", "score", "chunk_id", "text").show(given.k, 100)
            listed = F.array_sort(F.collect_list(F.struct("rank", "score", "chunk_id", "text"))).alias("chunks")
            log, record = "searches", hits.groupBy("query_id").agg(listed).drop("query_id")
        else:
            record = engine.ask(index, asked, given.mode, given.k, _answer_fn(spark, s), base_url=s.base_url or None).drop("query_id")
            row = record.first()
            print(row["answer"], *(f"[{x['n']}] {x['title']} {x['url']}" for x in row["sources"]), sep="\n")
            log = "answers"
        if given.command.endswith("-log"):
            record = record.select(F.lit(text).alias("question"), F.lit(given.k).alias("k"), "*", config.alias("config"))
            writers.append_json(record, f"{s.logs.rstrip('/')}/{log}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
