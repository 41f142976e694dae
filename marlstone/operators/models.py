"""Hooks for what the caller brings: embeddings in batches, prompts for a chat model, signed links, and a
command that answers questions."""

from __future__ import annotations

import importlib
import subprocess
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.names import page_anchor
from marlstone.operators.answer import AnswerFn
from marlstone.scratch import hinted, materialize, ship

#: texts -> vectors, and messages ({role, content}) -> answer
EmbedFn = Callable[[list[str]], list[list[float]]]
ChatFn = Callable[[list[dict[str, str]]], str]

#: (bucket, key) of an object -> a link to it that is valid for a while
SignFn = Callable[[str, str], str]

#: Texts that one call of an embedding model gets.
EMBED_AT_ONCE = 16
# How a question is put, and the rule for its language.
QUESTION_TEMPLATE = "ВОПРОС:\n{question}\n\nИСТОЧНИКИ:\n{context}\n\nОТВЕТ:"
LANGUAGE_RULE = "LANGUAGE RULE: answer strictly in Russian only."


def named_function(name: str) -> Callable:
    """The function "module:function"."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def embedded(rows: DataFrame, embed: EmbedFn, text: str = "text", dims: int | None = None, at_once: int = EMBED_AT_ONCE) -> DataFrame:
    """rows with the column embedding: what embed gives for text, in batches of at_once. A model that gives
    another number of vectors, or (if dims is given) vectors of another length, stops the job."""
    ship(rows.sparkSession)
    columns = [c for c in rows.columns if c != "embedding"]
    kept = rows.select(*[F.col(f"`{c}`") for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = [t or "" for t in b.column(columns.index(text)).to_pylist()], []
            for i in range(0, len(texts), at_once):
                made = embed(texts[i : i + at_once])
                if len(made) != len(texts[i : i + at_once]):
                    raise ValueError("the embedding model gave another number of vectors")
                if dims and any(len(v) != dims for v in made):
                    raise ValueError(f"the embedding model gave vectors that are not of length {dims}")
                out += made
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], [*columns, "embedding"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{types}, embedding array<float>")


def load_prompt(spark: SparkSession, path: str) -> str:
    """A prompt template: the text of a file, without space at its ends."""
    return spark.read.text(path, wholetext=True).first()["value"].strip()


def messages(question: str, context: str, n_sources: int, system: str, force: str = "", russian: bool = False) -> list[dict[str, str]]:
    """What a chat model is sent. system may name {n_sources}; force is added if citations are demanded."""
    parts = [system.format(n_sources=n_sources), force, LANGUAGE_RULE if russian else ""]
    rules = "\n\n".join(p.strip() for p in parts if p.strip())
    return [{"role": "system", "content": rules}, {"role": "user", "content": QUESTION_TEMPLATE.format(question=question, context=context)}]


def prompted(chat: ChatFn, system: str, force: str = "", russian: bool = False) -> AnswerFn:
    """An answer function that asks a chat model."""

    def answer(question: str, context: str, n_sources: int, force_citations: bool) -> str:
        return chat(messages(question, context, n_sources, system, force if force_citations else "", russian))

    return answer


def signed_links(hits: DataFrame, sign: SignFn) -> DataFrame:
    """hits (s3_bucket, s3_key, page_start) with the column url: a signed link to the page. Each object is
    signed once; one that can't be, or has no key, gets an empty link."""
    ship(hits.sparkSession)
    objects = hits.select("s3_bucket", "s3_key").where("s3_bucket is not null and s3_key is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = []
            for bucket, key in zip(b.column("s3_bucket").to_pylist(), b.column("s3_key").to_pylist(), strict=True):
                try:
                    links.append(sign(bucket, key))
                except Exception:  # a store that is away must not stop the answer
                    links.append("")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(links, pa.string())], ["s3_bucket", "s3_key", "_link"])

    links = materialize(objects.mapInArrow(run, "s3_bucket string, s3_key string, _link string"), "links")
    joined = hits.drop("url").join(hinted(links, 512), ["s3_bucket", "s3_key"], "left")
    link = F.coalesce("_link", F.lit(""))
    return joined.withColumn("url", F.when(link == "", "").otherwise(page_anchor(link, F.col("page_start")))).drop("_link")


RUN = "question_id string, status string, started_at_utc string, finished_at_utc string, duration_sec double, returncode int, command array<string>, stdout string, stderr string"


def asked_by_command(questions: DataFrame, command: list[str], timeout: float = 300.0) -> DataFrame:
    """What a command (with the question as its last argument) prints for each of questions (question_id,
    question): status `ok`, `cli_error` if it fails, `timeout`, or `invalid_input` without a question."""
    ship(questions.sparkSession)

    def one(question_id: str, question: str | None) -> tuple:
        argv, began, clock = [*command, question or ""], datetime.now(UTC).isoformat(), time.monotonic()
        if not (question or "").strip():
            status, code, out, err = "invalid_input", None, "", ""
        else:
            try:
                done = subprocess.run(argv, capture_output=True, text=True, errors="replace", timeout=timeout, check=False)
                status, code, out, err = "cli_error" if done.returncode else "ok", done.returncode, done.stdout, done.stderr
            except subprocess.TimeoutExpired as e:
                status, code, out, err = "timeout", None, (e.stdout or b"").decode("utf-8", "replace"), (e.stderr or b"").decode("utf-8", "replace")
        return question_id, status, began, datetime.now(UTC).isoformat(), round(time.monotonic() - clock, 3), code, argv, out, err

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.float64(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()]
        for b in batches:
            rows = [one(i, q) for i, q in zip(b.column("question_id").to_pylist(), b.column("question").to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RUN.split(", ")])

    return questions.select(F.col("question_id").cast("string"), F.col("question").cast("string")).mapInArrow(run, RUN)
