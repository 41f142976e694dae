"""Context, answers with citations, and the envelope that a question gets back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import ANSWER_SENTENCE, REFUSAL_ANSWER, positive_int, refuses, stripped
from marlstone.operators import citations
from marlstone.scratch import ship

#: (question, context, n_sources, force_citations) -> answer
AnswerFn = Callable[[str, str, int, bool], str]


def page_part(first: Column, last: Column) -> Column:
    a, b = positive_int(first), positive_int(last)
    one = F.concat(F.lit(" page="), a.cast("string"))
    several = F.concat(F.lit(" pages="), a.cast("string"), F.lit("-"), b.cast("string"))
    return F.when(a.isNull() | b.isNull(), "").when(a == b, one).otherwise(several)


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, context, retrieved of hits (query_id, rank, doc_id, chunk_id, score, page_start,
    page_end, text): the few hits of a query in order, each below a header."""
    header = F.format_string("[%d] doc_id=%s chunk=%s score=%.4f%s\n%s", "rank", "doc_id", "chunk_id", "score", page_part(F.col("page_start"), F.col("page_end")), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", header.alias("part"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("context"), F.count(F.lit(1)).cast("int").alias("retrieved"))


def first_sentences(question: str, context: str, n_sources: int, force_citations: bool) -> str:
    """A stand-in for a language model: the first sentence of each source."""
    import re

    said = []
    for i, block in enumerate(context.split("\n\n["), 1):
        body = block.partition("\n")[2].strip()
        found = re.search(ANSWER_SENTENCE, body)
        if found:
            said.append(f"{found[0].strip()} [{i}]" if force_citations else found[0].strip())
    return " ".join(said) or REFUSAL_ANSWER


def generate(asked: DataFrame, answer_fn: AnswerFn = first_sentences) -> DataFrame:
    """asked (query_id, question, context, retrieved) with raw_answer. An answer that neither refuses
    nor cites is asked for once more."""

    ship(asked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            out = []
            for q, c, n in zip(*(b.column(x).to_pylist() for x in ("question", "context", "retrieved")), strict=True):
                said = answer_fn(q or "", c, n, False)
                if said.strip() != REFUSAL_ANSWER and not any(1 <= int(x) <= n for x in re.findall(r"\[(\d+)\]", said)):
                    said = answer_fn(q or "", c, n, True)
                out.append(said)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "raw_answer"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(run, f"{types}, raw_answer string")


def printable(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{C}", "")


def envelopes(questions: DataFrame, hits: DataFrame, answer_fn: AnswerFn = first_sentences, strict: bool = True) -> DataFrame:
    """query_id, answer, sources, retrieved for every question (query_id, question). hits: as in
    contexts, with title, source_pdf and url. No hits, a refusal, or (if strict) an answer without
    a valid citation give the refusal without sources."""
    asked = questions.join(contexts(hits), "query_id")
    answered = generate(asked.select("query_id", "question", "context", "retrieved"), answer_fn).drop("context")
    cites = citations.is_valid(F.col("raw_answer"), F.col("retrieved"))
    good = answered.where(~refuses(F.col("raw_answer")) & (cites | F.lit(not strict)))
    assigned = citations.assign(good.select("query_id", F.col("raw_answer").alias("answer")), hits.select("query_id", (F.col("rank") - 1).alias("idx"), "text"))
    text, used = citations.renumber(F.col("answer"), F.col("retrieved"))
    final = assigned.drop("used").join(good.select("query_id", "retrieved"), "query_id").select("query_id", text.alias("answer"), used.alias("used"), "retrieved")
    every = F.sequence(F.lit(0), F.col("retrieved") - 1)
    final = final.withColumn("used", F.when(F.size("used") == 0, every).otherwise(F.col("used")))
    title = F.coalesce(*(F.nullif(stripped(printable(F.col(c))), F.lit("")) for c in ("title", "source_pdf", "doc_id")), F.lit("unknown-source"))
    cited = final.select("query_id", F.posexplode("used").alias("at", "idx")).join(hits.withColumn("idx", F.col("rank") - 1), ["query_id", "idx"])
    source = F.struct(
        (F.col("at") + 1).alias("n"), title.alias("title"), printable(F.col("source_pdf")).alias("filename"),
        positive_int(F.col("page_start")).alias("page_start"), positive_int(F.col("page_end")).alias("page_end"), printable(F.col("url")).alias("url"),
    )
    sources = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    answers = final.select("query_id", "answer").join(sources, "query_id", "left")
    counts = answered.select("query_id", "retrieved")
    out = questions.select("query_id").join(counts, "query_id", "left").join(answers, "query_id", "left")
    none = F.array().cast("array<struct<n:int,title:string,filename:string,page_start:int,page_end:int,url:string>>")
    return out.select("query_id", F.coalesce("answer", F.lit(REFUSAL_ANSWER)).alias("answer"), F.coalesce("sources", none).alias("sources"), F.coalesce("retrieved", F.lit(0)).alias("retrieved"))
