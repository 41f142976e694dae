"""Queries of answers: contexts, citations, evaluation, text predicates, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import names, text
from marlstone.operators import answer, bm25, citations, evaluate, resume, transcripts
from marlstone.plans.retrieval import BENCHMARK_SQL, INDEX_SQL, SCORED_SQL, benchmark_queries
from marlstone.scratch import hinted, materialize, new_path
from marlstone.sources.corpus import pages
from marlstone.sources.tables import table

K = 5
SOURCES = 5


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pages of each benchmark question, with what answers need of them. Written once, as
    several branches read them."""
    chunks = pages(spark, sf_dir)
    hits = bm25.search(bm25.build(chunks), benchmark_queries(spark, sf_dir), chunks, K).drop("page_num")
    hits = hinted(materialize(hits, "ranks"), 64)  # or the texts would be shuffled to meet a few of them
    rich = hits.join(chunks, "chunk_id").withColumns({"page_start": F.col("page_num"), "page_end": F.col("page_num") + F.col("rank") % 2})
    url = names.page_anchor(F.concat(F.lit("https://files.example/"), "source_pdf"), F.col("page_start"))
    return materialize(rich.withColumn("url", url), "hits")


def answers_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions, asked by two runs over growing input that share a ledger, of a model that has no
    time at first for some."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"), "role")

    def ask(part: DataFrame) -> DataFrame:
        late = (F.length("question") % 3 == 0) & (F.col("attempt") == 1)
        status = F.when(late, "timeout").when(F.trim("question") == "", "invalid_input").otherwise("ok")
        return part.select("question_id", status.alias("status"), text.preview(F.col("question"), 200).alias("answer"))

    ledger = new_path(spark, "ledger")
    resume.answered(turns.where("role = 'user'"), ask, ledger, batch_questions=20_000)
    return resume.answered(turns, ask, ledger, batch_questions=20_000).select("question_id", "key", "attempt", "status", "answer")


def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.contexts(benchmark_hits(spark, sf_dir))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts as answers, each with a citation that has to go."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" Of the [7] thing . 12 ?")).alias("answer"))


def _idx(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", (F.col("rank") - 1).alias("idx"), "text")


def citation_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.best_chunks(_answers(spark, sf_dir), _idx(benchmark_hits(spark, sf_dir)))


def citation_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = citations.assign(_answers(spark, sf_dir), _idx(benchmark_hits(spark, sf_dir)))
    return cited.withColumn("used", F.array_join(F.col("used").cast("array<string>"), ","))


def _cited_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with citations in clusters, out of range and repeated; every ninth without a valid one."""
    tail = F.when(F.col("turn") % 9 == 8, F.lit(" [8] none [0]")).otherwise(
        F.concat(F.lit(" [3][1]. More ["), (F.col("turn") % 5 + 1).cast("string"), F.lit("] and [9][2][2][4] then  [9] end [1]"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), tail).alias("answer"))


def citation_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, used = citations.renumber(F.col("answer"), F.lit(SOURCES))
    return _cited_turns(spark, sf_dir).select("conv_id", "turn", changed.alias("answer"), F.array_join(used.cast("array<string>"), ",").alias("used"))


def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited_turns(spark, sf_dir).select("conv_id", "turn", citations.is_valid(F.col("answer"), F.lit(SOURCES)).alias("valid"))


def answer_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the stand-in; a line for each source."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = answer.envelopes(asked, benchmark_hits(spark, sf_dir))
    line = F.transform("sources", lambda x: F.concat_ws("|", *(x[c].cast("string") for c in ("n", "title", "filename", "page_start", "page_end", "url"))))
    return rows.withColumn("sources", F.array_join(line, "\n"))


def _gold_and_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold questions and runs made of the benchmark and its hits."""
    hits = benchmark_hits(spark, sf_dir).select("query_id", "rank", "source_pdf", F.col("page_start").alias("page"))
    q = F.col("query_id")
    ref = F.struct(F.col("source_pdf").alias("source_filename"), F.array("page", F.col("page") + 1).alias("source_pages"))
    primary = hits.where(F.col("rank") == q % 3 + 1).select("query_id", ref.alias("primary_reference"))
    single = F.struct(F.col("source_pdf").alias("source_filename"), F.array("page").alias("source_pages"))
    other = hits.where("rank = 4").select("query_id", F.array(single).alias("alternative_references"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    gold = asked.join(primary, "query_id").join(other, "query_id").withColumn("answerable", q % 4 != 0)
    source = F.struct(F.col("rank").alias("index"), F.concat(F.upper("source_pdf"), F.lit("?x=1")).alias("filename"), F.array("page").alias("page_numbers"))
    said = F.when(q % 5 == 0, text.REFUSAL_ANSWER.upper()).when(q % 5 == 1, F.lit("")).when(q % 5 == 2, F.lit("no citation")).otherwise(F.lit("so [1] and [3][9]"))
    status = F.when(q % 7 == 0, "cli_error").when(q % 11 == 0, "timeout").otherwise("ok")
    runs = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources")).withColumns({"model_answer": said, "status": status})
    return gold.withColumnRenamed("query_id", "question_id"), runs.withColumnRenamed("query_id", "question_id")


def _text(judged: DataFrame) -> DataFrame:
    lists = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c, t in judged.dtypes if t.startswith("array")}
    return judged.withColumns(lists)


def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(evaluate.records(*_gold_and_runs(spark, sf_dir)))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(evaluate.records(*_gold_and_runs(spark, sf_dir)))


def analysis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, runs = _gold_and_runs(spark, sf_dir)
    return evaluate.analysis(gold, runs, evaluate.records(gold, runs))


def analysis_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.totals(analysis_rows(spark, sf_dir))


def page_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    a, b = (i % 60).cast("string"), (i % 97).cast("string")
    token = F.when(i % 5 == 0, a).when(i % 5 == 1, F.concat(a, F.lit("-"), b)).when(i % 5 == 2, F.concat(F.lit(" "), a, F.lit("–"), b)).when(i % 5 == 3, F.concat(a, F.lit("-x"))).otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", token.alias("token"))
    return rows.select("doc_id", "token", F.array_join(text.page_numbers(F.col("token")).cast("array<string>"), ",").alias("pages"))


def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh turn refuses, every fourteenth with something behind it."""
    i = F.col("turn") + F.col("conv_id")
    said = F.when(i % 14 == 0, F.concat(F.lit("«В  источниках\nнет ответа» "), F.left("text", F.lit(5)))).when(i % 7 == 0, F.lit(" В ИСТОЧНИКАХ нет ответа.")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    c = F.col("said")
    return rows.select(
        "conv_id", "turn", text.refuses(c).alias("refuses"), text.is_refusal(c).alias("is_refusal"), text.shortened(c).alias("short"),
        text.preview(c, 200).alias("preview"), text.html_escaped(F.concat(c, F.lit("<b>&"))).alias("html"),
    )


def url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    u: Column = F.col("url")
    last = names.basename(F.regexp_replace(u, r"[?#].*$", ""))
    return table(spark, sf_dir, "pages").select(
        "page_id", names.is_public_url(u).alias("public"), names.slug(F.concat(last, F.lit(" Été-1.."))).alias("slug"), names.safe_filename(u).alias("safe"),
        names.page_anchor(u, F.col("page_id") % 3).alias("anchored"), text.first_filled(F.lit(" "), F.nullif(last, F.lit("")), F.lit("none")).alias("stem"),
    )


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed output of the benchmark's questions, with sources in two styles."""
    hits = benchmark_hits(spark, sf_dir)
    page = F.col("page_start")
    long = F.concat(F.lit("["), "rank", F.lit("] filename="), "source_pdf", F.lit(" | title=Book  of "), "doc_id", F.lit(" | pages="), page, F.lit("-"), page + 2, F.lit(","), page, F.lit(" | url=http://h/x.pdf#page="), page)
    short = F.concat("rank", F.lit(") /data/%D1%8F/"), "source_pdf", F.lit(", стр. "), page, F.lit("\nsee also http://h/y#page=3"))
    line = F.when(F.col("rank") % 2 == 1, long).otherwise(short)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    said = F.when(F.col("query_id") % 6 == 0, F.lit("в источниках нет ответа")).otherwise(F.concat(F.lit("Yes  [1],\r\n\r\n\r\n\r\n no "), F.col("query_id")))
    rows = hits.groupBy("query_id").agg(listed.alias("listed"))
    return rows.select(F.col("query_id").alias("question_id"), F.concat(F.lit("\x1b[1mlog\x1b[0m\n Answer: "), said, F.lit("\nSources:\n"), "listed").alias("stdout"))


def transcript_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse(_outputs(spark, sf_dir)).select("question_id", "model_answer", F.size("sources").alias("n_sources"))


def transcript_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transcripts.parse(_outputs(spark, sf_dir)).select("question_id", F.explode("sources").alias("s"))
    return rows.select("question_id", "s.index", "s.title", "s.url", F.array_join(F.col("s.page_numbers").cast("array<string>"), ",").alias("pages"), "s.filename")


def message_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: number of parts, their longest, and the first."""
    parts = table(spark, sf_dir, "documents").select("doc_id", transcripts.message_parts("text").alias("p"))
    return parts.select("doc_id", F.size("p").alias("n_parts"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"), F.try_element_at("p", F.lit(1)).alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        context_build, citation_best_chunk, citation_assign, citation_renumber, citation_validity, answer_envelope,
        eval_records, eval_summary, analysis_rows, analysis_totals, page_range_expand, text_predicates, url_fields,
        transcript_answers, transcript_sources, message_split, answers_resumed,
    )
}

HITS_SQL = f"""{INDEX_SQL}, {BENCHMARK_SQL}, {SCORED_SQL}, hits AS (
  SELECT h.query_id, h.rank, h.score, p.*, p.page_num AS page_start, p.page_num + h.rank % 2 AS page_end
  FROM sparse_hits h JOIN pages_view p USING (chunk_id) WHERE h.rank <= {K}
)"""
MATCH = r"trim(regexp_replace(regexp_replace(lower({}), '\[\d+\]', '', 'g'), '\s+', ' ', 'g'))"
MATCH_TOKENS = "list_distinct(list_filter(regexp_extract_all({}, '[A-Za-zА-Яа-яЁё0-9-]+'), lambda t: length(t) >= 3))"
ANSWERS_SQL = f"""{HITS_SQL}, answers AS (SELECT item_id AS query_id, text || ' Of the [7] thing . 12 ?' AS answer FROM benchmark)"""
MATCHED_SQL = rf""", split_answers AS (
  SELECT query_id, list_filter(list_transform(regexp_extract_all(trim(answer), '[^.!?]+[.!?]+|[^.!?]+$'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS parts FROM answers
), said AS (
  SELECT query_id, unnest(parts) AS sentence, unnest(generate_series(0, len(parts) - 1)) AS "at" FROM split_answers
), plain AS (
  SELECT *, {MATCH.format("sentence")} AS plain, {MATCH_TOKENS.format(MATCH.format("sentence"))} AS tokens FROM said WHERE {MATCH.format("sentence")} <> ''
), held AS (
  SELECT query_id, rank - 1 AS idx, {MATCH.format("text")} AS chunk, {MATCH_TOKENS.format(MATCH.format("text"))} AS chunk_tokens FROM hits
), pairs AS (
  SELECT p.query_id, p."at", h.idx, round(len(list_intersect(tokens, chunk_tokens)) / len(tokens)::DOUBLE + CASE WHEN contains(chunk, plain) THEN 0.25 ELSE 0 END::DOUBLE, 9) AS score
  FROM plain p JOIN held h USING (query_id) WHERE len(tokens) > 0 AND len(chunk_tokens) > 0
), best AS (
  SELECT query_id, "at", idx, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "at" ORDER BY score DESC, idx) AS k FROM pairs) WHERE k = 1 AND score >= 0.18
), matched AS (
  SELECT p.query_id, p."at"::INTEGER AS "at", p.sentence, b.idx::INTEGER AS idx, b.score FROM plain p LEFT JOIN best b USING (query_id, "at")
)"""
BEST_SQL = ANSWERS_SQL + MATCHED_SQL
CITED_SQL = r""", starts AS (
  SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(idx) OVER w IS DISTINCT FROM idx THEN 1 ELSE 0 END AS s FROM matched WINDOW w AS (PARTITION BY query_id ORDER BY "at")
), runs AS (SELECT *, sum(s) OVER (PARTITION BY query_id ORDER BY "at") AS run FROM starts
), blocks AS (
  SELECT query_id, run, any_value(idx) AS idx,
         trim(regexp_replace(regexp_replace(regexp_replace(string_agg(sentence, ' ' ORDER BY "at"), '\[\d+\]', '', 'g'), '\s+([.,!?;:])', '\1', 'g'), '\s+', ' ', 'g')) AS block
  FROM runs GROUP BY 1, 2
), cited AS (SELECT *, CASE WHEN idx IS NULL THEN block ELSE block || ' [' || (idx + 1) || ']' END AS part FROM blocks
), firsts AS (SELECT query_id, idx, min(run) AS run FROM cited WHERE idx IS NOT NULL GROUP BY 1, 2
), used AS (SELECT query_id, string_agg(idx::VARCHAR, ',' ORDER BY run) AS used FROM firsts GROUP BY 1
), whole AS (SELECT query_id, string_agg(part, ' ' ORDER BY run) AS answer FROM cited GROUP BY 1
), assigned AS (SELECT query_id, coalesce(whole.answer, '') AS answer, coalesce(used, '') AS used FROM answers LEFT JOIN whole USING (query_id) LEFT JOIN used USING (query_id))"""
ASSIGN_SQL = f"{BEST_SQL}{CITED_SQL} SELECT * FROM assigned"
TURNS_SQL = """turns AS (
  SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 9 = 8 THEN ' [8] none [0]' ELSE ' [3][1]. More [' || (turn % 5 + 1) || '] and [9][2][2][4] then  [9] end [1]' END AS answer FROM conversations)"""
ORDERED_SQL = """, numbered AS (
  SELECT *, list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT) AS nums FROM turns
), ordered AS (
  SELECT *, list_filter(list_filter(nums, lambda x: x BETWEEN 1 AND 5), lambda x, i: list_position(list_filter(nums, lambda y: y BETWEEN 1 AND 5), x) = i) AS ord FROM numbered
)"""
JOINED_SQL = r""", cut AS (
  SELECT *, regexp_split_to_array(answer, '(?:\[\d+\])+') AS gaps, regexp_extract_all(answer, '(?:\[\d+\])+') AS clusters FROM ordered
), pieces AS (
  SELECT conv_id, turn, answer, ord, gaps, unnest(generate_series(1, len(gaps))) AS i, clusters FROM cut
), news AS (
  SELECT *, list_filter(list_transform(regexp_extract_all(coalesce(clusters[i], ''), '\d+'), lambda x: coalesce(list_position(ord, x::BIGINT), 0)), lambda p: p > 0) AS new FROM pieces
), tidy AS (
  SELECT *, CASE WHEN len(new) > 1 THEN list_sort(list_distinct(new)) ELSE new END AS final FROM news
), joined AS (
  SELECT conv_id, turn, any_value(answer) AS answer, any_value(ord) AS ord, string_agg(gaps[i] || array_to_string(list_transform(final, lambda n: '[' || n || ']'), ''), '' ORDER BY i) AS changed FROM tidy GROUP BY 1, 2
)"""
RENUMBER_SQL = rf"""WITH {TURNS_SQL}{ORDERED_SQL}{JOINED_SQL} SELECT conv_id, turn, CASE WHEN len(ord) = 0 THEN answer ELSE trim(regexp_replace(changed, '\s+', ' ', 'g')) END AS answer, array_to_string(list_transform(ord, lambda x: (x - 1)::VARCHAR), ',') AS used FROM joined"""
ENVELOPE_SQL = rf"""WITH {HITS_SQL}, first_said AS (
  SELECT query_id, rank, trim(regexp_extract(regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '[^.!?]+[.!?]+|[^.!?]+$')) AS said FROM hits
), answers AS (
  SELECT query_id, string_agg(said || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM first_said WHERE said <> '' GROUP BY 1
){MATCHED_SQL}{CITED_SQL}, turns AS (SELECT query_id AS conv_id, 0 AS turn, answer FROM assigned){ORDERED_SQL}{JOINED_SQL}, final AS (
  SELECT conv_id AS query_id, CASE WHEN len(ord) = 0 THEN answer ELSE trim(regexp_replace(changed, '\s+', ' ', 'g')) END AS answer,
         CASE WHEN len(ord) = 0 THEN generate_series(1, {K}) ELSE ord END AS ord FROM joined
), listed AS (SELECT query_id, unnest(ord) AS rank, unnest(generate_series(1, len(ord))) AS n FROM final
), sourced AS (
  SELECT query_id, string_agg(concat_ws('|', n, title, source_pdf, page_start, page_end, 'https://files.example/' || source_pdf || '#page=' || page_start || '&zoom=page-fit'), chr(10) ORDER BY n) AS sources
  FROM listed JOIN hits USING (query_id, rank) GROUP BY 1
)
SELECT query_id, answer, sources, (SELECT count(*) FROM hits h WHERE h.query_id = final.query_id)::INTEGER AS retrieved FROM final JOIN sourced USING (query_id)"""
RUNS_SQL = f"""{HITS_SQL}, gold AS (
  SELECT item_id AS question_id, benchmark.text AS question, item_id % 4 <> 0 AS answerable, p.source_pdf AS p_file, [p.page_start, p.page_start + 1] AS p_pages, a.source_pdf AS a_file, [a.page_start] AS a_pages
  FROM benchmark JOIN hits p ON p.query_id = item_id AND p.rank = item_id % 3 + 1 JOIN hits a ON a.query_id = item_id AND a.rank = 4
), runs AS (
  SELECT DISTINCT query_id AS question_id, CASE query_id % 5 WHEN 0 THEN 'В ИСТОЧНИКАХ НЕТ ОТВЕТА.' WHEN 1 THEN '' WHEN 2 THEN 'no citation' ELSE 'so [1] and [3][9]' END AS model_answer,
         CASE WHEN query_id % 7 = 0 THEN 'cli_error' WHEN query_id % 11 = 0 THEN 'timeout' ELSE 'ok' END AS status FROM hits
), active AS (
  SELECT query_id AS question_id, rank, source_pdf, page_start AS page FROM hits WHERE query_id % 5 < 3 OR rank IN (1, 3)
), got AS (
  SELECT g.*, r.model_answer, r.status, list_sort(list_distinct((SELECT list(page) FROM active a WHERE a.question_id = g.question_id))) AS pages_all,
         coalesce(list_sort(list_distinct((SELECT list(page) FROM active a WHERE a.question_id = g.question_id AND a.source_pdf = g.p_file))), []) AS pages_p,
         coalesce(list_sort(list_distinct((SELECT list(page) FROM active a WHERE a.question_id = g.question_id AND a.source_pdf = g.a_file))), []) AS pages_a
  FROM gold g JOIN runs r USING (question_id)
), judged AS (
  SELECT question_id, question, status, model_answer, p_file, p_pages, a_pages, answerable AS expected_answerable, question_id % 5 >= 2 AS predicted_has_answer, question_id % 5 = 0 AS refusal_match,
    (question_id % 5 >= 2) = answerable AS answerability_match, CASE WHEN question_id % 5 >= 3 THEN '1,3,9' ELSE '' END AS answer_citations,
    array_to_string(pages_all, ',') AS cited_source_pages_all, array_to_string(pages_p, ',') AS cited_source_pages, array_to_string(list_sort(list_distinct(list_concat(pages_p, pages_a))), ',') AS cited_source_pages_any_gold,
    len(pages_p) > 0 AS gold_source_match_found, len(pages_p) + len(pages_a) > 0 AS gold_source_match_found_any,
    (list_has_any(p_pages, pages_p)::INTEGER + list_has_any(a_pages, pages_a)::INTEGER)::BIGINT AS matched_gold_references,
    list_has_any(p_pages, pages_p) AS page_hit, list_has_any(p_pages, pages_all) AS page_hit_legacy, list_has_any(p_pages, pages_p) OR list_has_any(a_pages, pages_a) AS page_hit_any,
    list_has_all(pages_p, p_pages) AS all_gold_pages_covered, list_has_all(pages_all, p_pages) AS all_gold_pages_covered_legacy, list_has_all(pages_p, p_pages) OR list_has_all(pages_a, a_pages) AS all_gold_pages_covered_any,
    pages_p = p_pages AS exact_cited_pages_match, pages_all = p_pages AS exact_cited_pages_match_legacy, pages_p = p_pages OR pages_a = a_pages AS exact_cited_pages_match_any
  FROM got
)"""


def _rate(hit: str, among: str) -> str:
    return f"round(count(*) FILTER (({among}) AND ({hit})) / nullif(count(*) FILTER ({among}), 0), 4)"


def _summary_sql() -> str:
    ok = "status IN ('ok', 'cli_error')"
    yes, no = f"{ok} AND expected_answerable", f"{ok} AND NOT expected_answerable"
    counts = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("ok", "cli_error", "timeout", "invalid_input"))
    on_yes = ", ".join(f"{_rate(m + s, yes)} AS {m}_rate_on_answerable{t}" for m in ("page_hit", "all_gold_pages_covered", "exact_cited_pages_match") for s, t in (("_any", ""), ("_legacy", "_legacy"))).replace("page_hit_rate", "page_hit_rate")
    return f"""WITH {RUNS_SQL} SELECT count(*) AS total_questions, {counts}, count(*) FILTER (NOT ({ok})) AS other_errors, {_rate("answerability_match", ok)} AS answerability_accuracy_proxy,
      {_rate("NOT predicted_has_answer", no)} AS no_answer_accuracy, {_rate("answer_citations <> ''", ok)} AS citation_presence_rate, {_rate("gold_source_match_found", yes)} AS gold_source_match_found_rate_primary,
      {_rate("gold_source_match_found_any", yes)} AS gold_source_match_found_rate_any, {on_yes} FROM judged"""


STRIPPED = r"regexp_replace({}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
#: Each step cuts one part off the rest; `back` is how far the last line break lies before the limit.
MESSAGES_SQL = f"""WITH RECURSIVE steps AS (
  SELECT doc_id, 0 AS i, NULL::VARCHAR AS part, coalesce(text, '') AS rest FROM documents
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN length(rest) > {transcripts.MESSAGE_LIMIT} THEN {STRIPPED.format("left(rest, stop)")} ELSE rest END,
         CASE WHEN length(rest) > {transcripts.MESSAGE_LIMIT} THEN {STRIPPED.format("substr(rest, stop + 1)")} ELSE '' END
  FROM (SELECT doc_id, i, rest, CASE WHEN back BETWEEN 1 AND {transcripts.MESSAGE_LIMIT - 1} THEN {transcripts.MESSAGE_LIMIT} - back ELSE {transcripts.MESSAGE_LIMIT} END AS stop
        FROM (SELECT doc_id, i, rest, strpos(reverse(left(rest, {transcripts.MESSAGE_LIMIT})), chr(10)) AS back FROM steps WHERE rest <> ''))
)
SELECT doc_id, count(part)::INTEGER AS n_parts, coalesce(max(length(part)), 0)::INTEGER AS longest, max(part) FILTER (i = 1) AS first FROM steps GROUP BY 1"""

SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
ORACLES = {
    "answer_envelope": ENVELOPE_SQL,
    "answers_resumed": """SELECT conv_id || '-' || turn AS question_id, sha256(q) AS key, CASE WHEN length(q) % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS attempt,
        CASE WHEN trim(q) = '' THEN 'invalid_input' ELSE 'ok' END AS status, CASE WHEN length(q) <= 200 THEN q ELSE left(q, 200) || '...' END AS answer
      FROM (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations)""",
    "message_split": MESSAGES_SQL,
    "transcript_answers": f"""WITH {HITS_SQL} SELECT query_id AS question_id, CASE WHEN query_id % 6 = 0 THEN 'В источниках нет ответа.' ELSE 'Yes [1],' || chr(10) || chr(10) || ' no ' || query_id END AS model_answer, count(*)::INTEGER AS n_sources FROM hits GROUP BY 1""",
    "transcript_sources": f"""WITH {HITS_SQL} SELECT query_id AS question_id, rank AS index, CASE WHEN rank % 2 = 1 THEN 'Book of ' || doc_id ELSE '/data/%D1%8F/' || source_pdf || ', стр. ' || page_start END AS title,
        CASE WHEN rank % 2 = 1 THEN 'http://h/x.pdf#page=' || page_start END AS url, source_pdf AS filename,
        CASE WHEN rank % 2 = 1 THEN page_start || ',' || (page_start + 1) || ',' || (page_start + 2) ELSE array_to_string(list_sort(list_distinct([3, page_start])), ',') END AS pages FROM hits""",
    "context_build": f"""WITH {HITS_SQL} SELECT query_id, string_agg(printf('[%d] doc_id=%s chunk=%s score=%.4f', rank, doc_id, chunk_id, round(score::DECIMAL(18, 6), 4)::DOUBLE) ||
        CASE WHEN page_start = page_end THEN ' page=' || page_start ELSE ' pages=' || page_start || '-' || page_end END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, count(*)::INTEGER AS retrieved FROM hits GROUP BY 1""",
    "citation_best_chunk": f"WITH {BEST_SQL} SELECT query_id, \"at\", sentence, idx, score FROM matched",
    "citation_assign": f"WITH {ASSIGN_SQL}",
    "citation_renumber": RENUMBER_SQL,
    "citation_validity": f"WITH {TURNS_SQL}{ORDERED_SQL} SELECT conv_id, turn, len(ord) > 0 AS valid FROM ordered",
    "eval_records": f"WITH {RUNS_SQL} SELECT * EXCLUDE (question, model_answer, p_file, p_pages, a_pages) FROM judged",
    "eval_summary": _summary_sql(),
    "analysis_rows": f"""WITH {RUNS_SQL} SELECT question_id::VARCHAR AS question_id, {SQUEEZE.format("question")} AS question, p_file AS gold_source_filename, array_to_string(p_pages, ',') AS gold_pages_prim_ref,
        array_to_string(a_pages, ',') AS gold_pages_alt_ref, CASE WHEN gold_source_match_found_any THEN 'True' ELSE 'False' END AS gold_source_match_found, cited_source_pages_any_gold AS gold_source_cited_pages,
        CASE WHEN page_hit_any THEN 'True' ELSE 'False' END AS page_hit, model_answer, '' AS manual_error_type FROM judged""",
    "analysis_totals": f"""WITH {RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (gold_source_match_found_any) AS gold_source_match_true,
        count(*) FILTER (page_hit_any) AS page_hit_true, count(*) FILTER (NOT page_hit_any) AS page_hit_false FROM judged""",
    "page_range_expand": """WITH t AS (SELECT doc_id, doc_id % 60 AS a, doc_id % 97 AS b, doc_id % 5 AS kind FROM documents)
      SELECT doc_id, CASE kind WHEN 0 THEN a::VARCHAR WHEN 1 THEN a || '-' || b WHEN 2 THEN ' ' || a || '–' || b WHEN 3 THEN a || '-x' ELSE '' END AS token,
        CASE WHEN kind = 0 THEN a::VARCHAR WHEN kind > 2 THEN '' WHEN a <= b AND b - a <= 20 THEN array_to_string(generate_series(a, b), ',') ELSE a || ',' || b END AS pages FROM t""",
    "text_predicates": rf"""WITH t AS (SELECT conv_id, turn, CASE WHEN (turn + conv_id) % 14 = 0 THEN '«В  источниках' || chr(10) || 'нет ответа» ' || left(text, 5) WHEN (turn + conv_id) % 7 = 0 THEN ' В ИСТОЧНИКАХ нет ответа.' ELSE text END AS said, (turn + conv_id) AS i FROM conversations)
      SELECT conv_id, turn, i % 7 = 0 AS refuses, i % 7 = 0 AND i % 14 <> 0 AS is_refusal,
        CASE WHEN length({SQUEEZE.format("said")}) <= 220 THEN {SQUEEZE.format("said")} ELSE rtrim(left({SQUEEZE.format("said")}, 219)) || '…' END AS short,
        CASE WHEN length(said) <= 200 THEN said ELSE left(said, 200) || '...' END AS preview,
        replace(replace(replace(said || '<b>&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM t""",
    "url_fields": r"""WITH u AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS last FROM pages)
      SELECT page_id, true AS public, trim(regexp_replace(regexp_replace(lower(trim(last || ' Été-1..')), '[^a-z0-9_é\-]+', '_', 'g'), '_+', '_', 'g'), '_') AS slug,
        trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g'), '\s+', ' ', 'g')) AS safe,
        CASE WHEN page_id % 3 = 0 THEN url ELSE split_part(url, '#', 1) || '#page=' || (page_id % 3) || '&zoom=page-fit' END AS anchored, CASE WHEN last = '' THEN 'none' ELSE last END AS stem FROM u""",
}
