"""Queries of the corpus build: cleaning, chunks, graph, quality control, registry, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import names
from marlstone.functions.text import prose_sentences
from marlstone.operators import chunk, clean, graph, qc, registry, reports
from marlstone.scratch import materialize
from marlstone.sources.corpus import LINES_SQL, PAGES_SQL, line_chunks, pages
from marlstone.sources.tables import table

#: The synthetic pages repeat lines rarely; the production ratio would find none.
RATIO = 0.05


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = clean.page_lines(pages(spark, sf_dir))
    return lined.select("doc_id", "page_num", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"))


def repeated_header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.repeated_lines(clean.page_lines(pages(spark, sf_dir)), RATIO)


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = materialize(clean.page_lines(pages(spark, sf_dir)), "lines")
    return clean.cleaned(lined, clean.repeated_lines(lined, RATIO))


def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)


def preprocess_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.report(_cleaned(spark, sf_dir))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pages(spark, sf_dir).select("doc_id", "page_num", prose_sentences(F.col("text")).alias("s"))
    return parts.select("doc_id", "page_num", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"), F.array_join("s", "\n").alias("sentences"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunked(pages(spark, sf_dir))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.stats(chunk_documents(spark, sf_dir))


def chunk_stats_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.stats_by_doc(chunk_documents(spark, sf_dir))


def chunk_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(materialize(line_chunks(spark, sf_dir).drop("text"), "lines"))


def chunk_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = materialize(pages(spark, sf_dir).drop("text"), "pages")
    return graph.nodes(chunks, graph.edges(chunks)).select("chunk_id", "doc_id", "page_num", F.array_join("neighbors", ",").alias("neighbors"))


def chunk_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = materialize(line_chunks(spark, sf_dir).drop("text"), "lines")
    return graph.run_stats(chunks)


def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest pages of each vector query, and their neighbours."""
    from marlstone.operators import dense
    from marlstone.plans.retrieval import vector_queries, vectors

    chunks = materialize(pages(spark, sf_dir).drop("text"), "pages")
    near = dense.search(vectors(spark, sf_dir), vector_queries(spark, sf_dir), 2)
    seeds = near.join(chunks.select(F.col("row_id").alias("vec_id"), "chunk_id"), "vec_id")
    return graph.expand_runs(seeds, graph.runs(chunks))


def qc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.status(pages(spark, sf_dir))


def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.samples(pages(spark, sf_dir))


def header_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = materialize(clean.page_lines(pages(spark, sf_dir)), "lines")
    return reports.header_report(lined, clean.repeated_lines(lined, RATIO))


def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample_report(qc.samples(pages(spark, sf_dir)))


def _url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for each page: its address' last part, with an accent and a suffix."""
    url = F.regexp_replace("url", r"[?#].*$", "")
    name = F.concat(F.lit("Été "), F.regexp_extract(url, r"([^/]*)/?$", 1), F.lit(" (ö).PDF"))
    return table(spark, sf_dir, "pages").select("page_id", "url", name.alias("filename"))


def filename_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _url_files(spark, sf_dir)
    return files.select("page_id", "filename", names.registry_key(F.col("filename")).alias("key"))


def evaluation_filename_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _url_files(spark, sf_dir)
    return files.select("page_id", names.evaluation_key(F.concat(F.lit('"dir/'), "filename", F.lit('#page=2" '))).alias("key"))


def stable_point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.points(pages(spark, sf_dir)).select("chunk_id", "point_id")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third source, twice: the later line wins."""
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("line")).where("line % 3 = 0")
    older = sources.select(F.concat("source", F.lit(".pdf")).alias("filename"), F.lit("old").alias("doc_id"), F.lit("b").alias("s3_bucket"), F.concat(F.lit("raw/"), "source").alias("s3_key"), F.lit("s").alias("source"), "line")
    newer = older.withColumns({"filename": F.upper("filename"), "doc_id": F.sha2("filename", 256), "line": F.col("line") + 1_000_000})
    return older.unionByName(newer)


def registry_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = registry.enrich(pages(spark, sf_dir), _registry(spark, sf_dir))
    url = names.source_url("https://files.example", F.col("s3_bucket"), F.col("s3_key"), F.lit("none"), F.col("page_num"))
    return rich.select("chunk_id", "registry_filename", "registry_doc_id", "s3_bucket", "s3_key", url.alias("url"))


def new_sources_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "doc_id")
    known = table(spark, sf_dir, "labels").join(docs, "doc_id").select("sha256")
    return registry.new_files(docs, known).select("sha256")


QUERIES = {
    f.__name__: f
    for f in (
        clean_lines, repeated_header_footer, cleaned_pages, preprocess_report, sentence_split, chunk_documents, chunk_stats, chunk_stats_by_doc,
        chunk_graph_edges, chunk_graph_nodes, chunk_graph_stats, graph_expand, qc_status, page_samples, header_report, sample_report, filename_key, evaluation_filename_key,
        stable_point_id, registry_enrich, new_sources_anti,
    )
}

# The white space and the signs that these patterns name are all that the tables have.
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINED_SQL = rf"""{PAGES_SQL}, lined AS (
  SELECT doc_id, page_num, length(text) AS raw_chars,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([A-Za-zА-Яа-яЁё])-\n([A-Za-zА-Яа-яЁё])', '\1\2', 'g'), '\r\n|\r', chr(10), 'g'), chr(10)),
                                    lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))),
                     lambda x: x <> '' AND NOT regexp_full_match(x, '[\-–—_.,:;*·•\s]+') AND NOT regexp_full_match(x, '[\-–—\s]*\d{{1,4}}[\-–—\s]*')) AS lines
  FROM pages_view
)"""
REPEATED_SQL = f"""sizes AS (SELECT doc_id, count(*) AS pages FROM lined GROUP BY 1), zone_keys AS (
  SELECT DISTINCT doc_id, page_num, 1 AS top, lower(unnest(list_slice(lines, 1, 3))) AS line FROM lined
  UNION ALL
  SELECT DISTINCT doc_id, page_num, 0 AS top, lower(unnest(list_slice(lines, greatest(len(lines) - 2, 1), len(lines)))) AS line FROM lined
), counted AS (
  SELECT doc_id, line, sum(top)::BIGINT AS top_count, sum(1 - top)::BIGINT AS bottom_count FROM zone_keys
  WHERE length(line) BETWEEN 3 AND 180 GROUP BY 1, 2
), repeated AS (
  SELECT doc_id, line, top_count, bottom_count,
         CASE WHEN top_count >= greatest(3, ceil(pages * {RATIO}::DOUBLE)) AND top_count > bottom_count THEN 'header'
              WHEN bottom_count >= greatest(3, ceil(pages * {RATIO}::DOUBLE)) AND bottom_count > top_count THEN 'footer' END AS kind
  FROM counted JOIN sizes USING (doc_id)
)"""
CLEANED_SQL = rf"""numbered AS (
  SELECT doc_id, page_num, raw_chars, len(lines) AS n, unnest(lines) AS line, unnest(generate_series(0, len(lines) - 1)) AS i FROM lined
), marked AS (
  SELECT *, (i < 3 AND EXISTS (SELECT 1 FROM repeated r WHERE r.doc_id = m.doc_id AND r.kind = 'header' AND r.line = lower(m.line)))
         OR (i >= n - 3 AND EXISTS (SELECT 1 FROM repeated r WHERE r.doc_id = m.doc_id AND r.kind = 'footer' AND r.line = lower(m.line))) AS gone
  FROM numbered m
), tidied AS (
  SELECT doc_id, page_num, i, gone,
         regexp_replace(regexp_replace(regexp_replace(line, '\s+([,.;:!?])', '\1', 'g'), '([(\[{{])\s+', '\1', 'g'), '\s+([)\]}}])', '\1', 'g') AS line
  FROM marked
), gathered AS (
  SELECT doc_id, page_num, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone AND line <> '') AS text, count(*) FILTER (gone) AS dropped
  FROM tidied GROUP BY 1, 2
), cleaned AS (
  SELECT l.doc_id, l.page_num, coalesce({STRIP.format("g.text")}, '') AS text, l.raw_chars, coalesce(g.dropped, 0) AS dropped_lines
  FROM lined l LEFT JOIN gathered g USING (doc_id, page_num)
)"""
EDGES_SQL = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, chunk_id) AS at FROM {}
), pairs AS (
  SELECT a.chunk_id AS src, b.chunk_id AS dst, 0 AS kind FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND abs(a.at - b.at) = 1
  UNION ALL SELECT a.chunk_id, b.chunk_id, 1 FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.chunk_id <> b.chunk_id
  UNION ALL SELECT a.chunk_id, b.chunk_id, 2 FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.page_num = a.page_num + 1
  UNION ALL SELECT a.chunk_id, b.chunk_id, 2 FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.page_num = a.page_num - 1
), edges AS (
  SELECT src, dst, CASE min(kind) WHEN 0 THEN 'prev_next' WHEN 1 THEN 'same_page' ELSE 'adjacent_page' END AS edge_type FROM pairs GROUP BY 1, 2
)"""
URL_FILES_SQL = r"""files AS (
  SELECT page_id, url, 'Été ' || regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1) || ' (ö).PDF' AS filename FROM pages
)"""
PREVIEW = "CASE WHEN length({0}) <= {1} THEN {0} ELSE left({0}, {1}) || '...' END"
FILLED_SQL = rf"{PAGES_SQL}, filled AS (SELECT doc_id, page_num, regexp_replace({STRIP.format('text')}, '\n{{3,}}', chr(10) || chr(10), 'g') AS clean FROM pages_view)"
GRAPH_EXPAND_SQL = """hits AS (
  SELECT query_id, chunk_id, h.rank, h.score FROM dense_hits h JOIN pages_view ON row_id = vec_id WHERE h.rank <= 2
), s1 AS (SELECT * FROM hits WHERE rank = (SELECT min(rank) FROM hits h WHERE h.query_id = hits.query_id)
), s2 AS (SELECT * FROM hits EXCEPT SELECT * FROM s1
), n1 AS (
  SELECT s1.query_id, e.dst AS chunk_id, s1.score * 0.95::DOUBLE AS score, row_number() OVER (PARTITION BY s1.query_id ORDER BY e.dst) AS k
  FROM s1 JOIN edges e ON e.src = s1.chunk_id WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = s1.query_id AND h.chunk_id = e.dst)
), t1 AS (SELECT * FROM n1 WHERE k <= 2
), n2 AS (
  SELECT s2.query_id, e.dst AS chunk_id, s2.score * 0.95::DOUBLE AS score, row_number() OVER (PARTITION BY s2.query_id ORDER BY e.dst) AS k
  FROM s2 JOIN edges e ON e.src = s2.chunk_id WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = s2.query_id AND h.chunk_id = e.dst)
    AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.query_id = s2.query_id AND t1.chunk_id = e.dst)
), everything AS (
  SELECT query_id, chunk_id, score, 0 AS part, rank AS k FROM hits UNION ALL SELECT query_id, chunk_id, score, 1, k FROM t1
  UNION ALL SELECT query_id, chunk_id, score, 2, k FROM n2 WHERE k <= 2
), numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, k)::INTEGER AS rank FROM everything)
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM numbered WHERE rank <= 5"""


def _samples_sql() -> str:
    bands = {"begin": "page_num <= 10", "mid": "page_num - 1 >= total_pages // 2 - 5 AND page_num - 1 < total_pages // 2 + 5", "end": "page_num > total_pages - 10"}
    picks = ", ".join(
        f"min(page_num) FILTER ({b} AND clean <> '') AS {n}_page, arg_min({PREVIEW.format('clean', 400)}, page_num) FILTER ({b} AND clean <> '') AS {n}_text" for n, b in bands.items()
    )
    return f"""WITH {FILLED_SQL}, sized AS (SELECT *, max(page_num) OVER (PARTITION BY doc_id) AS total_pages FROM filled
), found AS (SELECT doc_id, any_value(total_pages) AS total_pages, {picks} FROM sized GROUP BY 1)
SELECT *, CASE WHEN begin_page IS NOT NULL AND mid_page IS NOT NULL AND end_page IS NOT NULL THEN 'everywhere'
  WHEN begin_page IS NOT NULL AND mid_page IS NOT NULL THEN 'check the end' WHEN mid_page IS NOT NULL OR end_page IS NOT NULL THEN 'unstable' ELSE 'poor' END AS verdict FROM found"""


# Chunks in SQL: runs of parts are strings with chr(1) between them, a paragraph's end is the part chr(2), and
# chr(3) begins the runs of a clause that is too long.
_LAST = "split_part(a, chr(1), -1)"
_STEP = f"CASE WHEN {_LAST} = '' THEN a || x WHEN length({_LAST}) + 1 + length(x) <= {chunk.SIZE} THEN a || ' ' || x ELSE a || chr(1) || x END"
_WORDS = (
    f"list_reduce(list_prepend('', flatten(list_transform(string_split({{}}, ' '), lambda w: list_transform(generate_series(0, greatest(0, (length(w) - 1) // {chunk.SIZE})),"
    f" lambda i: substr(w, i * {chunk.SIZE} + 1, {chunk.SIZE}))))), lambda a, x: {_STEP})"
)
CHUNKS_SQL = rf"""{PAGES_SQL}, paragraphs AS (
  SELECT doc_id, page_num, list_filter(list_transform(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n'),
         lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS paras FROM pages_view
), sized AS (SELECT *, length(array_to_string(paras, chr(10) || chr(10))) AS size FROM paragraphs
), split_paras AS (
  SELECT doc_id, page_num, p, list_filter(string_split(regexp_replace(paras[p], '([.!?…]) ([A-ZА-ЯЁ0-9"«(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS said
  FROM sized, generate_series(1, len(paras)) AS g(p) WHERE size > {chunk.SIZE}
), sentences AS (SELECT doc_id, page_num, p, unnest(said) AS s, unnest(generate_series(1, len(said))) AS k FROM split_paras
), clauses AS (
  SELECT doc_id, page_num, p, k, CASE WHEN length(s) <= {chunk.SIZE} THEN [s]
         ELSE list_filter(list_transform(string_split(regexp_replace(s, '([;:,])\s+', '\1' || chr(1), 'g'), chr(1)), lambda c: trim(c)), lambda c: c <> '') END AS parts FROM sentences
), each_clause AS (SELECT doc_id, page_num, p, k, unnest(parts) AS part, unnest(generate_series(1, len(parts))) AS c FROM clauses
), worded AS (
  SELECT doc_id, page_num, p, k, c, CASE WHEN length(part) <= {chunk.SIZE} THEN part ELSE chr(3) || {_WORDS.format("part")} END AS part FROM each_clause
), fitted AS (
  SELECT doc_id, page_num, p, k, list_reduce(list_prepend('', list(part ORDER BY c)),
         lambda a, x: CASE WHEN left(x, 1) = chr(3) THEN CASE WHEN a = '' THEN '' ELSE a || chr(1) END || substr(x, 2) ELSE {_STEP} END) AS runs
  FROM worded GROUP BY 1, 2, 3, 4
), para_parts AS (
  SELECT doc_id, page_num, p, list_append(flatten(list(string_split(runs, chr(1)) ORDER BY k)), chr(2)) AS parts FROM fitted GROUP BY 1, 2, 3
), packed AS (
  SELECT doc_id, page_num, list_filter(string_split(list_reduce(list_prepend('', flatten(list(parts ORDER BY p))),
         lambda a, x: CASE WHEN x = chr(2) THEN CASE WHEN length({_LAST}) >= {int(chunk.FULL_ENOUGH * chunk.SIZE)} THEN a || chr(1) ELSE a END ELSE {_STEP} END), chr(1)), lambda t: t <> '') AS chunks
  FROM para_parts GROUP BY 1, 2
), with_tails AS (
  SELECT doc_id, page_num, CASE WHEN len(chunks) > 1 AND length(chunks[-1]) < {chunk.SHORT_TAIL} AND length(chunks[-2]) + 1 + length(chunks[-1]) <= {int(chunk.TAIL_ROOM * chunk.SIZE)}
         THEN list_append(list_slice(chunks, 1, len(chunks) - 2), chunks[-2] || ' ' || chunks[-1]) ELSE chunks END AS chunks FROM packed
  UNION ALL
  SELECT doc_id, page_num, CASE WHEN size = 0 THEN [] ELSE [array_to_string(paras, chr(10) || chr(10))] END FROM sized WHERE size <= {chunk.SIZE}
), chunk_rows AS (
  SELECT doc_id, doc_id AS title, doc_id || '.pdf' AS source_pdf, page_num, page_num AS page_start, page_num AS page_end, i::INTEGER AS chunk_index,
         printf('%s_p%04d_c%03d', doc_id, page_num, i) AS chunk_id, chunks[i] AS text, length(chunks[i])::INTEGER AS chars
  FROM with_tails, generate_series(1, len(chunks)) AS g(i)
)"""


def _sample_report_sql() -> str:
    bands = " || ".join(f"['', '{title}', '{reports.PAGE}' || coalesce({b}_page::VARCHAR, '-'), '{reports.SHOWN}' || coalesce(nullif({b}_text, ''), '-')]" for b, title in reports.BANDS.items())
    verdict = " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in reports.VERDICTS.items())
    return f"""WITH l AS (SELECT doc_id, ['{reports.RULE}', '{reports.FILE}' || doc_id, '{reports.TOTAL}' || total_pages] || {bands}
        || ['', '{reports.VERDICT}', '{reports.STATUS}' || CASE verdict {verdict} END, ''] AS lines FROM ({_samples_sql()}))
      SELECT doc_id, unnest(range(len(lines)))::INTEGER AS at, unnest(lines) AS line FROM l"""


def _oracles() -> dict[str, str]:
    from marlstone.plans.retrieval import DENSE_SQL

    spaced = r"regexp_replace(strip_accents({}), '\s+', ' ', 'g')"
    return {
        "chunk_documents": f"WITH {CHUNKS_SQL} SELECT * FROM chunk_rows",
        "chunk_stats": f"""WITH {CHUNKS_SQL} SELECT count(DISTINCT doc_id) AS total_docs, count(DISTINCT (doc_id, page_num)) AS total_pages_with_text, count(*) AS total_chunks,
          min(chars) AS chunk_chars_min, max(chars) AS chunk_chars_max, round(avg(chars), 2) AS chunk_chars_avg FROM chunk_rows""",
        "chunk_stats_by_doc": f"WITH {CHUNKS_SQL} SELECT doc_id, any_value(title) AS title, any_value(source_pdf) AS source_pdf, count(DISTINCT page_num) AS pages_with_text, count(*) AS chunks FROM chunk_rows GROUP BY 1",
        "clean_lines": f"WITH {LINED_SQL} SELECT doc_id, page_num, len(lines)::INTEGER AS n_lines, array_to_string(lines, chr(10)) AS text FROM lined",
        "repeated_header_footer": f"WITH {LINED_SQL}, {REPEATED_SQL} SELECT doc_id, line, kind, top_count, bottom_count FROM repeated WHERE kind IS NOT NULL",
        "cleaned_pages": f"WITH {LINED_SQL}, {REPEATED_SQL}, {CLEANED_SQL} SELECT doc_id, page_num, text, raw_chars, dropped_lines, length(text) AS cleaned_chars FROM cleaned",
        "preprocess_report": f"""WITH {LINED_SQL}, {REPEATED_SQL}, {CLEANED_SQL} SELECT doc_id, count(*) AS total_pages, count(*) FILTER (length(text) > 0) AS text_pages,
          count(*) FILTER (length(text) = 0) AS empty_pages, sum(raw_chars)::BIGINT AS raw_chars, sum(length(text))::BIGINT AS cleaned_chars, sum(dropped_lines)::BIGINT AS dropped_lines FROM cleaned GROUP BY 1""",
        "sentence_split": rf"""WITH {PAGES_SQL}, cut AS (
          SELECT doc_id, page_num, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?…]) ([A-ZА-ЯЁ0-9"«(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS s FROM pages_view)
          SELECT doc_id, page_num, len(s)::INTEGER AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INTEGER AS longest, array_to_string(s, chr(10)) AS sentences FROM cut""",
        "chunk_graph_edges": f"WITH {PAGES_SQL}, {LINES_SQL}, {EDGES_SQL.format('lines_view')} SELECT src, dst, edge_type FROM edges",
        "chunk_graph_nodes": f"""WITH {PAGES_SQL}, {EDGES_SQL.format("pages_view")} SELECT chunk_id, doc_id, page_num, coalesce(string_agg(dst, ',' ORDER BY dst), '') AS neighbors
          FROM pages_view LEFT JOIN edges ON src = chunk_id GROUP BY 1, 2, 3""",
        "chunk_graph_stats": f"""WITH {PAGES_SQL}, {LINES_SQL}, {EDGES_SQL.format("lines_view")}, n AS (SELECT count(*) AS total_nodes FROM lines_view), d AS (SELECT src, count(*) AS degree FROM edges GROUP BY 1)
          SELECT total_nodes, (SELECT count(*) FROM edges) AS total_edges_directed, (SELECT max(degree) FROM d) AS max_degree,
            (SELECT count(*) // 2 FROM edges WHERE edge_type = 'prev_next') AS prev_next, (SELECT count(*) // 2 FROM edges WHERE edge_type = 'same_page') AS same_page,
            (SELECT count(*) FROM edges WHERE edge_type = 'adjacent_page') AS adjacent_page, round((SELECT count(*) FROM edges) / total_nodes, 4) AS avg_degree FROM n""",
        "graph_expand": f"WITH {PAGES_SQL}, {EDGES_SQL.format('pages_view')}, {DENSE_SQL.format('q.vec_id % 100 = 0')}, {GRAPH_EXPAND_SQL}",
        "qc_status": f"""WITH {FILLED_SQL}, c AS (SELECT doc_id, count(*) AS total_pages, count(*) FILTER (clean <> '') AS text_pages, count(*) FILTER (clean = '') AS empty_pages,
            min(page_num) FILTER (clean <> '') AS first_text_page, coalesce(arg_min({PREVIEW.format("clean", 200)}, page_num) FILTER (clean <> ''), '') AS preview FROM filled GROUP BY 1)
          SELECT doc_id, CASE WHEN text_pages = 0 THEN 'bad' WHEN length(preview) < 30 THEN 'acceptable' WHEN empty_pages / total_pages > 0.5 THEN 'bad' WHEN empty_pages / total_pages > 0.2 THEN 'acceptable' ELSE 'good' END AS status,
            total_pages, text_pages, empty_pages, first_text_page, preview FROM c""",
        "page_samples": _samples_sql(),
        "header_report": f"""WITH {LINED_SQL}, {REPEATED_SQL}, k AS (SELECT doc_id, list(line ORDER BY line) FILTER (kind = 'header') AS headers, list(line ORDER BY line) FILTER (kind = 'footer') AS footers FROM repeated GROUP BY 1
          ), l AS (SELECT doc_id, ['{reports.RULE}', '{reports.FILE}' || doc_id, 'Headers{reports.FOUND}' || coalesce(len(headers), 0)] || coalesce(list_transform(headers, lambda x: '[HEADER] ' || x), ['[HEADER] {reports.NONE}'])
            || ['Footers{reports.FOUND}' || coalesce(len(footers), 0)] || coalesce(list_transform(footers, lambda x: '[FOOTER] ' || x), ['[FOOTER] {reports.NONE}']) || [''] AS lines FROM sizes LEFT JOIN k USING (doc_id))
          SELECT doc_id, unnest(range(len(lines)))::INTEGER AS at, unnest(lines) AS line FROM l""",
        "sample_report": _sample_report_sql(),
        "filename_key": f"WITH {URL_FILES_SQL} SELECT page_id, filename, trim(regexp_replace(regexp_replace(lower(strip_accents(filename)), '\\.pdf$', ''), '[^a-z0-9]+', ' ', 'g')) AS key FROM files",
        "evaluation_filename_key": f"WITH {URL_FILES_SQL} SELECT page_id, lower({spaced.format('filename')}) AS key FROM files",
        "stable_point_id": f"WITH {PAGES_SQL} SELECT chunk_id, (('0x' || left(sha1(source_pdf || ':' || chunk_id), 16))::UBIGINT)::VARCHAR AS point_id FROM pages_view",
        "registry_enrich": f"""WITH {PAGES_SQL}, r AS (SELECT source, min(doc_id) AS line FROM documents GROUP BY 1 HAVING min(doc_id) % 3 = 0)
          SELECT chunk_id, CASE WHEN r.source IS NOT NULL THEN upper(source_pdf) END AS registry_filename, CASE WHEN r.source IS NOT NULL THEN sha256(source_pdf) END AS registry_doc_id,
            CASE WHEN r.source IS NOT NULL THEN 'b' END AS s3_bucket, 'raw/' || r.source AS s3_key,
            coalesce('https://files.example/b/raw/' || r.source, 'none') || '#page=' || page_num || '&zoom=page-fit' AS url
          FROM pages_view LEFT JOIN r ON r.source = pages_view.doc_id""",
        "new_sources_anti": "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT DISTINCT sha256 FROM d WHERE sha256 NOT IN (SELECT sha256 FROM d JOIN labels USING (doc_id))",
    }


ORACLES = _oracles()
