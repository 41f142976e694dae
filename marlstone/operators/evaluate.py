"""Evaluation of answers against gold references, and the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.names import evaluation_key
from marlstone.functions.text import is_refusal, shortened, squeezed, stripped
from marlstone.operators.citations import numbers


def _pages(sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(sources, lambda s: F.coalesce(s["page_numbers"], F.array().cast("array<int>"))))))


def keyed_sources(runs: DataFrame) -> DataFrame:
    """runs with the key of each source's file name; keys are made for distinct names."""
    rows = runs.select("question_id", F.posexplode("sources").alias("at", "s"))
    names = rows.select(F.col("s.filename").alias("filename")).distinct().withColumn("key", evaluation_key(F.col("filename")))
    joined = rows.withColumn("filename", F.col("s.filename")).join(names, "filename", "left")
    source = F.struct("at", F.col("s.index").alias("index"), F.col("s.filename").alias("filename"), "key", F.col("s.page_numbers").alias("page_numbers"))
    lists = joined.groupBy("question_id").agg(F.array_sort(F.collect_list(source)).alias("keyed"))
    none = F.array().cast("array<struct<at:int,index:int,filename:string,key:string,page_numbers:array<int>>>")
    return runs.join(lists, "question_id", "left").withColumn("keyed", F.coalesce(F.col("keyed").cast(none_type()), none))


def none_type() -> str:
    return "array<struct<at:int,index:int,filename:string,key:string,page_numbers:array<int>>>"


def gold_references(gold: DataFrame) -> DataFrame:
    """question_id, at, ref_kind, filename, key, pages, gold_answer: the primary reference, then the
    alternatives. A reference need not have an answer of its own."""

    def reference(kind: str, r: Column, answered: bool) -> Column:
        said = r["gold_answer"] if answered else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("ref_kind"), r["source_filename"].alias("filename"), r["source_pages"].alias("pages"), stripped(F.coalesce(said, F.lit(""))).alias("gold_answer"))

    answered = {c: "gold_answer" in gold.schema[c].simpleString() for c in ("primary_reference", "alternative_references")}
    others = F.transform("alternative_references", lambda r: reference("alternative", r, answered["alternative_references"]))
    first = F.array(reference("primary", F.col("primary_reference"), answered["primary_reference"]))
    refs = F.when(F.col("alternative_references").isNull(), first).otherwise(F.concat(first, others))
    rows = gold.select("question_id", F.posexplode(refs).alias("at", "r")).select("question_id", "at", "r.ref_kind", "r.filename", F.coalesce("r.pages", F.array().cast("array<int>")).alias("pages"), "r.gold_answer")
    names = rows.select("filename").distinct().withColumn("key", evaluation_key(F.col("filename")))
    return rows.join(names, "filename", "left").select("question_id", "at", "ref_kind", "filename", F.coalesce("key", F.lit("")).alias("key"), F.array_distinct("pages").alias("pages"), "gold_answer")


_NAMES = ("page_hit", "all_gold_pages_covered", "exact_cited_pages_match")
_JUDGED = (
    "question_id", "status", "expected_answerable", "predicted_has_answer", "refusal_match", "answerability_match", "answer_citations", "cited_source_pages_all", "cited_source_pages",
    "cited_source_pages_any_gold", "gold_source_match_found", "gold_source_match_found_any", "matched_gold_references", *(f"{n}{s}" for n in _NAMES for s in ("", "_legacy", "_any")),
)


def records(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """A row of judgements for each question. gold: question_id, answerable, primary_reference,
    alternative_references; runs: question_id, status, model_answer, sources (index, filename,
    page_numbers)."""
    return _judged(gold, runs).select(*_JUDGED)


def full_records(gold: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """All that is kept of a run: the judgements, the question and its references, what the sources were,
    and how the run went (started_at_utc and so on, where runs has them). matched_gold_references are the
    references of which a page was cited. A question without text is `invalid_input`."""

    def of(df: DataFrame, name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)

    asked = gold.select(
        "question_id", squeezed(F.coalesce(of(gold, "question"), F.lit(""))).alias("question"), stripped(F.coalesce(of(gold, "question_type"), F.lit(""))).alias("question_type"),
        stripped(F.coalesce(of(gold, "gold_answer"), F.lit(""))).alias("gold_answer"), F.coalesce(of(gold, "notes"), of(gold, "comment")).alias("notes"),
        F.col("primary_reference.source_filename").alias("source_filename"), F.coalesce("primary_reference.source_pages", F.array().cast("array<int>")).alias("gold_source_pages"),
    )
    went = runs.select(
        "question_id", "model_answer", F.col("sources").alias("parsed_sources"), of(runs, "started_at_utc"), of(runs, "finished_at_utc"), of(runs, "duration_sec", "double"), of(runs, "returncode", "int"),
        of(runs, "command", "array<string>"), F.array_join(of(runs, "command", "array<string>"), " ").alias("command_str"), F.col("stdout" if "stdout" in runs.columns else "status").alias("_out"), of(runs, "stderr"),
    )
    out = F.col("_out") if "stdout" in runs.columns else F.lit(None).cast("string")
    own = [c for c in runs.columns if c not in ("question_id", "status")]
    joined = _judged(gold, runs).drop(*own, "matched_gold_references").join(asked, "question_id").join(went, "question_id")
    status = F.when(F.col("question") == "", "invalid_input").otherwise(F.col("status"))
    kept = [c for c in _JUDGED if c not in ("status", "matched_gold_references")]
    return joined.select(
        F.lit(run_id).alias("run_id"), status.alias("status"), *kept, *(c for c in asked.columns if c != "question_id"), evaluation_key(F.col("source_filename")).alias("gold_source_filename_normalized"),
        "model_answer", "parsed_sources", F.array_sort(F.array_distinct(F.transform("active", lambda s: s["index"]))).alias("cited_source_indexes_all"), "cited_source_indexes_gold_doc", "cited_source_indexes_any_gold",
        F.transform("active", lambda s: F.coalesce(s["filename"], F.lit(""))).alias("cited_source_filenames_all"), "cited_source_filenames_gold_doc", F.transform("keyed", lambda s: s["key"]).alias("debug_all_filenames"),
        "gold_references", F.col("matched_references").alias("matched_gold_references"),
        "started_at_utc", "finished_at_utc", "duration_sec", "returncode", "command", "command_str", out.alias("stdout_raw"), F.col("stderr").alias("stderr_raw"),
    )


def totals(analysed: DataFrame) -> DataFrame:
    """One row: rows of an analysis, and how many say that a source was found or a page was hit."""
    return analysed.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("gold_source_match_found") == "True").alias("gold_source_match_true"),
        F.count_if(F.col("page_hit") == "True").alias("page_hit_true"),
        F.count_if(F.col("page_hit") == "False").alias("page_hit_false"),
    )


def _judged(gold: DataFrame, runs: DataFrame) -> DataFrame:
    cited = F.array_sort(F.array_distinct(numbers(F.col("model_answer"))))
    base = keyed_sources(runs).join(gold.select("question_id", "answerable"), "question_id")
    base = base.withColumn("answer_citations", cited)
    active = F.when(F.size("answer_citations") == 0, F.col("keyed")).otherwise(F.filter("keyed", lambda s: F.array_contains(F.col("answer_citations"), s["index"].cast("long"))))
    base = base.withColumn("active", active).withColumn("pages_all", _pages(F.col("active")))
    refs = gold_references(gold).join(base.select("question_id", "active", "pages_all"), "question_id")
    matching = F.filter("active", lambda s: s["key"] == F.col("key"))
    judged = refs.withColumn("matching", matching).withColumn("found_pages", _pages(F.col("matching")))
    some = F.size("pages") > 0

    def judge(pages: str) -> list[Column]:
        p, got = F.col("pages"), F.col(pages)
        return [
            some & F.arrays_overlap(p, got),
            some & (F.size(F.array_except(p, got)) == 0),
            some & (F.array_sort(p) == got),
        ]

    first, named = F.col("ref_kind") == "primary", F.col("key") != ""
    aggregates = []
    for n, aware, legacy in zip(_NAMES, judge("found_pages"), judge("pages_all"), strict=True):
        aggregates += [
            F.bool_or(first & aware).alias(n),
            F.bool_or(first & legacy).alias(f"{n}_legacy"),
            F.bool_or(named & aware).alias(f"{n}_any"),
        ]
    found = F.size("matching") > 0
    none = F.array().cast("array<int>")
    reference = F.struct("at", "ref_kind", F.col("filename").alias("source_filename"), F.col("pages").alias("source_pages"), F.col("key").alias("source_filename_normalized"), "gold_answer")

    def gathered(of: Column, what: Column) -> Column:
        return F.flatten(F.collect_list(F.when(of, what)))

    def indexes(of: Column) -> Column:
        return F.array_sort(F.array_distinct(gathered(of, F.transform("matching", lambda s: s["index"]))))

    verdicts = judged.groupBy("question_id").agg(
        *aggregates,
        F.bool_or(first & found).alias("gold_source_match_found"),
        F.bool_or(named & found).alias("gold_source_match_found_any"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(named, F.col("found_pages")).otherwise(none))))).alias("cited_source_pages_any_gold"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(first, F.col("found_pages")).otherwise(none))))).alias("cited_source_pages"),
        F.count_if(named & some & F.arrays_overlap("pages", "found_pages")).alias("matched_gold_references"),
        indexes(first).alias("cited_source_indexes_gold_doc"),
        indexes(named).alias("cited_source_indexes_any_gold"),
        gathered(first, F.transform("matching", lambda s: F.coalesce(s["filename"], F.lit("")))).alias("cited_source_filenames_gold_doc"),
        F.array_sort(F.collect_list(reference)).alias("gold_references"),
        F.array_sort(F.collect_list(F.when(named & some & F.arrays_overlap("pages", "found_pages"), reference))).alias("matched_references"),
    )
    has_answer = (F.coalesce("model_answer", F.lit("")) != "") & ~is_refusal(F.col("model_answer"))
    out = base.join(verdicts, "question_id").withColumn("predicted_has_answer", has_answer)
    return out.withColumns(
        {
            "expected_answerable": F.col("answerable"), "refusal_match": is_refusal(F.col("model_answer")),
            "answerability_match": F.col("predicted_has_answer") == F.col("answerable"), "cited_source_pages_all": F.col("pages_all"),
        }
    )


def summary(records: DataFrame) -> DataFrame:
    """One row: status counts and rates. Both readings of the gold source match are given."""
    ok = F.col("status").isin("ok", "cli_error")
    yes, no = ok & F.col("expected_answerable"), ok & ~F.col("expected_answerable")

    def rate(hit: Column, among: Column) -> Column:
        return F.round(F.count_if(among & hit) / F.nullif(F.count_if(among), F.lit(0)), 4)

    on_yes = {f"{n}_rate_on_answerable{s}": F.col(f"{m}{t}") for n, m in (("page_hit", "page_hit"), ("all_gold_pages_covered", "all_gold_pages_covered"), ("exact_cited_pages_match", "exact_cited_pages_match")) for s, t in (("", "_any"), ("_legacy", "_legacy"))}
    return records.agg(
        F.count(F.lit(1)).alias("total_questions"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "cli_error", "timeout", "invalid_input")),
        F.count_if(~ok).alias("other_errors"),
        rate(F.col("answerability_match"), ok).alias("answerability_accuracy_proxy"),
        rate(~F.col("predicted_has_answer"), no).alias("no_answer_accuracy"),
        rate(F.size("answer_citations") > 0, ok).alias("citation_presence_rate"),
        rate(F.col("gold_source_match_found"), yes).alias("gold_source_match_found_rate_primary"),
        rate(F.col("gold_source_match_found_any"), yes).alias("gold_source_match_found_rate_any"),
        *(rate(c, yes).alias(n) for n, c in on_yes.items()),
    )


def _joined(c: str) -> Column:
    return F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))


def _said(c: str) -> Column:
    return F.when(F.col(c), "True").when(~F.col(c), "False").otherwise("")


def analysis(gold: DataFrame, runs: DataFrame, judged: DataFrame) -> DataFrame:
    """Ten string columns for reading by people."""
    alternatives = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("alternative_references", F.array().cast("array<struct<source_filename:string,source_pages:array<int>>>")), lambda r: r["source_pages"]))))
    rows = gold.withColumn("alt_pages", alternatives).join(runs.select("question_id", "model_answer"), "question_id").join(judged, "question_id")
    return rows.select(
        stripped(F.col("question_id").cast("string")).alias("question_id"),
        squeezed(F.coalesce("question", F.lit(""))).alias("question"),
        squeezed(F.coalesce("primary_reference.source_filename", F.lit(""))).alias("gold_source_filename"),
        F.coalesce(F.array_join(F.col("primary_reference.source_pages").cast("array<string>"), ","), F.lit("")).alias("gold_pages_prim_ref"),
        _joined("alt_pages").alias("gold_pages_alt_ref"),
        _said("gold_source_match_found_any").alias("gold_source_match_found"),
        _joined("cited_source_pages_any_gold").alias("gold_source_cited_pages"),
        _said("page_hit_any").alias("page_hit"),
        squeezed(F.coalesce("model_answer", F.lit(""))).alias("model_answer"),
        F.lit("").alias("manual_error_type"),
    )


def markdown(analysed: DataFrame) -> DataFrame:
    """Lines of a table, one for each row; answers are shortened."""
    columns = [F.replace(F.regexp_replace(c, "\n", " "), F.lit("|"), F.lit("\\|")) for c in [*(F.col(x) for x in analysed.columns if x != "model_answer"), shortened(F.col("model_answer"), 180)]]
    return analysed.select("question_id", F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |")).alias("line"))
