"""Reports to be read: lines of text for each document, in the order in which they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of the reports.
RULE = "=" * 120
FILE, FOUND, NONE = "Файл: ", " найдено: ", "нет"
TOTAL, PAGE, SHOWN, NOTHING = "Всего страниц: ", "Страница: ", "Фрагмент: ", "-"
BANDS = {"begin": "[НАЧАЛО]", "mid": "[СЕРЕДИНА]", "end": "[КОНЕЦ]"}
VERDICT, STATUS = "[ПРЕДВАРИТЕЛЬНАЯ ОЦЕНКА]", "Статус: "
VERDICTS = {
    "everywhere": "текст найден в начале, середине и конце документа.",
    "check the end": "текст найден в начале и середине, конец нужно проверить вручную.",
    "unstable": "текст извлекается нестабильно, нужна ручная проверка.",
    "poor": "текст извлекается плохо, нужна дополнительная диагностика.",
}


def _said(label: str, value: Column | None = None) -> Column:
    return F.array(F.lit(label) if value is None else F.concat(F.lit(label), value.cast("string")))


def _marked(mark: str, lines: Column) -> Column:
    each = F.transform(lines, lambda x: F.concat(F.lit(mark), x))
    return F.when(F.size(lines) > 0, each).otherwise(_said(mark + NONE))


def _lines(rows: DataFrame, *parts: Column) -> DataFrame:
    return rows.select("doc_id", F.posexplode(F.concat(*parts)).alias("at", "line"))


def header_report(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, at, line: the headers and footers of every document (doc_id), each kind in order, by what
    clean.repeated_lines found. A line must repeat on a share of the pages to be there, so a document has few."""
    kinds = {"header": "Headers", "footer": "Footers"}
    found = repeated.groupBy("doc_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("line")))).alias(k) for k in kinds))
    rows = documents.select("doc_id").distinct().join(found, "doc_id", "left")
    parts = [_said(RULE), _said(FILE, F.col("doc_id"))]
    for kind, title in kinds.items():
        lines = F.coalesce(F.col(kind), F.array().cast("array<string>"))
        parts += [_said(title + FOUND, F.size(lines)), _marked(f"[{kind.upper()}] ", lines)]
    return _lines(rows, *parts, _said(""))


def sample_report(samples: DataFrame) -> DataFrame:
    """doc_id, at, line: what qc.samples found in each document's three bands, and its verdict."""
    parts = [_said(RULE), _said(FILE, F.col("doc_id")), _said(TOTAL, F.col("total_pages"))]
    for band, title in BANDS.items():
        page, text = F.col(f"{band}_page").cast("string"), F.col(f"{band}_text")
        parts += [_said(""), _said(title), _said(PAGE, F.coalesce(page, F.lit(NOTHING))), _said(SHOWN, F.coalesce(F.nullif(text, F.lit("")), F.lit(NOTHING)))]
    verdict = F.coalesce(*(F.when(F.col("verdict") == name, F.lit(text)) for name, text in VERDICTS.items()))
    return _lines(samples, *parts, _said(""), _said(VERDICT), _said(STATUS, verdict), _said(""))
