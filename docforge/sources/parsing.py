"""Rules on what parsers of documents give: pages, recognised lines, outcomes, files that are not there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import text as T

# Notes on the search for tables.
TABLES_OFF, TABLES_FAILED, NO_TABLES, TABLES_FOUND = "표 추출 비활성화", "표 추출 실패: %s", "표 추출 시도함 - 표를 찾지 못함", "표 %d개 추출 성공"
MISSING_FILE = "파일 없음: %s"
LEAST_SCORE = 0.5


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def page_texts(pages: Column, recognised: Column, least: int = T.PAGE_TEXT_LEAST) -> Column:
    """(text, n_pages, n_scanned, used_ocr) of the texts of pages.

    A page with fewer than ``least`` characters is scanned: what was recognised stands for it, nothing where that failed
    (a null in ``recognised``). Where ``recognised`` itself is null nothing was tried and pages stay as they are.
    """
    scanned = lambda p: F.char_length(_bare(p)) < least
    read = F.transform(pages, lambda p, i: F.when(scanned(p) & recognised.isNotNull(), _bare(F.get(recognised, i))).otherwise(_bare(p)))
    used = F.exists(F.transform(pages, lambda p, i: scanned(p) & F.get(recognised, i).isNotNull()), lambda x: x)
    n_scanned = F.size(F.filter(pages, scanned))
    return F.struct(F.array_join(read, "\n\n").alias("text"), F.size(pages).alias("n_pages"), n_scanned.alias("n_scanned"), F.coalesce(used, F.lit(False)).alias("used_ocr"))


def recognised_lines(texts: Column, scores: Column, least: float = LEAST_SCORE) -> Column:
    """Recognised lines with at least the score, by line ends; as many scores as texts, else an error."""
    kept = F.zip_with(texts, scores, lambda t, s: F.when((_bare(t) != "") & ~F.isnan(s.cast("double")) & (s >= least), _bare(t)))
    return F.when(F.size(texts) == F.size(scores), F.array_join(kept, "\n")).otherwise(F.raise_error(F.lit("as many scores as texts are needed")))


def parse_outcome(text: Column, text_error: Column, n_tables: Column, table_error: Column, tables_asked: Column, bypass: Column) -> Column:
    """(text, n_tables, error, table_note): a document fails only if its text failed and is empty; the note tells "no table" from "failed"."""
    failed = text_error.isNotNull() & (F.coalesce(text, F.lit("")) == "")
    note = F.when(table_error.isNotNull(), F.format_string(TABLES_FAILED, table_error)).when(F.coalesce(n_tables, F.lit(0)) == 0, NO_TABLES).otherwise(F.format_string(TABLES_FOUND, n_tables))
    note = F.when(tables_asked, F.concat_ws(" | ", note, bypass)).otherwise(TABLES_OFF)
    return F.struct(
        F.when(failed, "").otherwise(F.coalesce(text, F.lit(""))).alias("text"), F.when(failed | ~tables_asked, 0).otherwise(F.coalesce(n_tables, F.lit(0))).alias("n_tables"),
        F.when(failed, text_error).alias("error"), F.when(~failed, note).alias("table_note"),
    )


def with_missing_files(wanted: DataFrame, parsed: DataFrame, path: str = "path") -> DataFrame:
    """Every wanted file: its parse, or an error that it is not there."""
    out = wanted.select(path).distinct().join(parsed.withColumn("_found", F.lit(True)), path, "left")
    return out.withColumn("error", F.when(F.col("_found"), F.col("error")).otherwise(F.format_string(MISSING_FILE, F.col(path)))).drop("_found")
