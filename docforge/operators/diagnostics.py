"""Reports on what parsing and cleaning left open: missing values, repeated tables, placeholders that do not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import metadata as M
from docforge.operators import tables as B

# Categories, states and actions of the report on missing values.
BUDGET, DEADLINE, START, NUMBER = "예산", "마감일", "시작일", "공고번호"
START_KEYWORDS = ("참여 시작", "참가 시작", "접수 시작", "접수기간", "제안서 접수", "시작일")
LOOK_AGAIN = "재검토 필요"
NOT_HELD, NO_ACTION = "N/A", "조치 불필요"
OPEN_ORIGINAL, COMPARE, CONFIRM = "값 없음 - 원본 직접 확인 필요", "확정값과 스니펫이 일치하는지 확인", "candidate 스니펫 확인 후 확정값 기입"
UNDECIDED, START_IN_TEXT = "본문에 마감일 언급 없음", "본문의 날짜가 맞는지 확인"
# Limits of repeated tables, words of page headers, and names of elements outside the flow of text.
FULL_FROM = 0.9
HEADER_WORDS = ("문서번호", "개정번호")
OUTSIDE = "header|footer|footnote|endnote|annotation"


def contexts(text: Column, keywords: tuple[str, ...], before: int = 20, width: int = 200) -> Column:
    """What stands around each keyword, in the order of the keywords, on one line each."""

    def around(at: Column) -> Column:
        begin = F.greatest(at - before, F.lit(1))
        return F.trim(F.regexp_replace(F.substring(text, begin, at + width - begin), "[\r\n]", " "))

    return F.concat(*[F.transform(T.occurrences(text, F.lit(word)), around) for word in keywords])


def missing_values(notices: DataFrame, merged: DataFrame) -> DataFrame:
    """(doc_id, category, source, current, classification, snippet, action): each missing value of a notice, looked for in its text.

    ``notices``: doc_id, raw, deadline, number_missing; ``merged``: doc_id, source, text, budget, deadline_clean, start,
    start_estimated. A notice that was not merged has the action N/A. One pass, whatever the number of categories.
    """
    rows = notices.select("doc_id", "raw", "deadline", "number_missing").join(merged.select("doc_id", "source", "text", "budget", "deadline_clean", "start", "start_estimated", F.lit(True).alias("held")), "doc_id", "left")
    rows = rows.withColumn("held", F.coalesce("held", F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("b", M.budget_candidate(F.col("text"))).withColumn("d", M.deadline_candidate(F.col("text"))).withColumn("s", contexts(F.col("text"), START_KEYWORDS))
    held, none = F.col("held"), F.lit(None).cast("string")

    def row(category: str, current: Column, told: Column, snippet: Column, action: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.when(held, F.col("source")).alias("source"), F.when(held, current.cast("string")).alias("current"), F.when(held, told).alias("classification"), F.when(held, snippet).alias("snippet"), action.alias("action"))

    settled = F.coalesce(F.col("budget") != 0, F.lit(False))
    unknown = F.col("raw").isNull() | F.isnan(F.col("raw").cast("double")) | (F.col("raw") <= M.UNKNOWN_UP_TO)
    amount = row(BUDGET, F.col("budget"), F.col("b.source"), F.coalesce("b.snippet", F.get(contexts(F.col("text"), M.BUDGET_KEYWORDS), F.lit(0))),
                 F.when(~held, NOT_HELD).when(settled, COMPARE).when(F.col("b.source") == "no_info", OPEN_ORIGINAL).otherwise(CONFIRM))
    end = row(DEADLINE, F.col("deadline_clean"), F.col("d.source"), F.coalesce("d.snippet", F.get(contexts(F.col("text"), M.DEADLINE_KEYWORDS), F.lit(0))),
              F.when(~held, NOT_HELD).when(F.col("d.source") == "no_info", UNDECIDED).when(F.col("d.source") == "announced_later", NO_ACTION).otherwise(CONFIRM))
    start = row(START, F.col("start"), F.lit(LOOK_AGAIN), F.get("s", F.lit(0)), F.lit(START_IN_TEXT))
    number = F.struct(F.lit(NUMBER).alias("category"), none.alias("source"), none.alias("current"), none.alias("classification"), none.alias("snippet"), F.lit(NO_ACTION).alias("action"))
    dated = F.coalesce(F.col("start_estimated"), F.lit(False)) & F.exists("s", lambda x: x.rlike(M.DATE))
    found = F.array(F.when(unknown, amount), F.when(F.col("deadline").isNull(), end), F.when(dated, start), F.when(F.col("number_missing"), number))
    return rows.select("doc_id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def repeat_states(tables: DataFrame, cells: str = "cells", body: str = "body") -> DataFrame:
    """Tables with a non-blank cell, with repeat_ratio, state (full, partial, unique) and header_like."""
    words = F.flatten(F.transform(cells, lambda row: F.transform(row, lambda c: F.coalesce(c["text"], F.lit("")))))
    joined = F.array_join(words, " ")
    ratio = F.col("repeat_ratio")
    state = F.when(ratio >= FULL_FROM, "full").when(ratio > 0, "partial").otherwise("unique")
    header = joined.contains(HEADER_WORDS[0]) & joined.contains(HEADER_WORDS[1])
    return tables.where(F.exists(words, lambda w: F.trim(w) != "")).withColumn("repeat_ratio", B.repeat_ratio(F.col(cells), F.col(body))).withColumn("state", state).withColumn("header_like", header)


def shapes(tables: DataFrame, cells: str = "cells", top: int = 15) -> DataFrame:
    """(n_rows, n_columns, n): the most frequent shapes, ties by shape; the report's length is ``top``."""
    wide = F.coalesce(F.array_max(F.transform(cells, lambda row: F.size(row))), F.lit(0))
    return tables.groupBy(F.size(cells).alias("n_rows"), wide.alias("n_columns")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_rows", "n_columns").limit(top)


def fullest_pages(tables: DataFrame, page: str, top: int = 20) -> DataFrame:
    """(page, n): pages with most tables, ties by page."""
    return tables.groupBy(page).agg(F.count("*").alias("n")).orderBy(F.desc("n"), page).limit(top)


def table_nesting(markup: Column) -> Column:
    """(n_tables, n_nested, n_outside) of well-formed markup: tables in all, inside others, and inside headers, footers or notes."""
    tags = F.regexp_extract_all(F.lower(markup), F.lit(rf"<(/?(?:table|[\w:.-]*(?:{OUTSIDE})[\w:.-]*))(?=[\s>])[^>]*(?<!/)>"), F.lit(1))
    first = F.struct(*[F.lit(0).alias(name) for name in ("depth", "out", "n_tables", "n_nested", "n_outside")])

    def step(s: Column, tag: Column) -> Column:
        table, move = tag.isin("table", "/table"), F.when(tag.startswith("/"), -1).otherwise(1)
        opens = (table & (move == 1)).cast("int")
        return F.struct(
            (s["depth"] + F.when(table, move).otherwise(0)).alias("depth"), (s["out"] + F.when(table, 0).otherwise(move)).alias("out"), (s["n_tables"] + opens).alias("n_tables"),
            (s["n_nested"] + opens * (s["depth"] > 0).cast("int")).alias("n_nested"), (s["n_outside"] + opens * (s["out"] > 0).cast("int")).alias("n_outside"),
        )

    return F.aggregate(F.coalesce(tags, F.expr(T.EMPTY)), first, step, lambda s: F.struct(s["n_tables"].alias("n_tables"), s["n_nested"].alias("n_nested"), s["n_outside"].alias("n_outside")))


def placeholder_report(docs: DataFrame, markup: str = "markup", text: str = "text") -> DataFrame:
    """Documents with n_marks (placeholder lines), the nesting of their tables, and what explains a difference: nested tables, tables outside the flow, or nothing known."""
    marks = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?m){T.TABLE_MARK}"))
    rows = docs.withColumn("n_marks", marks).withColumn("_n", table_nesting(F.col(markup)))
    rows = rows.select("*", "_n.*").drop("_n")
    why = F.when(F.col("n_tables") == F.col("n_marks"), "none").when(F.col("n_tables") - F.col("n_nested") == F.col("n_marks"), "nested").when(F.col("n_tables") - F.col("n_outside") == F.col("n_marks"), "outside").otherwise("unknown")
    return rows.withColumn("difference", why)
