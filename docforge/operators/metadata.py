"""Cleaning of record metadata: amounts, dates, overrides, exclusions, duplicate titles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

# Keywords in the order in which they are tried, and the words and patterns looked for around them.
BUDGET_KEYWORDS = ("사업예산", "사업 금액", "사업금액", "사업비", "추정가격")
UNDISCLOSED_WORDS = ("비공개", "공개하지", "포함되지 않", "미포함")
MONEY = r"[\d,]+\s*(?:억|천만|백만|만)?\s*원"
DEADLINE_KEYWORDS = ("마감일시", "마감 일시", "입찰 마감", "제출 마감", "접수 마감", "마감일", "마감")
DATE = r"\d{4}\s*[.\-]\s*\d{1,2}\s*[.\-]\s*\d{1,2}|\d{4}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일"
UNKNOWN_UP_TO = 1


def unique_ids(df: DataFrame, name: str) -> DataFrame:
    """The frame with doc_id taken from ``name``; raises ValueError if a name repeats."""
    twice = df.groupBy(name).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{name} repeats: {[r[name] for r in twice]}")
    return df.withColumn("doc_id", F.col(name))


def clean_budget(df: DataFrame, raw: str) -> DataFrame:
    """budget_unknown, budget, budget_source: null, not-a-number and values up to 1 are unknown."""
    value = F.when(F.isnan(F.col(raw).cast("double")), None).otherwise(F.col(raw).cast("double"))
    unknown = value.isNull() | (value <= UNKNOWN_UP_TO)
    return df.withColumn("budget_unknown", unknown).withColumn("budget", F.when(~unknown, value)).withColumn("budget_source", F.when(~unknown, "csv"))


def _decider(text: Column, word: str, before: int, after: int, decide):
    n = len(word)

    def at(p: Column) -> Column:
        start = F.greatest(p - before, F.lit(1))
        return decide(word, F.substring(text, start, p + n + after - start), F.substring(text, p + n, F.lit(after)))

    return at


def _scan(text: Column, keywords: tuple[str, ...], before: int, after: int, decide) -> Column:
    """The first decision of all windows: keywords in their order, occurrences in theirs."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for word in keywords:
        found.append(F.filter(F.transform(T.occurrences(text, F.lit(word)), _decider(text, word, before, after, decide)), lambda d: d.isNotNull()))
    none = F.struct(F.lit("no_info").alias("source"), F.lit(None).cast("string").alias("snippet"))
    return F.coalesce(F.get(F.concat(*found), F.lit(0)), none)


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[\r\n]", " "))


def budget_candidate(text: Column, keywords: tuple[str, ...] = BUDGET_KEYWORDS, undisclosed: tuple[str, ...] = UNDISCLOSED_WORDS, money: str = MONEY) -> Column:
    """(source, snippet): a window of 150 characters after a keyword says undisclosed, or shows an amount."""

    def decide(word: str, _: Column, behind: Column) -> Column:
        hidden = F.lit(False)
        for w in undisclosed:
            hidden = hidden | behind.contains(w)
        told = F.struct(F.lit("undisclosed").alias("source"), F.lit(None).cast("string").alias("snippet"))
        return F.when(hidden, told).when(behind.rlike(money), F.struct(F.lit("candidate").alias("source"), _flat(F.concat(F.lit(word), F.substring(behind, 1, 100))).alias("snippet")))

    return _scan(text, keywords, 0, 150, decide)


def deadline_candidate(text: Column, keywords: tuple[str, ...] = DEADLINE_KEYWORDS, later: str = "추후", apart: tuple[str, str] = ("별도", "공지"), date: str = DATE) -> Column:
    """(source, snippet): a window from 10 characters before to 80 behind a keyword says that a date follows later, or shows one."""

    def decide(_: str, window: Column, __: Column) -> Column:
        told = F.struct(F.lit("announced_later").alias("source"), F.lit(None).cast("string").alias("snippet"))
        waits = window.contains(later) | (window.contains(apart[0]) & window.contains(apart[1]))
        return F.when(waits, told).when(window.rlike(date), F.struct(F.lit("candidate").alias("source"), _flat(window).alias("snippet")))

    return _scan(text, keywords, 10, 80, decide)


def resolve(df: DataFrame, unknown: str, source: str, snippet: str, candidate: Column) -> DataFrame:
    """Look again at rows that are unknown and not confirmed by hand; others stay."""
    again = F.col(unknown) & (F.coalesce(F.col(source), F.lit("")) != "manual_confirmed")
    df = df.withColumn("_told", F.when(again, candidate))
    new = F.when(again, F.when(F.col("_told.source") == "candidate", F.col("_told.snippet"))).otherwise(F.col(snippet))
    return df.withColumn(snippet, new).withColumn(source, F.when(again, F.col("_told.source")).otherwise(F.col(source))).drop("_told")


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, confirmed: str, order: str, value: str, source: str, unknown: str) -> DataFrame:
    """Values confirmed by hand: of several for a key the last (by ``order``) holds."""
    last = overrides.groupBy(key).agg(F.max_by(confirmed, order).alias("_confirmed"), F.lit(True).alias("_has"))
    out = df.join(last, key, "left")
    has = F.coalesce("_has", F.lit(False))
    return out.withColumn(value, F.when(has, F.col("_confirmed")).otherwise(F.col(value))).withColumn(source, F.when(has, "manual_confirmed").otherwise(F.col(source))).withColumn(unknown, F.when(has, False).otherwise(F.col(unknown))).drop("_confirmed", "_has")


def impute_start(df: DataFrame, start: str, published: str) -> DataFrame:
    """A missing start becomes the publication date; ``start_estimated`` tells which."""
    return df.withColumn("start_estimated", F.col(start).isNull()).withColumn(start, F.coalesce(start, published))


def deadline_columns(df: DataFrame, deadline: str) -> DataFrame:
    return df.withColumn("deadline_missing", F.col(deadline).isNull()).withColumn("deadline_clean", F.col(deadline)).withColumn("deadline_source", F.when(F.col(deadline).isNotNull(), "csv"))


def exclude(df: DataFrame, exclusions: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(exclusions.select(key).distinct(), key, "left_anti")


def duplicate_titles(df: DataFrame, key: str, title: str, owner: str) -> DataFrame:
    """Rows whose normalised title repeats; is_true_duplicate where the owner repeats with it."""
    named = df.select(F.col(key), F.col(title), F.col(owner), T.normalized_title(F.col(title)).alias("title_norm"))
    same, own = Window.partitionBy("title_norm"), Window.partitionBy("title_norm", owner)
    return named.withColumn("_n", F.count("*").over(same)).withColumn("is_true_duplicate", F.count("*").over(own) > 1).where("_n > 1").drop("_n")


def issues(df: DataFrame) -> DataFrame:
    """Rows with an open question about amount, deadline, start or number, with how the amount was settled."""
    told = F.when(~F.col("budget_unknown"), "resolved").when(F.col("budget_source") == "undisclosed", "undisclosed").when(F.col("budget_source") == "candidate", "needs_review").otherwise("no_info")
    return df.where("budget_unknown or deadline_missing or start_estimated or number_missing").withColumn("resolution", told)


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of either side whose value differs; two nulls are equal."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def date_spans(df: DataFrame, key: str, text: str, published: str) -> DataFrame:
    """Spans "date ~ date" of texts whose start differs from the publication date, with the largest gap in days."""
    one = r"\d{4}[.\-]\d{1,2}[.\-]\d{1,2}"
    starts = F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"({one})\s*~\s*{one}"), F.lit(1)), lambda s: F.abs(F.datediff(T.lenient_date(s), F.col(published))))
    return df.select(key, F.size(starts).alias("n_spans"), F.array_max(starts).alias("max_gap")).where("n_spans > 0")


def widest_first(spans: DataFrame, key: str) -> DataFrame:
    """Spans in the order of their gaps, the greatest first; an unknown gap counts as none."""
    return spans.orderBy(F.desc(F.coalesce("max_gap", F.lit(0))), key)


# Labels and states of schedule texts.
BUDGET_LABEL, START_LABEL, DEADLINE_LABEL, ISSUER_LABEL = "  예산: ", "  참여 시작일: ", "  참여 마감일: ", "  발주 기관: "
NO_VALUE, OPEN_STATE, ONLY_CANDIDATE, ESTIMATED, CURRENCY = "정보 없음", "정보 없음(상태=%s)", '확정 안 됨(후보 문구만 있음) - "%s"', "(추정값 - 공개일자로 대체)", "원"
SNIPPET_SHOWN = 80


def issuer_text(owner: Column) -> Column:
    named = F.when(~owner.isin("", "nan"), owner)
    return F.concat(F.lit(ISSUER_LABEL), F.coalesce(named, F.lit(NO_VALUE)))


def _open_value(source: Column, snippet: Column) -> Column:
    """What stands for a value that is not settled: its candidate, else its state."""
    shown = F.format_string(ONLY_CANDIDATE, F.substring(snippet, 1, SNIPPET_SHOWN))
    return F.when((source == "candidate") & (snippet != ""), shown).otherwise(F.format_string(OPEN_STATE, F.coalesce(source, F.lit("None"))))


def schedule_text(df: DataFrame) -> Column:
    """Amount, start and deadline of cleaned notices in three lines, each with how far it is settled."""
    c = lambda name: df[name]
    known = c("budget").isNotNull() & ~F.isnan(c("budget")) & (c("budget") != 0)
    amount = F.when(known, F.concat(F.format_number(c("budget"), 0), F.lit(CURRENCY))).otherwise(_open_value(c("budget_source"), c("budget_snippet")))
    start = F.concat(c("start").cast("string"), F.when(c("start_estimated"), ESTIMATED).otherwise(""))
    end = F.coalesce(c("deadline_clean").cast("string"), _open_value(c("deadline_source"), c("deadline_snippet")))
    return F.concat_ws("\n", F.concat(F.lit(BUDGET_LABEL), amount), F.concat(F.lit(START_LABEL), F.coalesce(start, F.lit(NO_VALUE))), F.concat(F.lit(DEADLINE_LABEL), end))
