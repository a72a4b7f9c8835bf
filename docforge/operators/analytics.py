"""Questions answered from metadata alone: extremes, closest values, windows, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The period pattern, days of a month, and how recent the newest date must be to count from today.
PERIOD = r"(?:사업|용역|과업)\s*기간[^.]{0,30}(?:계약체결일|계약일|착수일)[^.]{0,10}(?:로부터|~)\s*(\d+)\s*(일|개월)"
MONTH_WORD, MONTH_DAYS, SHORT_DAYS, RECENT_DAYS = "개월", 30, 90, 180


def extremes(df: DataFrame, value: str, largest: bool, by: list[str] | None = None) -> DataFrame:
    """All rows with the largest or smallest value (of each group); unknown values take no part."""
    df = df.where(F.col(value).isNotNull())
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc(value) if largest else F.asc(value))
        return df.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")
    top = df.agg((F.max if largest else F.min)(value).alias("_top"))
    return df.join(F.broadcast(top), F.col(value) == F.col("_top")).drop("_top")


def closest(df: DataFrame, value: str, target: float, key: str, exclude=None, n: int = 1) -> DataFrame:
    """Rows nearest to a value, the reference row left out; ties go to the smaller key."""
    out = df.where(F.col(value).isNotNull())
    if exclude is not None:
        out = out.where(F.col(key) != F.lit(exclude))
    return out.withColumn("gap", F.abs(F.col(value) - F.lit(target))).orderBy("gap", key).limit(n)


def period_days(chunks: DataFrame, key: str, order: str, text: str, pattern: str = PERIOD, month: str = MONTH_WORD) -> DataFrame:
    """(key, days): the first chunk in order that states a period other than zero."""
    days = F.regexp_extract(text, pattern, 1).try_cast("int") * F.when(F.regexp_extract(text, pattern, 2) == month, MONTH_DAYS).otherwise(1)
    found = chunks.select(key, F.col(order).alias("_o"), days.alias("_d")).where("_d > 0")
    return found.groupBy(key).agg(F.min_by("_d", "_o").alias("days"))


def short_periods(df: DataFrame, days: str = "days", limit: int = SHORT_DAYS) -> DataFrame:
    return df.where(F.col(days) <= limit)


def recent_window(df: DataFrame, published: str, budget: str, key: str, days: int, bound: float, today: str) -> DataFrame:
    """Rows of the last ``days`` before the anchor with an amount up to ``bound``, newest first.

    The anchor is ``today`` where the newest date is at most 180 days before it, else the newest date. Rows without an
    amount are left out; ``n_unknown`` counts those in the window.
    """
    newest = df.agg(F.max(published).alias("_newest"))
    near = F.datediff(F.lit(today).cast("date"), F.col("_newest")) <= RECENT_DAYS
    anchor = newest.select(F.when(near, F.lit(today).cast("date")).otherwise(F.col("_newest")).alias("_anchor"))
    inside = df.crossJoin(F.broadcast(anchor)).where(F.col(published).between(F.date_sub("_anchor", days), F.col("_anchor"))).drop("_anchor")
    unknown = inside.agg(F.count_if(F.col(budget).isNull()).alias("n_unknown"))
    return inside.where(F.col(budget) <= bound).crossJoin(F.broadcast(unknown)).orderBy(F.desc(published), budget, key)


def period_and_budget(df: DataFrame, days: str, budget: str, key: str, most_days: int, most_budget: float) -> DataFrame:
    return df.where((F.col(days) <= most_days) & (F.col(budget) <= most_budget)).orderBy(days, budget, key)


def first_chunks(chunks: DataFrame, docs: DataFrame, key: str, order: str, n: int = 3) -> DataFrame:
    """The first chunks of all documents that match."""
    own = chunks.join(docs.select(key).distinct(), key, "left_semi")
    return own.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= n).drop("_n")
