"""From a question to a plan: which deterministic query answers it, with what parameters.

Questions are read on the driver; the answer is a DataFrame of the notices, or None where no rule applies and
retrieval has to answer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.functions.text import UNITS
from docforge.operators import analytics, filters

# What questions of each kind say.
CLOSEST = ("차이가 가장 작은", "가장 가까운", "차이가 가장 적은")
WITHIN = r"(\d+)\s*(개월|일)\s*이내"
SHORT = "짧은 사업"
EXTREME = r"(?:가장|제일)\s*(큰|작은|높은|낮은)"
LARGE = ("큰", "높은")
BUDGET_WORDS = ("예산", "금액", "사업비")
EXTREME_PERIOD = r"(?:가장|제일)\s*(긴|짧은|오래|빨리)"
LONG = ("긴", "오래")
COUNT_WORDS = ("몇 개", "개수", "다 나열", "몇 건", "전부")
NAME_FILTER = r"['\"‘“]([^'\"’”]+)['\"’”][가이]?\s*(?:포함|들어)"
RECENT = r"최근\s*(\d+)\s*(개월|일)"
NEXT_ITEMS = r"(\d+)\s*(?:개|건)"


@dataclass(frozen=True)
class Route:
    kind: str
    days: int | None = None
    largest: bool = True
    name: str | None = None
    bounds: tuple[tuple[str, float], ...] = ()
    limit: int | None = None


def days_of(number: str, unit: str) -> int:
    return int(number) * (30 if unit == "개월" else 1)


def route(question: str) -> Route:
    """The first rule that fits: closest, extremes, recent window, short periods, counts, constraints, retrieval."""
    name = re.search(NAME_FILTER, question)
    name = name[1] if name else None
    bounds = tuple(filters.amount_bounds(question, UNITS))
    if any(p in question for p in CLOSEST):
        return Route("closest", name=name)
    extreme = re.search(EXTREME, question)
    if extreme and any(w in question for w in BUDGET_WORDS):
        return Route("extreme_budget", largest=extreme[1] in LARGE, name=name, bounds=bounds)
    period = re.search(EXTREME_PERIOD, question)
    if period and ("기간" in question or "오래" in question):
        return Route("extreme_period", largest=period[1] in LONG, name=name)
    recent = re.search(RECENT, question)
    if recent and bounds:
        return Route("recent", days=days_of(*recent.groups()), bounds=bounds)
    within = re.search(WITHIN, question)
    if within or SHORT in question:
        return Route("short_period", days=days_of(*within.groups()) if within else analytics.SHORT_DAYS, bounds=bounds)
    if any(w in question for w in COUNT_WORDS) or "총" in question and ("개" in question or "건" in question):
        return Route("count", name=name, bounds=bounds)
    if filters.parse_constraints(question) != filters.Constraints():
        number = re.search(NEXT_ITEMS, question)
        return Route("listing", bounds=bounds, limit=int(number[1]) + 6 if number else 3)
    return Route("retrieval")


def answer(question: str, notices: DataFrame, today: str, reference=None) -> DataFrame | None:
    """Rows of notices (doc_id, title, budget, days, published) that answer the question; None for retrieval."""
    r = route(question)
    df = notices if r.name is None else notices.where(F.contains("title", F.lit(r.name)))
    if r.bounds and r.kind not in ("recent",):
        df = df.where(filters.within_bounds(F.col("budget"), list(r.bounds)))
    if r.kind == "closest":
        if reference is None:
            return None
        target = notices.where(F.col("doc_id") == F.lit(reference)).select("budget").first()
        return analytics.closest(df, "budget", target["budget"], "doc_id", reference) if target and target["budget"] is not None else df.limit(0)
    if r.kind == "extreme_budget":
        return analytics.extremes(df, "budget", r.largest)
    if r.kind == "extreme_period":
        return analytics.extremes(df, "days", r.largest)
    if r.kind == "recent":
        most = min((v for op, v in r.bounds if op in ("<", "<=")), default=float("inf"))
        return analytics.recent_window(df, "published", "budget", "doc_id", r.days, most, today)
    if r.kind == "short_period":
        return analytics.short_periods(df, "days", r.days).orderBy("days", "budget", "doc_id")
    if r.kind == "count":
        return df.agg(F.count("*").alias("n"))
    if r.kind == "listing":
        c = filters.parse_constraints(question)
        return df.where(c.predicate(F.col("budget"), F.col("agency"))).orderBy("doc_id").limit(r.limit)
    return None
