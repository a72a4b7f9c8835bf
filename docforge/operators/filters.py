"""Constraints from questions, made column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What questions say, and what names of local governments end with.
MIN_BUDGET = r"(?P<amount>\d+(?:\.\d+)?)\s*억\s*(?:원)?\s*(?P<op>이상|초과|넘는|넘은)"
MIN_BUDGET_UNIT, EXCLUSIVE = 100_000_000, ("초과", "넘는", "넘은")
LOCAL = r"지자체|지방자치단체"
LOCAL_SUFFIX = r"(?:특별시|광역시|특별자치시|특별자치도|도|시|군|구)(?:청)?$"


@dataclass(frozen=True)
class Constraints:
    minimum: float | None = None
    exclusive: bool = False
    local: bool = False
    organization: str | None = None

    def predicate(self, budget: Column, owner: Column, unknown_passes: bool = False, local_suffix: str = LOCAL_SUFFIX) -> Column | None:
        """None without a constraint. Unknown amounts fail unless ``unknown_passes``."""
        if self == Constraints():
            return None
        out = F.lit(True)
        if self.minimum is not None:
            enough = budget > self.minimum if self.exclusive else budget >= self.minimum
            out = out & F.coalesce(enough, F.lit(unknown_passes))
        name = F.trim(F.coalesce(owner, F.lit("")))
        if self.local:
            out = out & name.rlike(local_suffix)
        if self.organization:
            out = out & F.lower(name).contains(self.organization.lower())
        return out


def parse_constraints(question: str, organization: str | None = None, pattern: str = MIN_BUDGET, unit: int = MIN_BUDGET_UNIT, exclusive: tuple[str, ...] = EXCLUSIVE, local: str = LOCAL) -> Constraints:
    found = re.search(pattern, question)
    return Constraints(float(found["amount"]) * unit if found else None, bool(found and found["op"] in exclusive), bool(re.search(local, question)), (organization or "").strip() or None)


# Comparators of amount bounds in questions.
COMPARATORS = {"이상": ">=", "초과": ">", "넘는": ">", "이하": "<=", "미만": "<"}


def amount_bounds(question: str, units: dict[str, int], comparators: dict[str, str] | None = None) -> list[tuple[str, float]]:
    """All "number unit comparator" of a question."""
    comparators = comparators or COMPARATORS
    names, words = ("|".join(sorted(map(re.escape, x), key=len, reverse=True)) for x in (units, comparators))
    return [(comparators[c], float(n.replace(",", "")) * units[u]) for n, u, c in re.findall(rf"([\d,]+(?:\.\d+)?)\s*({names})\s*(?:원)?\s*({words})", question)]


def within_bounds(budget: Column, bounds: list[tuple[str, float]]) -> Column:
    out = F.lit(True)
    for op, value in bounds:
        out = out & {">=": budget >= value, ">": budget > value, "<=": budget <= value, "<": budget < value}[op]
    return F.coalesce(out, F.lit(False))


def search(df: DataFrame, columns: list[str], term: str, order: str, limit: int | None = None) -> DataFrame:
    """Rows in which any of the columns contains the term, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(term.lower())
    out = df.where(hit).orderBy(order)
    return out.limit(limit) if limit is not None else out


def in_scope(df: DataFrame, selected: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.join(selected.select(key).distinct(), key, "left_semi")


def disabled_reason(enabled: Column, csv_only: Column, follow_up: Column) -> Column:
    return F.when(enabled == F.lit(False), "disabled").when(csv_only, "csv_only").when(follow_up, "follow_up")


def gradable(df: DataFrame, expected: str, facts: str) -> DataFrame:
    """Rows with expected documents and facts."""
    return df.where((F.size(F.coalesce(F.col(expected), F.array())) > 0) & (F.size(F.coalesce(F.col(facts), F.array())) > 0))


# What questions say of a kind of notice, and what owners or file names of that kind hold.
LEAST_AMOUNT, LEAST_WORDS = r"(\d+)억", ("이상", "넘는")
LOCAL_WORDS = ("지자체", "지방자치단체")
LOCAL_NAME = r"(광역시|특별시|특별자치도|특별자치시|[가-힣]+도|[가-힣]+시|[가-힣]+군|[가-힣]+구)$"
CORPORATION, CORPORATION_WORDS = "공사", ("OO공사", "발주기관이")
SCHOOL_WORDS = ("학교", "대학교", "대학", "과학기술원")
SCHOOL_NAME, ASSOCIATION = r"대학교|대학|과학기술원", r"협의회|협회"
FILE_WORDS = ("긴급", "보안", "재난")
AI_WORD = "AI"
WHERE_STATED = ("명시되어 있나요", "명시되어 있는지", "문서에 나와 있나요", "기재되어 있나요", "명시되어 있습니까", "적혀 있나요", "표기되어 있나요")

_OWNERS = {
    "local": lambda name: F.trim(name).rlike(LOCAL_NAME),
    "corporation": lambda name: name.contains(CORPORATION),
    "school": lambda name: name.rlike(SCHOOL_NAME) & ~name.rlike(ASSOCIATION),
}


@dataclass(frozen=True)
class Topics:
    """A least amount, kinds of owner and words of the file name that a question asks for. ``ai`` is told, but filters nothing."""

    minimum: int | None = None
    owners: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    ai: bool = False

    def predicate(self, budget: Column, owner: Column, file_name: Column) -> Column | None:
        """None where nothing filters. Unknown amounts, owners and names fail."""
        asked = [] if self.minimum is None else [F.coalesce(budget >= self.minimum, F.lit(False))]
        asked += [_OWNERS[kind](F.coalesce(owner, F.lit(""))) for kind in self.owners]
        asked += [F.coalesce(file_name, F.lit("")).contains(word) for word in self.words]
        return reduce(and_, asked) if asked else None


def topics_of(question: str, unit: int = MIN_BUDGET_UNIT) -> Topics:
    def said(words: tuple[str, ...]) -> bool:
        return any(w in question for w in words)

    least = re.search(LEAST_AMOUNT, question) if said(LEAST_WORDS) else None
    kinds = {"local": said(LOCAL_WORDS), "corporation": CORPORATION in question and said(CORPORATION_WORDS), "school": said(SCHOOL_WORDS)}
    return Topics(int(least[1]) * unit if least else None, tuple(k for k, yes in kinds.items() if yes), tuple(w for w in FILE_WORDS if w in question), AI_WORD in question)


def asks_where_stated(question: Column) -> Column:
    """Questions on whether the text itself says it: the answer has to tell text and metadata apart."""
    return F.coalesce(question.rlike("|".join(WHERE_STATED)), F.lit(False))
