"""Column functions on text: cleaning, classes, titles, tags, numbers, dates, snippets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Line patterns of noise, and length limits of document classes.
DOT_LEADER = r"^.{1,60}?[.․‥…·]{3,}\s*\d{1,4}\s*$"
PAGE_NUMBER = r"^\s*-\s*\d{1,4}\s*-\s*$"
DECORATION = r"^[\-=~_*◇◆※─━═│┃╌╍]{3,}$"
IMAGE_MARK = r"^<그림>$"
TABLE_MARK = r"^<표>$"
SCANNED_BELOW, SHORT_BELOW = 300, 1000
TABLES_LEAST, TABLE_TEXT_BELOW = 3, 2000
PAGE_TEXT_LEAST = 20
TAG = r"\[([^\[\]]+)\]"
PAREN, BRACKET = r"\([^)]*\)", r"\[[^\]]*\]"

EMPTY = "cast(array() as array<string>)"


def once(body, **values: Column) -> Column:
    """``body`` of a struct that has the values by name: each is worked out once for a row, however often the body uses it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(name) for name, c in values.items()])), body), F.lit(0))


def without_lines(text: Column, pattern: str) -> Column:
    """Drop whole lines that match."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(pattern)), "\n")


def remove_noise_lines(text: Column) -> Column:
    """Drop dot-leader, page-number and rule lines, then leave at most one empty line in a row; null becomes empty."""
    kept = without_lines(F.coalesce(text, F.lit("")), f"{DOT_LEADER}|{PAGE_NUMBER}|{DECORATION}")
    return F.regexp_replace(kept, "\n{3,}", "\n\n")


def class_by_length(n: Column) -> Column:
    """(doc_type, confidence) of a text of which only the length is known."""
    kind = F.when(n < SCANNED_BELOW, "scanned").when(n < SHORT_BELOW, "short_text").otherwise("plain_text")
    return F.struct(kind.alias("doc_type"), F.lit("low").alias("confidence"))


def class_with_parse(n: Column, n_tables: Column, n_pages: Column, n_scanned: Column) -> Column:
    """Class of a parsed document: mostly scanned pages, then tables with little text, then little text. Never short_text."""
    mostly = (n_pages > 0) & (n_scanned * 2 > n_pages)
    return (
        F.when(F.coalesce(mostly, F.lit(False)), "scanned")
        .when((n_tables >= TABLES_LEAST) & (n < TABLE_TEXT_BELOW), "table_heavy")
        .when(n < SCANNED_BELOW, "scanned")
        .otherwise("plain_text")
    )


def merged_text(parsed: Column, fallback: Column) -> Column:
    """(text, source): the parsed text where it is not blank, else the fallback."""
    ok = F.length(F.trim(F.coalesce(parsed, F.lit("")))) > 0
    return F.struct(F.when(ok, parsed).otherwise(F.coalesce(fallback, F.lit(""))).alias("text"), F.when(ok, "raw_parsed").otherwise("csv_fallback").alias("source"))


def name_tags(title: Column) -> Column:
    """Bracketed tags of a title, comma-joined."""
    return F.coalesce(F.array_join(F.regexp_extract_all(title, F.lit(TAG), F.lit(1)), ","), F.lit(""))


def normalized_title(title: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), PAREN, ""), BRACKET, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def squeezed(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def lenient_date(text: Column) -> Column:
    """The first of some date forms that fits, else null."""
    clean = F.regexp_replace(F.trim(text), r"\s*[./]\s*", "-")
    korean = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s*[년월]\s*", "-"), r"\s*일.*$", "")
    forms = ("yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy-M-d")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for c in (clean, korean) for f in forms], F.to_date(F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd"))))


def lenient_number(text: Column) -> Column:
    """A number with thousands separators, else null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


# Multipliers of amount units.
UNITS = {"억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000}


def amount(text: Column, units: dict[str, int] | None = None) -> Column:
    """The first "number unit" of a text as a number; the unit may be missing."""
    units = units or UNITS
    names = "|".join(sorted(units, key=len, reverse=True))
    pattern = rf"([\d,]+(?:\.\d+)?)\s*({names})?"
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.lit(1)
    for name, value in units.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return lenient_number(F.regexp_extract(text, pattern, 1)) * factor


def occurrences(text: Column, keyword: Column) -> Column:
    """Starts (from 1) of a keyword in a text, not overlapping."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), keyword, F.lit("\\E")), -1)
    sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.char_length(p))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("at"), F.lit(1).alias("next"))
    return F.aggregate(
        sizes, start,
        lambda s, n: F.struct(F.concat(s["at"], F.array(s["next"] + n)).alias("at"), (s["next"] + n + F.char_length(keyword)).alias("next")),
        lambda s: s["at"],
    )


def snippets(text: Column, keyword: Column, before: int = 20, after: int = 200) -> Column:
    """The surroundings of each occurrence of a keyword."""
    return F.transform(occurrences(text, keyword), lambda at: F.substring(text, F.greatest(at - before, F.lit(1)), at + F.char_length(keyword) + after - F.greatest(at - before, F.lit(1))))


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded, only digits, Latin and Hangul letters and per cent signs."""
    keep = re.compile(r"[^0-9a-z가-힣%]+")
    return texts.map(lambda t: keep.sub("", unicodedata.normalize("NFKC", t).casefold()) if isinstance(t, str) else "")


@F.pandas_udf(StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    """Compatibility-normalised and case-folded, nothing left out; null is empty."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold() if isinstance(t, str) else "")


def json_fields(text: Column, schema: str) -> Column:
    """A JSON object, with or without code fences around it; null where it does not parse."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(bare, schema)


def without_ending(text: Column, endings: tuple[str, ...]) -> Column:
    """The text less one of the endings, the longest that fits; never all of it."""
    return F.regexp_replace(text, f"(?<=.)(?:{'|'.join(sorted(map(re.escape, endings), key=len, reverse=True))})$", "")


def first_of(values: Column, keys: list[str]) -> Column:
    """A map's value of the first key that has one."""
    return F.coalesce(*[F.try_element_at(values, F.lit(k)) for k in keys])


def data_url(content: Column, kind: str) -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def slug(name: Column) -> Column:
    """A name fit for a folder: its last part without the extension, other characters as dashes, 48 at most, and the start of its digest."""
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    clean = F.substring(F.regexp_replace(F.regexp_replace(stem, "[^0-9a-zA-Z가-힣_-]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit("document")), F.lit("-"), F.substring(F.sha2(name, 256), 1, 10))
