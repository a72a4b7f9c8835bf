"""Readers: metadata tables with schema checks, side tables, JSON lines, envelopes, markup tables, binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def read_metadata(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """CSV with quoted line ends; all columns strings unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return require(df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns}), required, path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_side_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame | None:
    """None where the file is absent; an error where columns are."""
    return read_metadata(spark, path, required) if exists(spark, path) else None


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines and a byte order mark are skipped, a malformed line stops the read."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\ufeff", "").alias("value")).where(F.trim("value") != "")
    bad = F.from_json("value", schema, {"mode": "PERMISSIVE"}).isNull() | ~F.trim("value").startswith("{")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 80)))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, arrays of objects or {runtime, result} envelopes, one document a file."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\ufeff", "").alias("v"))
    many = F.coalesce(F.from_json("v", f"array<struct<{schema}>>"), F.array(F.from_json("v", f"struct<{schema}>")))
    inner = F.get_json_object("v", "$.result")
    rows = F.when(inner.isNotNull(), F.array(F.from_json(inner, f"struct<{schema}>"))).otherwise(many)
    return whole.select(F.explode(rows).alias("r")).select("r.*")


class _Tables(HTMLParser):
    """Top-level tables of a page: rows of (text, colspan, bg)."""

    def __init__(self):
        super().__init__()
        self.depth, self.tables, self.cell = 0, [], None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            span = attrs.get("colspan") or "1"
            style = attrs.get("style") or ""
            color = style.split("background-color:")[-1].split(";")[0].strip() if "background-color:" in style else None
            self.cell = ["", int(span) if span.isdigit() and int(span) > 0 else 1, color]
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def parse_tables(markup: str | None) -> list[list[list[dict]]]:
    parser = _Tables()
    parser.feed(markup or "")
    return [[[{"text": " ".join(c[0].split()), "colspan": c[1], "bg": c[2]} for c in row] for row in t] for t in parser.tables]


def markup_tables(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, nth, cells): top-level tables of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(str(k), i, t) for k, m in zip(pdf["k"], pdf["m"]) for i, t in enumerate(parse_tables(m))]
            yield pd.DataFrame(rows, columns=[key, "nth", "cells"])

    return pages.selectExpr(f"cast(`{key}` as string) as k", f"`{markup}` as m").mapInPandas(run, f"{key} string, nth int, cells array<array<struct<text:string,colspan:int,bg:string>>>")


#: Parsers of binary files by format: bytes to (text, number of tables, pages, scanned pages, error).
Parser = Callable[[bytes], tuple[str, int, int, int, str | None]]
PARSERS: dict[str, Parser] = {}


def register_parser(kind: str, parser: Parser) -> None:
    """Parsers need libraries that are not part of this repository; each is registered by its user."""
    PARSERS[kind] = parser


def parse_files(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(path, text, n_tables, n_pages, n_scanned, error) of (path, content): by file extension, whole files, errors as rows."""
    chosen = dict(parsers or PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                kind = path.rsplit(".", 1)[-1].lower().strip()
                try:
                    rows.append((path, *(chosen[kind](content) if kind in chosen else ("", 0, 0, 0, f"unsupported format {kind}"))))
                except Exception as e:  # noqa: BLE001  one broken file is a row with its error
                    rows.append((path, "", 0, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "n_tables", "n_pages", "n_scanned", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, n_tables int, n_pages int, n_scanned int, error string")
