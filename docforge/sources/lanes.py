"""Golden sets of different shape as one table: JSON lines or CSV, lanes with fields at different places.

Records are kept as VARIANT values, so each lane names where its fields lie and nothing has to have one schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class BadLineError(ValueError):
    """A line is not a JSON object; the message has its file and number."""


@dataclass(frozen=True)
class Lane:
    """Where a lane's records lie and where their fields are.

    ``fields``: column to its paths (as ``$.gold.decision``), of which the first that is there and not null is taken;
    ``types``: SQL types of columns that are not strings; ``constant``: columns with one value for the lane.
    """

    name: str
    path: str
    fields: dict[str, tuple[str, ...]]
    types: dict[str, str] = field(default_factory=dict)
    constant: dict[str, str] = field(default_factory=dict)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files, lines counted from 1, empty ones too.

    Lines are numbered within the blocks of a file that tasks read; the counts of blocks, one row each, are summed up
    and joined, so a file of any size is read in parallel.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return lines.join(before, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of JSON lines as VARIANT; a byte order mark and blank lines are skipped, a bad line raises a ``BadLineError``.

    All lines are parsed once; only where one is bad they are read again to number it.
    """
    clean = F.trim(F.regexp_replace("value", "^\\ufeff", ""))
    rows = spark.read.text(path).select(clean.alias("value")).where("value <> ''")
    parsed = rows.select(F.try_parse_json("value").alias("record"), "value")
    is_object = F.coalesce(F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")), F.lit(False))
    if parsed.where(~is_object).limit(1).count():
        bad = numbered(spark, path).withColumn("value", clean).where("value <> ''").withColumn("record", F.try_parse_json("value")).where(~is_object)
        at = bad.orderBy("file", "line").first()
        raise BadLineError(f"{at.file}, line {at.line}: not a JSON object: {at.value[:80]}")
    return parsed.select("record")


def tabular(spark: SparkSession, path: str) -> DataFrame:
    """(record) of a CSV with a header, quoted line ends allowed, as VARIANT objects of strings; blanks are null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    values = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns]
    return rows.select(F.to_variant_object(F.struct(*values)).alias("record"))


def taken(record: Column, paths: tuple[str, ...], kind: str = "string") -> Column:
    """The first value at one of the paths, as ``kind``; null where none is there or it does not fit."""
    return F.coalesce(*[F.try_variant_get(record, p, kind) for p in paths])


def as_list(record: Column, paths: tuple[str, ...], separator: str = r"\s*[|;]\s*") -> Column:
    """A list at one of the paths, or a string there cut at bars and semicolons; blanks go, null where nothing is."""
    cut = lambda p: F.split(F.try_variant_get(record, p, "string"), separator)
    found = F.coalesce(*[c for p in paths for c in (F.try_variant_get(record, p, "array<string>"), cut(p))])
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def read_lane(spark: SparkSession, lane: Lane) -> DataFrame:
    """A lane's records with the columns it names and ``lane``; CSV by the ending of its path, else JSON lines."""
    rows = tabular(spark, lane.path) if lane.path.rstrip("/").endswith(".csv") else records(spark, lane.path)
    own = []
    for name, paths in lane.fields.items():
        kind = lane.types.get(name, "string")
        own.append((as_list(F.col("record"), paths) if kind == "array<string>" else taken(F.col("record"), paths, kind)).alias(name))
    return rows.select(F.lit(lane.name).alias("lane"), *own, *[F.lit(v).alias(c) for c, v in lane.constant.items()])


def union(spark: SparkSession, lanes: list[Lane]) -> DataFrame:
    """All lanes in one table; columns that a lane does not have are null in it."""
    parts = [read_lane(spark, lane) for lane in lanes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def shapes(spark: SparkSession, lanes: list[Lane]) -> DataFrame:
    """(lane, shape): the schema that holds all records of a lane."""
    parts = [(tabular(spark, lane.path) if lane.path.rstrip("/").endswith(".csv") else records(spark, lane.path)).agg(F.lit(lane.name).alias("lane"), F.schema_of_variant_agg("record").alias("shape")) for lane in lanes]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.select("lane", "shape")


def resolved(rows: DataFrame, corpus: DataFrame, key: str = "id", labels: str = "labels") -> DataFrame:
    """``rows`` with ``expected`` (ids of the corpus that labels name, sorted) and ``n_unmatched`` in place of the labels.

    A label names a document by its id as a string, blanks made single, case aside; repeated labels count once.
    """
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")))
    each = rows.select(key, F.explode(F.array_distinct(F.transform(labels, clean))).alias("_label"))
    known = corpus.select(clean(F.col("doc_id")).alias("_label"), F.col("doc_id").alias("_found")).groupBy("_label").agg(F.min("_found").alias("_found"))
    met = each.join(known, "_label", "left").groupBy(key).agg(F.array_sort(F.collect_set("_found")).alias("expected"), F.count_if(F.col("_found").isNull()).alias("n_unmatched"))
    none = F.array().cast(met.schema["expected"].dataType)
    return rows.drop(labels).join(met, key, "left").withColumns({"expected": F.coalesce("expected", none), "n_unmatched": F.coalesce("n_unmatched", F.lit(0))})
