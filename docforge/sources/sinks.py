"""Writers: Parquet, CSV with a byte order mark, JSON lines, manifests, resumable runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose first header carries a byte order mark, for spreadsheets."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of binary files, made where they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, inputs: str, **settings) -> str:
    """Settings and input digests as one JSON string, keys sorted: equal runs have equal manifests."""
    files = [(r["path"].rsplit("/", 1)[-1], r["sha256"]) for r in file_digests(spark, inputs).orderBy("path").collect()]
    return json.dumps({"files": files, **settings}, sort_keys=True, ensure_ascii=False)


def check_resume(old: str | None, new: str) -> None:
    """A run may go on only under the manifest that it began with."""
    if old is not None and json.loads(old) != json.loads(new):
        raise ValueError("the manifest differs from the one of the run that is to be resumed")
