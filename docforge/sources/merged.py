"""Merged documents: metadata with parsed texts, written once and settled anew whenever they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import metadata as M
from docforge.sources.readers import exists


def settled(df: DataFrame, text: str = "text") -> DataFrame:
    """Amounts and deadlines that are open, looked for in the final text by the rules of today."""
    df = M.resolve(df, "budget_unknown", "budget_source", "budget_snippet", M.budget_candidate(F.col(text)))
    return M.resolve(df, "deadline_missing", "deadline_source", "deadline_snippet", M.deadline_candidate(F.col(text)))


def merge_all(metadata: DataFrame, parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Metadata with the parse of each document, settled; documents on one side only go, clashing columns of the parse get ``_merged``."""
    names = {c: f"{c}_merged" for c in parsed.columns if c != key and c in metadata.columns}
    return settled(metadata.join(parsed.withColumnsRenamed(names), key))


def reload(spark: SparkSession, path: str, exclusions: DataFrame | None = None) -> DataFrame | None:
    """What was written, as if merged today: without placeholder lines, settled again, without excluded documents. None where nothing was written."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    clean = T.without_lines(F.coalesce("text", F.lit("")), f"{T.IMAGE_MARK}|{T.TABLE_MARK}")
    rows = settled(rows.withColumn("text", clean))
    return rows if exclusions is None else M.exclude(rows, exclusions)
