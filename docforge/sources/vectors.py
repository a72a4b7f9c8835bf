"""A store of vectors by backend and content: what is there already is not embedded again."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.sources.readers import exists


def content_digest(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> str:
    """One digest of all keys and texts, whatever their order: sums of two hashes and the count, made where the rows lie."""
    pair = (F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.coalesce(text, F.lit("\0")))
    one, two = F.xxhash64(*pair), F.xxhash64(F.lit(1), *pair)
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    return chunks.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), total(one), total(two)), 256).alias("d")).first()["d"]


def stored_vectors(chunks: DataFrame, root: str, backend: str, embed: Callable[[Column], Column], key: str = "chunk_id", text: str = "text", document: str = "doc_id") -> DataFrame:
    """The chunks with their vectors, from the folder of this backend and content; made and written first where that is not complete.

    Files are ranges of documents, so the vectors of one document are read from few of them. Old contents stay until
    their folder is removed; an unfinished folder is written anew.
    """
    spark = chunks.sparkSession
    folder = f"{root}/{re.sub('[^a-zA-Z0-9_-]', '_', backend)}/{content_digest(chunks, key, text)}"
    if not exists(spark, f"{folder}/_SUCCESS"):
        ranged = chunks.repartitionByRange(document, key).sortWithinPartitions(document, key)
        ranged.withColumn("vector", embed(F.col(text))).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def of_document(vectors: DataFrame, value: object, document: str = "doc_id") -> DataFrame:
    """The index of one document: a filter that reaches the scan."""
    return vectors.where(F.col(document) == F.lit(value))


def plain_metadata(values: Column) -> Column:
    """A map without its nulls."""
    return F.map_filter(values, lambda _, v: v.isNotNull())
