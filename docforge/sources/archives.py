"""Members of archives, looked up by normalised names."""

from __future__ import annotations

import io
import unicodedata
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docforge.operators.names import beginning


def normal_name(name: str) -> str:
    return " ".join(unicodedata.normalize("NFC", name).rsplit("/", 1)[-1].split()).casefold()


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, name) of the files in zip archives below a path; each archive is listed in one task."""

    def listed(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, m, normal_name(m)) for p, c in zip(pdf["path"], pdf["content"]) for m in zipfile.ZipFile(io.BytesIO(c)).namelist() if not m.endswith("/")]
            yield pd.DataFrame(rows, columns=["archive", "member", "name"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(listed, "archive string, member string, name string")


@F.pandas_udf(StringType())
def normal_names(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else normal_name(n))


def find_members(wanted: DataFrame, index: DataFrame, column: str = "source") -> DataFrame:
    """(source, member): the member of that name, else the only one that begins with it or that it begins with.

    Null and blank names find nothing. Names meet by their beginnings, in either direction.
    """
    w = wanted.where(F.col(column).isNotNull()).select(column, normal_names(column).alias("_w")).distinct().where("_w <> ''")
    exact = w.join(index, F.col("_w") == F.col("name")).groupBy(column).agg(F.min("member").alias("member"))
    rest = w.join(exact, column, "left_anti")
    near = beginning(index, rest, "member", "name", column, "_w").select(column, "member").union(beginning(rest, index, column, "_w", "member", "name").select(column, "member"))
    alone = near.groupBy(column).agg(F.min("member").alias("member"), F.countDistinct("member").alias("n")).where("n = 1").drop("n")
    return exact.unionByName(alone)


def patch_rows(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table with rows of the same key taken from ``fresh``: what was parsed again replaces what was."""
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*table.columns))
