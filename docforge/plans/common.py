"""Inputs that several queries share, in both dialects."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; in local mode, where none is set, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp()  # local mode: one machine, as in tests
    return f"{shared}/{name}-{uuid4().hex[:12]}"


#: Notices: orders with the agency of their customer; some amounts and dates are missing.
NOTICES_SQL = """
  notices as (
    select o_orderkey as doc_id, case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then 1.0 else o_totalprice end as raw,
      cast(o_orderdate as date) as published, case when o_orderkey % 4 = 0 then null else cast(o_orderdate as date) end as start_day,
      case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) end as deadline, o_orderkey % 9 = 0 as number_missing, n_name as agency,
      '[' || o_orderstatus || '] ' || c_mktsegment || ' work (' || cast(o_orderkey as varchar) || ')' as title
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return rows.select(
        k.alias("doc_id"), F.when(k % 7 == 0, None).when(k % 11 == 0, 1.0).otherwise(F.col("o_totalprice")).alias("raw"), day.alias("published"),
        F.when(k % 4 != 0, day).alias("start_day"), F.when(k % 5 != 0, day).alias("deadline"), (k % 9 == 0).alias("number_missing"), F.col("n_name").alias("agency"),
        F.concat(F.lit("["), "o_orderstatus", F.lit("] "), "c_mktsegment", F.lit(" work ("), k.cast("string"), F.lit(")")).alias("title"),
    )
