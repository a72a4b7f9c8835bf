"""A training corpus from documents: quality, line dedup, near duplicates, decontamination, packing.

Each stage is written as Parquet to the shared folder and read again by the next, so a lost executor costs tasks of
one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docforge.llm import contamination, jaccard, lines, packing, quality
from docforge.llm.queries import tokenizer_file
from docforge.llm.workspace import Workspace


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels that are not held out."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that stand earlier; those left without text go."""
    return lines.without_repeats(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return jaccard.first_of_class(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return contamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences."""
    return packing.report(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("line_dedup", distinct_lines), ("near_duplicates", one_of_each_class), ("decontamination", free_of_benchmarks), ("packing", packed)]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
