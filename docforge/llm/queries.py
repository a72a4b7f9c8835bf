"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docforge.llm import change_points, contamination, fingerprints, jaccard, lexical_index, lines, oracles, packing, quality, records, relative_lz, secrets, suffix_dedup, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.report(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.report(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.report(_table(spark, sf_dir, "pages"))


def op13_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_points.report(_table(spark, sf_dir, "sale_lines"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ngram_jaccard, op3_secret_scan, op4_substring_dedup, op5_best_fit_packing, op6_quality_classifier, op7_suffix_dedup, op8_token_records, op9_fingerprints, op10_decontamination, op11_ranked_search, op12_url_filters, op13_change_points)}
#: The other operators are beyond SQL, or too slow in it; tests hold them against brute force.
ORACLES: dict[str, str] = {"op2_ngram_jaccard": oracles.OP2, "op4_substring_dedup": oracles.OP4, "op7_suffix_dedup": oracles.OP7, "op10_decontamination": oracles.OP10, "op11_ranked_search": oracles.OP11, "op12_url_filters": oracles.OP12, "op13_change_points": oracles.OP13}
