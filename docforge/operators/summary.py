"""The summary of a scored run, guarded by what is observed while the details are written.

Golden cases and predictions meet by their ids in one join. The counts that a run must not have (blank ids, ids that
stand twice) are observed in that pass, so they cost no pass of their own, and raise an error before anything is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Statuses of responses, in the order of reports, and those that end a case.
STATUSES = ("answered", "partial_answer", "abstained", "empty_response", "execution_error")
BROKEN = ("execution_error", "empty_response")
MEASURES = ("conditional_score", "end_to_end_score", "lexical_fact_score", "retrieval_recall", "context_fact_coverage", "abstention_match", "citation_format_pass", "citation_recall", "citation_precision", "list_precision", "list_recall", "list_f1", "exact_set_match", "count_accuracy", "document_mention_coverage", "compatible_score")


class GuardError(ValueError):
    """Ids of a run are blank or stand twice."""


def _once(rows: DataFrame, key: str, side: str) -> DataFrame:
    """One row for each id with the number of its rows; blank and null ids are one id."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias(key)).agg(F.count("*").alias(f"_n_{side}"), F.first(F.struct(*rest)).alias(f"_{side}"))


def joined(golden: DataFrame, predictions: DataFrame, folder: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(details, unknown): golden cases with what was predicted for them, and the ids of predictions without a case.

    ``details`` has the columns of ``golden``, those of ``predictions`` that golden does not have (null where a case was
    not predicted), and ``predicted``. It is written below ``folder``; blank or repeated ids on either side raise a
    ``GuardError`` then, with their numbers. Ids are compared as trimmed strings.
    """
    both = _once(golden, key, "gold").join(_once(predictions, key, "said"), key, "full")
    seen = Observation("guards")
    blank = F.col(key) == ""
    watched = both.observe(
        seen, F.coalesce(F.sum(F.when(blank, F.col("_n_gold"))), F.lit(0)).alias("blank_golden"), F.coalesce(F.sum(F.when(blank, F.col("_n_said"))), F.lit(0)).alias("blank_predictions"),
        F.count_if(F.col("_n_gold") > 1).alias("repeated_golden"), F.count_if(F.col("_n_said") > 1).alias("repeated_predictions"), F.count_if(F.col("_n_gold").isNull()).alias("unknown"), F.count("*").alias("ids"),
    )
    watched.write.mode("overwrite").parquet(f"{folder}/joined")
    found = seen.get
    wrong = {k: v for k, v in found.items() if k not in ("unknown", "ids") and v}
    if wrong:
        raise GuardError(f"ids are blank or stand twice: {wrong}")
    rows = golden.sparkSession.read.parquet(f"{folder}/joined")
    known = rows.where("_n_gold is not null")
    extra = [c for c in predictions.columns if c not in golden.columns]
    details = known.select(key, *[F.col(f"_gold.{c}").alias(c) for c in golden.columns if c != key], *[F.col(f"_said.{c}").alias(c) for c in extra], F.col("_n_said").isNotNull().alias("predicted"))
    return details, rows.where("_n_gold is null").select(key)


def reasons(details: DataFrame) -> Column:
    """The reasons for which a case may have failed: a broken response has its status alone, else up to eight in a fixed order, else "none".

    Measures that are null or absent give no reason.
    """
    own = lambda c, kind: F.col(c) if c in details.columns else F.lit(None).cast(kind)
    status = own("response_status", "string")
    checks = {
        "retrieval_failure": own("retrieval_recall", "double") == 0, "context_fact_missing": own("context_fact_coverage", "double") == 0, "abstention_mismatch": ~own("abstention_match", "boolean"),
        "set_mismatch": own("list_f1", "double") < 1, "fact_incomplete_or_mismatch": own("lexical_fact_score", "double") < 100, "citation_missing": own("citation_status", "string") == "missing",
        "citation_misplaced": own("citation_status", "string") == "misplaced", "unsupported_citation": own("unsupported_citation_count", "long") > 0,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return F.when(status.isin(*BROKEN), F.array(status)).when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))


def mention_coverage(answer: Column, expected: Column) -> Column:
    """Share of the expected documents whose names stand in an answer; null without any."""
    return F.when(F.size(expected) > 0, F.size(F.filter(expected, lambda e: F.contains(F.coalesce(answer, F.lit("")), F.trim(e)))) / F.size(expected))


def summary(details: DataFrame, lane: str = "lane") -> DataFrame:
    """One row for each lane and one for all ("all"), in one pass: cases, counts of statuses, rates and means.

    Means leave out nulls; they are null where a lane has no value. Measures that ``details`` lacks are left out.
    """
    status = F.col("response_status")
    n = F.count("*")
    counts = [F.count_if(status == s).alias(s) for s in STATUSES]
    means = [F.avg(F.col(m).cast("double")).alias(m) for m in MEASURES if m in details.columns]
    full = [F.avg((F.col(m) == 1).cast("double")).alias(f"{m}_full") for m in ("retrieval_recall", "context_fact_coverage") if m in details.columns]
    grouped = details.rollup(lane).agg(F.grouping(lane).alias("_g"), n.alias("cases"), *counts, (F.count_if(~status.isin(*BROKEN)) / n).alias("generation_success"), *means, *full)
    return grouped.withColumn(lane, F.when(F.col("_g") == 1, "all").otherwise(F.col(lane))).drop("_g")


def histogram(details: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column or of the members of an array column; "none" and null do not count."""
    value = F.explode(column) if details.schema[column].dataType.typeName() == "array" else F.col(column)
    return details.select(value.alias("value")).where("value <> 'none'").groupBy("value").agg(F.count("*").alias("n"))


def compatible_score(expects_abstention: Column, abstention_match: Column, fact_coverage: Column) -> Column:
    """100 or 0 where a case expects an abstention, else the share of facts in a hundred, null without facts."""
    return F.when(expects_abstention, F.when(abstention_match, 100.0).otherwise(0.0)).otherwise(fact_coverage * 100)
