"""Scoring of rankings and answers: metrics, facts, citations, abstention, summaries, runs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# Marks of citations, contexts and dates, and phrases of answers that decline.
CITATION_AT_END = r"(?s)\[\s*근거\s*:\s*(.+)\]\s*$"
CITATION_LINE = r"(?i)\[\s*근거\s*:\s*(.+)\](?=\s*(?:\n|$))"
CONTEXT_LINE = r"(?m)^\[문서:\s*(.*)\]\s*$"
DATE = r"(\d{4})\s*[.\-/년]?\s*(\d{1,2})\s*[.\-/월]?\s*(\d{1,2})\s*일?"
ABSTAINS = (
    r"알\s*수\s*없|확인\s*(?:할\s*수)?\s*없|판단\s*(?:을\s*)?(?:해\s*드릴\s*)?(?:할\s*수|수)?\s*없|판정\s*(?:을\s*)?(?:해\s*드릴\s*)?(?:할\s*수|수)?\s*없|"
    r"확정\s*(?:할\s*수)?\s*없|계산\s*(?:할\s*수)?\s*없|예측\s*(?:할\s*수)?\s*없|제공\s*(?:할\s*수)?\s*없|수행\s*(?:할\s*수)?\s*없|답변\s*(?:할\s*수)?\s*없|"
    r"명시\s*되어\s*있지\s*않|제공\s*되지\s*않|정보(?:가|는)?\s*없|자료(?:가|는)?\s*없|불가능"
)
BOILERPLATE = r"제공된\s*문서(?:의)?\s*범위에서는?|검색된\s*문서(?:의)?\s*범위에서는?|원문\s*전체\s*확인이\s*필요할\s*수\s*있습니다|관련\s*자료를\s*추가로\s*확인해\s*주세요"
RESIDUE_FROM = 15


# --- rankings -------------------------------------------------------------------------------------------------


def retrieval_metrics(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5), query_key: str = "query_id", key: str = "doc_id") -> DataFrame:
    """For each query with expected documents: first_rank, mrr, and recall, coverage, ndcg, mrr at each k.

    ``ranked`` has (query, key, rank) with each document once. Queries without hits score zero.
    """
    wanted = expected.select(query_key, key).distinct().withColumn("_hit", F.lit(1))
    size = wanted.groupBy(query_key).agg(F.count("*").alias("n_expected"))
    hits = ranked.join(wanted, [query_key, key]).groupBy(query_key).agg(
        F.min("rank").alias("first_rank"),
        *[F.count_if(F.col("rank") <= k).alias(f"_n{k}") for k in ks],
        *[F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"_dcg{k}") for k in ks],
    )
    out, columns = size.join(hits, query_key, "left"), [query_key, "n_expected", "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        n = F.coalesce(F.col(f"_n{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_expected"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        columns += [(n > 0).cast("double").alias(f"recall_{k}"), (n / F.col("n_expected")).alias(f"coverage_{k}"), (F.coalesce(F.col(f"_dcg{k}"), F.lit(0.0)) / ideal).alias(f"ndcg_{k}"), F.when(F.col("first_rank") <= k, 1 / F.col("first_rank")).otherwise(0.0).alias(f"mrr_{k}")]
    return out.select(*columns)


def set_scores(found: Column, expected: Column) -> Column:
    """(precision, recall, f1) of two arrays; 0 where a side is empty."""
    both = F.size(F.array_intersect(found, expected))
    p = F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_distinct(found))), F.lit(0.0))
    r = F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_distinct(expected))), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


# --- facts ----------------------------------------------------------------------------------------------------


def fact_form(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s,]+", "")


def date_keys(text: Column) -> Column:
    """Dates in a text as eight digits, whatever their form."""
    return F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), lambda d: F.concat(F.regexp_extract(d, DATE, 1), F.lpad(F.regexp_extract(d, DATE, 2), 2, "0"), F.lpad(F.regexp_extract(d, DATE, 3), 2, "0")))


def matched_facts(answer: Column, groups: Column) -> Column:
    """How many groups of variants an answer meets: all words of a variant are in it, or a date of both is the same."""
    plain, dates = fact_form(answer), date_keys(F.coalesce(answer, F.lit("")))

    def variant(v: Column) -> Column:
        words = F.filter(F.split(F.trim(v), r"\s+"), lambda w: w != "")
        return ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(plain, fact_form(w)))) | F.arrays_overlap(date_keys(v), dates)

    return F.size(F.filter(groups, lambda g: F.exists(g, variant)))


# --- citations ------------------------------------------------------------------------------------------------


def _items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def cited(answer: Column, pattern: str = CITATION_AT_END) -> Column:
    """Documents of the citation block at the end; up to the last bracket, as names may have brackets."""
    return _items(F.regexp_extract(F.coalesce(answer, F.lit("")), pattern, 1))


def citation_coverage(answer: Column, required: Column) -> Column:
    """(matched, required)."""
    return F.struct(F.size(F.array_intersect(cited(answer), required)).alias("matched"), F.size(required).alias("required"))


def citation_status(answer: Column) -> Column:
    """(status, documents) of the last block that ends its line: valid at the end of the answer, else misplaced; missing without one."""
    blocks = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION_LINE), F.lit(1))
    last = F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.lit(""))
    status = F.when(F.size(blocks) == 0, "missing").when(F.rtrim(answer).rlike(r"(?i)\[\s*근거\s*:\s*(.+)\]\s*$"), "valid").otherwise("misplaced")
    return F.struct(status.alias("status"), _items(last).alias("documents"))


def citation_to_end(answer: Column) -> Column:
    """All citation blocks as one at the end, documents in order and once; unchanged without a block."""
    ids = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(CITATION_LINE), F.lit(1)), _items)))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, CITATION_LINE, ""), r"[ \t]+\n", "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(F.size(ids) > 0, F.concat(F.when(body != "", F.concat(body, F.lit("\n\n"))).otherwise(""), F.lit("[근거: "), F.array_join(ids, ", "), F.lit("]"))).otherwise(answer)


def valid_citation(ids: Column, corpus: Column, visual: Column) -> Column:
    """Cited documents that exist; where none does, those with visual evidence; else the citation as it was."""
    known = F.array_intersect(ids, corpus)
    return F.when(F.size(known) > 0, known).when(F.size(visual) > 0, visual).otherwise(ids)


def citation_scores(ids: Column, gold: Column, retrieved: Column) -> Column:
    """(recall, precision, unsupported): precision 0 where documents were required and none cited; unsupported null without retrieval."""
    both = F.size(F.array_intersect(ids, gold)).cast("double")
    recall = F.when(F.size(gold) > 0, both / F.size(gold))
    precision = F.when(F.size(ids) > 0, both / F.size(ids)).when(F.size(gold) > 0, F.lit(0.0))
    return F.struct(recall.alias("recall"), precision.alias("precision"), F.when(F.size(retrieved) > 0, F.size(F.array_except(ids, retrieved))).alias("unsupported"))


def context_documents(context: Column) -> Column:
    names = F.transform(F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(CONTEXT_LINE), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


# --- answers --------------------------------------------------------------------------------------------------


def response_status(answer: Column, error: Column, abstains: str = ABSTAINS, boilerplate: str = BOILERPLATE) -> Column:
    """execution_error, empty_response, answered, partial_answer or abstained.

    An answer that declines is partial where what is left of it has a digit or enough characters.
    """
    body = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), CITATION_AT_END, ""))
    residue = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(body), abstains, " "), boilerplate, " "), "[^0-9a-z가-힣%]+", "")
    return (
        F.when(F.trim(F.coalesce(error, F.lit(""))) != "", "execution_error")
        .when(F.trim(F.coalesce(answer, F.lit(""))) == "", "empty_response")
        .when(~F.lower(body).rlike(abstains), "answered")
        .when(residue.rlike(r"\d") | (F.length(residue) >= RESIDUE_FROM), "partial_answer")
        .otherwise("abstained")
    )


def has_marker(answer: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(F.coalesce(answer, F.lit("")), F.lit(m))
    return out


def item_score(lane: Column, status: Column, f1: Column, abstain_expected: Column, facts_met: Column, facts_all: Column) -> Column:
    """0 to 100: errors and empty answers 0; sets by F1; declining by status; else the share of facts, null without facts."""
    return (
        F.when(status.isin("execution_error", "empty_response"), F.lit(0.0))
        .when(lane == "set", f1 * 100)
        .when(abstain_expected, F.when(status == "abstained", 100.0).otherwise(0.0))
        .when(facts_all > 0, 100.0 * facts_met / facts_all)
    )


def failure_reasons(checks: dict[str, Column], status: Column) -> Column:
    """Names of the checks that hold, in order; a broken run has its status alone, a good one "none"."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return F.when(status.isin("execution_error", "empty_response"), F.array(status)).when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))


def evidence_id(chunk: Column, text: Column, prefix: str = "ev_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(chunk, F.lit("\0"), text), 256), 1, 24))


# --- runs -----------------------------------------------------------------------------------------------------


def final_attempts(attempts: DataFrame, case: str, ok: str, sequence: list[str]) -> DataFrame:
    """One attempt for each case: its last success, else its first attempt."""
    by = Window.partitionBy(case)
    order = [F.desc(ok)]
    nth = F.row_number().over(by.orderBy(*sequence))
    df = attempts.withColumn("_nth", nth).withColumn("_key", F.when(F.col(ok), -F.col("_nth")).otherwise(F.col("_nth")))
    return df.withColumn("_r", F.row_number().over(by.orderBy(*order, "_key"))).where("_r = 1").drop("_r", "_key", "_nth")


def pending(cases: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cases that a resumed run still has to do."""
    return cases.join(done.select(key).distinct(), key, "left_anti")


def lane_summary(details: DataFrame, lane: str, measures: list[str]) -> DataFrame:
    """Means and counts for each lane and for all ("all"), in one pass."""
    grouped = details.rollup(lane).agg(F.grouping(lane).alias("_g"), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures])
    return grouped.withColumn(lane, F.when(F.col("_g") == 1, "all").otherwise(F.col(lane))).drop("_g")


def run_statistics(runs: DataFrame, run: str, case: str, value: str, baseline) -> DataFrame:
    """Over runs: mean, sample deviation, least, most and range of their means, and the mean's distance to the baseline run."""
    means = runs.groupBy(run).agg(F.avg(value).alias("m"))
    base = means.agg(F.max(F.when(F.col(run) == F.lit(baseline), F.col("m"))).alias("base"))
    out = means.agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.min("m").alias("low"), F.max("m").alias("high"))
    return out.crossJoin(base).select("mean", "std", "low", "high", (F.col("high") - F.col("low")).alias("spread"), (F.col("mean") - F.col("base")).alias("delta"))


def variable_cases(runs: DataFrame, case: str, value: str) -> DataFrame:
    return runs.groupBy(case).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def best_by_metric(sweep: DataFrame, weight: str, metrics: list[str]) -> DataFrame:
    """(metric, best_weight, best): the smallest of the weights with the best value."""
    long = sweep.select(weight, F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics))).alias("metric", "value"))
    return long.groupBy("metric").agg(F.max_by(weight, F.struct("value", (-F.col(weight)).alias("w"))).alias("best_weight"), F.max("value").alias("best"))


def flips(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Cases that change between two runs: up, down, and those that stay."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("y") > F.col("x")).alias("up"), F.count_if(F.col("y") < F.col("x")).alias("down"), F.avg(F.col("y") - F.col("x")).alias("mean_change"))


def label_map(labels: DataFrame, corpus: DataFrame, key: str = "query_id", prefix: str = r"^\s*문서\s*:\s*") -> DataFrame:
    """(key, mapped, unmatched): labels (key, label) cleaned and looked up among corpus ids."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("label", prefix, ""), r"\s+", " "))
    known = corpus.select(F.trim(F.regexp_replace(F.col("doc_id").cast("string"), r"\s+", " ")).alias("clean"), F.col("doc_id").alias("found")).dropDuplicates(["clean"])
    out = labels.withColumn("clean", clean).join(known, "clean", "left")
    return out.groupBy(key).agg(F.array_sort(F.collect_set("found")).alias("mapped"), F.array_sort(F.collect_set(F.when(F.col("found").isNull(), F.col("label")))).alias("unmatched"))


@F.pandas_udf(DoubleType())
def name_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two names."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def likeliest_names(asked: DataFrame, names: DataFrame, asked_key: str, name_key: str, cutoff: float = 0.85) -> DataFrame:
    """(asked, name, ratio): for each asked string the name with the greatest ratio of at least ``cutoff``, the largest name of several.

    The ratio is twice the matching characters by the sum of both lengths, so it bounds the unmatched ones of either side.
    Each of the asked string's takes two of its bigrams with it, each of the name's one: one of one bigram more, the rarest
    ones, is in the name. Strings with fewer distinct bigrams are held against all names of their band of lengths.
    """
    n, m = F.char_length(asked_key), F.char_length(name_key)
    bigrams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    lost = F.floor(n * (2 * (1 - cutoff) / cutoff + 2 * (1 - cutoff) / (2 - cutoff)) + 1e-9)
    own = asked.select(asked_key).distinct().select(asked_key, bigrams(F.col(asked_key)).alias("_b"), lost.alias("_lost"))
    keyed = names.select(name_key).distinct().select(name_key, F.explode(bigrams(F.col(name_key))).alias("_g"))
    often = keyed.groupBy("_g").agg(F.count("*").alias("_df"))
    probes = own.where(F.size("_b") > F.col("_lost")).select(asked_key, "_lost", F.explode("_b").alias("_g")).join(often, "_g", "left")
    nth = F.row_number().over(Window.partitionBy(asked_key).orderBy(F.asc_nulls_first("_df"), "_g"))
    rare = probes.withColumn("_nth", nth).where((F.col("_nth") <= F.col("_lost") + 1) & F.col("_df").isNotNull())
    band = 2 * F.least(n, m) >= cutoff * (n + m)
    met = rare.select(asked_key, "_g").join(keyed, "_g").where(band).select(asked_key, name_key).distinct()
    few = own.where(F.size("_b") <= F.col("_lost")).select(asked_key)
    met = met.union(names.select(name_key).distinct().join(few, band).select(asked_key, name_key))
    rated = met.withColumn("ratio", name_likeness(asked_key, name_key)).where(F.col("ratio") >= cutoff)
    return rated.groupBy(asked_key).agg(F.max_by(name_key, F.struct("ratio", name_key)).alias(name_key), F.max("ratio").alias("ratio"))


def replay_errors(answer: Column, abstained: Column, ids: Column, evidence: Column, unsupported: Column) -> Column:
    """Codes of what is wrong with a stored result."""
    checks = {
        "empty_answer": F.trim(F.coalesce(answer, F.lit(""))) == "",
        "answer_without_citation": ~abstained & (F.size(ids) == 0),
        "citation_without_evidence": F.size(F.array_except(ids, evidence)) > 0,
        "unsupported_mismatch": F.array_sort(F.array_except(ids, evidence)) != F.array_sort(unsupported),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


# --- checks of golden data -----------------------------------------------------------------------------------


def triage(labels: DataFrame, corpus: DataFrame, duplicates: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """(label, found, how): a label is a corpus id, a known duplicate of one, much like one, or unresolved."""
    ids = corpus.select(F.col("doc_id").alias("found")).distinct()
    exact = labels.select("label").distinct().join(ids, F.col("label") == F.col("found"), "left")
    twin = exact.where("found is null").select("label").join(duplicates.select(F.col("doc_id").alias("label"), F.col("dup_of").alias("found")), "label", "left")
    open_ = twin.where("found is null").select("label")
    best = likeliest_names(open_, ids, "label", "found", cutoff).select("label", "found")
    rest = open_.join(best, "label", "left").select("label", "found", F.when(F.col("found").isNull(), "unresolved").otherwise("fuzzy").alias("how"))
    return exact.where("found is not null").select("label", "found", F.lit("exact").alias("how")).unionByName(twin.where("found is not null").select("label", "found", F.lit("duplicate").alias("how"))).unionByName(rest)


def progress(golden: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """Questions written so far against targets; kinds without a question count 0."""
    have = golden.groupBy(by).agg(F.count("*").alias("n"))
    return targets.join(have, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"), "target", (F.col("target") - F.coalesce("n", F.lit(0))).alias("missing"))


def provenance(levels: Column, generated: tuple[str, ...] = ("blind", "located")) -> Column:
    """Flags of where visual evidence comes from."""
    return F.struct(F.exists(levels, lambda x: x.isin(*generated)).alias("generated"), F.exists(levels, lambda x: x == "gold").alias("gold"), (F.size(levels) == 0).alias("none"))


def recall_of(expected: Column, found: Column) -> Column:
    """Share of expected documents found; null where none is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, found)) / F.size(expected))
