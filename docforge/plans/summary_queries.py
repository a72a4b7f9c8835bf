"""Queries on whole runs: questions and replies of conversations as golden cases and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.operators import chunking, contexts, names
from docforge.operators import summary as S
from docforge.plans.common import shared_folder, table
from docforge.plans.registry import query
from docforge.plans.retrieval_queries import BM25_SQL, CHUNKS_SQL
from docforge.plans.retrieval_queries import _bm25 as best_by_words

_DETAILS = r"""
  golden as (select conv_id || '-' || turn as id, text as q from conversations where role = 'user'), said as (select conv_id || '-' || (turn - 1) as id, text as a from conversations where role = 'assistant'),
  w as (select id, q, a, list_sort(list_distinct(list_filter(string_split(lower(q), ' '), lambda x: x <> ''))) as qw, list_distinct(list_filter(string_split(lower(coalesce(a, '')), ' '), lambda x: x <> '')) as aw from golden left join said using (id)),
  f as (select *, qw[1:3] as facts, len(list_intersect(qw, aw)) as both_n, case when trim(coalesce(a, '')) = '' then 'empty_response' when contains(a, '?') then 'partial_answer' when length(a) < 60 then 'abstained' else 'answered' end as response_status from w),
  m as (select *, len(list_filter(facts, lambda x: contains(lower(coalesce(a, '')), x))) as met, len(list_filter(facts, lambda x: contains(lower(substr(coalesce(a, ''), 1, 100)), x))) as early, length(q) < 30 as expects from f),
  details as (select id, case when length(q) % 2 = 0 then 'set' else 'answer' end as lane, response_status, both_n / nullif(len(qw), 0) as retrieval_recall, early / nullif(len(facts), 0) as context_fact_coverage, 100 * met / nullif(len(facts), 0) as lexical_fact_score,
    (response_status = 'abstained') = expects as abstention_match, case when length(q) % 2 = 0 then 2 * both_n / nullif(len(qw) + len(aw), 0) end as list_f1,
    case when not contains(coalesce(a, ''), '.') then 'missing' when ends_with(a, '.') then 'valid' else 'misplaced' end as citation_status, len(list_filter(aw, lambda x: length(x) >= 12 and not list_contains(qw, x))) as unsupported_citation_count,
    case when expects then case when response_status = 'abstained' then 100.0 else 0.0 end else 100 * met / nullif(len(facts), 0) end as compatible_score, len(list_filter(qw[1:2], lambda x: contains(coalesce(a, ''), x))) / nullif(len(qw[1:2]), 0) as document_mention_coverage from m)
"""


def _details(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    case = lambda back: F.concat_ws("-", "conv_id", (F.col("turn") - back).cast("string")).alias("id")
    golden, said = c.where("role = 'user'").select(case(0), F.col("text").alias("q")), c.where("role = 'assistant'").select(case(1), F.col("text").alias("a"))
    rows, _ = S.joined(golden, said, shared_folder(spark, "summary"))
    a, words = F.coalesce("a", F.lit("")), lambda t: F.sort_array(F.array_distinct(F.filter(F.split(F.lower(t), " "), lambda x: x != "")))
    rows = rows.withColumns({"qw": words(F.coalesce("q", F.lit(""))), "aw": words(a)})
    facts = F.slice("qw", 1, 3)
    status = F.when(F.trim(a) == "", "empty_response").when(F.contains(a, F.lit("?")), "partial_answer").when(F.length(a) < 60, "abstained").otherwise("answered")
    rows = rows.withColumns({"response_status": status, "facts": facts, "both_n": F.size(F.array_intersect("qw", "aw")), "expects": F.length("q") < 30, "is_set": F.length("q") % 2 == 0})
    met = lambda text: F.size(F.filter("facts", lambda x: F.contains(text, x))) / F.nullif(F.size("facts"), F.lit(0))
    match = (F.col("response_status") == "abstained") == F.col("expects")
    return rows.select(
        "id", F.when(F.col("is_set"), "set").otherwise("answer").alias("lane"), "response_status", (F.col("both_n") / F.nullif(F.size("qw"), F.lit(0))).alias("retrieval_recall"), met(F.lower(F.substring(a, 1, 100))).alias("context_fact_coverage"),
        (100 * met(F.lower(a))).alias("lexical_fact_score"), match.alias("abstention_match"), F.when(F.col("is_set"), 2 * F.col("both_n") / F.nullif(F.size("qw") + F.size("aw"), F.lit(0))).alias("list_f1"),
        F.when(~F.contains(a, F.lit(".")), "missing").when(F.endswith(a, F.lit(".")), "valid").otherwise("misplaced").alias("citation_status"), F.size(F.filter("aw", lambda x: (F.length(x) >= 12) & ~F.array_contains("qw", x))).alias("unsupported_citation_count"),
        S.compatible_score(F.col("expects"), match, met(F.lower(a))).alias("compatible_score"), S.mention_coverage(F.col("a"), F.slice("qw", 1, 2)).alias("document_mention_coverage"),
    )


_MEANS = ("lexical_fact_score", "retrieval_recall", "context_fact_coverage", "abstention_match", "list_f1", "document_mention_coverage", "compatible_score")


@query(f"""with {_DETAILS} select coalesce(lane, 'all') as lane, count(*) as cases, {', '.join(f"count_if(response_status = '{s}')::bigint as {s}" for s in S.STATUSES)}, round(avg((response_status not in ('execution_error', 'empty_response'))::int), 6) as generation_success,
  {', '.join(f'round(avg({m}::double), 6) as {m}' for m in _MEANS)}, round(avg((retrieval_recall = 1)::int), 6) as retrieval_recall_full, round(avg((context_fact_coverage = 1)::int), 6) as context_fact_coverage_full from details group by grouping sets ((lane), ())""")
def guarded_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means and counts of a run by lane, after the ids were guarded."""
    out = S.summary(_details(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"""with {_DETAILS}, r as (select unnest(case when response_status in ('execution_error', 'empty_response') then [response_status] else list_filter([case when retrieval_recall = 0 then 'retrieval_failure' end, case when context_fact_coverage = 0 then 'context_fact_missing' end,
  case when not abstention_match then 'abstention_mismatch' end, case when list_f1 < 1 then 'set_mismatch' end, case when lexical_fact_score < 100 then 'fact_incomplete_or_mismatch' end, case citation_status when 'missing' then 'citation_missing' when 'misplaced' then 'citation_misplaced' end,
  case when unsupported_citation_count > 0 then 'unsupported_citation' end], lambda x: x is not null) end) as value from details) select value, count(*) as n from r group by 1""")
def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each reason of a failure stands in a run."""
    details = _details(spark, d)
    return S.histogram(details.withColumn("reasons", S.reasons(details)), "reasons")


@query("""with a as (select 'answer' as lane, 'a-' || item_id as id, text as question, ['' || (item_id * 3), 'no ' || item_id] as labels, case when item_id % 3 = 0 then 'abstain' end as decision, item_id % 2 = 0 as enabled from benchmark),
  s as (select 'set', 's-' || conv_id || '-' || turn, text, ['' || conv_id, '' || (conv_id + turn)], null, null from conversations where role = 'user'),
  v as (select 'visual', 'v-' || page_id, url, ['' || (page_id * 2)], case when page_id % 2 = 0 then 'answer' end, true from pages), u as (select * from a union all select * from s union all select * from v),
  l as (select distinct id, unnest(labels) as label from u), m as (select id, count(doc_id) as n_expected, count(*) - count(doc_id) as n_unmatched, min(doc_id) as first_expected from l left join documents on cast(doc_id as varchar) = label group by 1)
  select lane, id, md5(question) as question, decision, enabled, n_expected, n_unmatched, first_expected from u join m using (id)""")
def golden_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Three lanes of different shape, written as JSON lines and CSV, read back as one table with their labels looked up."""
    from docforge.sources import lanes

    root = shared_folder(spark, "lanes")
    i, n, p = F.col("item_id"), F.col("conv_id"), F.col("page_id")
    text = lambda c: c.cast("string")
    table(spark, d, "benchmark").select(F.concat(F.lit("a-"), text(i)).alias("case_id"), F.col("text").alias("question"), F.array(text(i * 3), F.concat(F.lit(" no  "), text(i))).alias("source_labels"), F.struct(F.when(i % 3 == 0, "abstain").alias("decision")).alias("gold"), (i % 2 == 0).alias("enabled")).write.json(f"{root}/answer")
    table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", F.lit("s"), text(n), "turn").alias("ID"), F.col("text").alias("질문"), F.concat(text(n), F.lit(" | "), text(n + F.col("turn"))).alias("문서")).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{root}/set.csv")
    table(spark, d, "pages").select(F.concat(F.lit("v-"), text(p)).alias("case_id"), F.col("url").alias("question"), F.struct(text(p * 2).alias("source_filename")).alias("document"), F.struct(F.when(p % 2 == 0, "answer").alias("decision")).alias("gold"), F.lit(True).alias("enabled")).write.json(f"{root}/visual")
    kinds = {"labels": "array<string>", "enabled": "boolean"}
    own = [
        lanes.Lane("answer", f"{root}/answer", {"id": ("$.case_id", "$.id"), "question": ("$.question",), "labels": ("$.source_labels",), "decision": ("$.gold.decision",), "enabled": ("$.enabled",)}, kinds),
        lanes.Lane("set", f"{root}/set.csv", {"id": ("$.id", "$.ID"), "question": ("$.question", "$['질문']"), "labels": ("$.labels", "$['문서']")}, kinds),
        lanes.Lane("visual", f"{root}/visual", {"id": ("$.case_id",), "question": ("$.question",), "labels": ("$.document.source_filename",), "decision": ("$.gold.decision",), "enabled": ("$.enabled",)}, kinds),
    ]
    out = lanes.resolved(lanes.union(spark, own), table(spark, d, "documents"))
    return out.select("lane", "id", F.md5("question").alias("question"), "decision", "enabled", F.size("expected").cast("long").alias("n_expected"), "n_unmatched", F.get("expected", F.lit(0)).alias("first_expected"))


@query(rf"""with {BM25_SQL}, {CHUNKS_SQL}, q as (select item_id as query_id, text, list_sort(list_distinct(list_filter(string_split(text, ' '), lambda x: length(x) >= 9)))[1:2] as words, length(text) % 5 = 0 as aggregates from benchmark),
  hints as (select query_id, doc_id from q join documents d on contains(d.text, substr(q.text, 1, 30))), conditioned as (select query_id, doc_id from q join documents on n_chars = length(q.text) and length(q.text) % 3 = 0),
  k as (select q.*, coalesce(n, 0) as n, query_id in (select query_id from conditioned) as fits from q left join (select query_id, count(*) as n from hints group by 1) using (query_id)),
  r as (select *, case when n > 0 and aggregates then 'all' when n = 1 and len(words) > 0 then 'words' when n > 1 then 'several' when n = 1 then 'document' when fits then 'conditions' else 'search' end as route from k),
  named as (select r.query_id, doc_id, words, route from r join hints using (query_id) join documents using (doc_id) qualify route <> 'all' or row_number() over (partition by r.query_id order by len(list_filter(words, lambda w: contains(cast(doc_id as varchar), w) or contains(source, w))) desc, doc_id) = 1),
  own as (select n.*, nth, list_bool_or(list_transform(words, lambda w: contains(c.text, w))) as found from (select * from named union all select r.query_id, doc_id, words, route from r join conditioned using (query_id) where route = 'conditions') n join c using (doc_id)),
  h as (select *, coalesce(found, false)::int as hit, sum(coalesce(found, false)::int) over w as hits, sum(coalesce(found, false)::int) over (w order by nth) as hit_no, row_number() over (w order by nth) as no from own window w as (partition by query_id, doc_id)),
  p as (select * from h where case route when 'all' then true when 'words' then hits > 0 and (hit = 1 and hit_no <= 20 or no <= 10) when 'several' then case when hits > 0 then hit = 1 and hit_no <= 8 else no <= 8 end when 'document' then no <= 15 else no <= 3 end)
  select query_id, route, doc_id, nth from p union all select query_id, 'search', doc_id, 0 from bm_ranked join r using (query_id) where rank <= 3 and (route = 'search' or route = 'words' and query_id not in (select query_id from p))""")
def context_routes(spark: SparkSession, d: str) -> DataFrame:
    """Which chunks of 50 words each question is answered from, by all six routes."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = F.slice(F.sort_array(F.array_distinct(F.filter(F.split("text", " "), lambda x: F.length(x) >= 9))), 1, 2)
    q = items.select("query_id", words.alias("words"), (F.length("text") % 5 == 0).alias("aggregates"))
    hints = names.contained(docs, items.select("query_id", F.substring("text", 1, 30).alias("head")), "doc_id", "text", "query_id", "head", piece=24).withColumn("nth", F.col("doc_id"))
    own = items.where(F.length("text") % 3 == 0).select("query_id", F.length("text").alias("n_chars"))
    chunks = chunking.word_windows(docs, 50).select("doc_id", F.col("nth").alias("chunk_id"), "nth", "text")
    searched = best_by_words(spark, d, 3).select("query_id", "doc_id", F.lit(0).cast("long").alias("chunk_id"), "rank")
    out = contexts.assembled(q, hints, chunks, docs.select("doc_id", F.col("source").alias("owner")), docs.select("doc_id", "n_chars").join(own, "n_chars").select("query_id", "doc_id"), searched)
    return out.select("query_id", "route", "doc_id", F.col("chunk_id").cast("long").alias("nth"))
