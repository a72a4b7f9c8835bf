"""Queries on scores: rankings, facts, citations, answers, lanes, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import evaluation as E
from docforge.operators import retrieval as R
from docforge.operators import scoring as S
from docforge.plans.common import shared_folder, table
from docforge.plans.registry import query
from docforge.plans.retrieval_queries import BM25_SQL, _SIDES, _bm25, _by_vector


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return R.containing(table(spark, d, "documents"), items, "doc_id", "text", "query_id", "passage")


_METRICS = f"""{BM25_SQL}, x as (select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)), n as (select query_id, count(*) as n_expected from x group by 1),
  h as (select r.query_id, rank from bm_ranked r join x on x.query_id = r.query_id and x.doc_id = r.doc_id where rank <= 20)"""


@query(f"""with {_METRICS}, g as (select query_id, min(rank) as first_rank, count_if(rank <= 5) as n5, coalesce(sum(case when rank <= 5 then 1 / log2(rank + 1) end), 0) as dcg5 from h group by 1)
  select query_id, n_expected, first_rank, round(coalesce(1 / first_rank, 0), 6) as mrr, (coalesce(n5, 0) > 0)::int::double as recall_5, round(coalesce(n5, 0) / n_expected, 6) as coverage_5,
    round(coalesce(dcg5, 0) / list_sum(list_transform(range(1, least(n_expected, 5) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg_5 from n left join g using (query_id)""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = E.retrieval_metrics(_bm25(spark, d, 20), _expected(spark, d))
    return m.select("query_id", "n_expected", F.col("first_rank").cast("long").alias("first_rank"), *[F.round(c, 6).alias(c) for c in ("mrr", "recall_5", "coverage_5", "ndcg_5")])


@query(f"""with {_METRICS}, p as (select query_id, list(doc_id) as found from bm_ranked where rank <= 10 group by 1), e as (select query_id, list(doc_id) as expected from x group by 1), s as (select query_id, len(list_intersect(found, expected)) as hit, len(found) as f, len(expected) as e from e join p using (query_id))
  select query_id, round(hit / f, 6) as precision, round(hit / e, 6) as recall, round(case when hit > 0 then 2 * (hit / f) * (hit / e) / (hit / f + hit / e) else 0 end, 6) as f1 from s""")
def set_prf(spark: SparkSession, d: str) -> DataFrame:
    found = _bm25(spark, d, 10).groupBy("query_id").agg(F.collect_list("doc_id").alias("found"))
    wanted = _expected(spark, d).groupBy("query_id").agg(F.collect_list("doc_id").alias("expected"))
    out = wanted.join(found, "query_id").select("query_id", E.set_scores(F.col("found"), F.col("expected")).alias("s"))
    return out.select("query_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""with {_SIDES}, g as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]) as alpha), x as (select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)),
  f as (select alpha, query_id, doc_id, sum(part) as score from (select alpha, query_id, doc_id, (1 - alpha) * norm as part from a, g union all select alpha, query_id, doc_id, alpha * norm from b, g) group by 1, 2, 3),
  r as (select *, row_number() over (partition by alpha, query_id order by round(score, 9) desc, doc_id) as rank from f),
  m as (select alpha, x.query_id, min(rank) as first from x cross join g left join r using (alpha, query_id, doc_id) group by 1, 2), s as (select alpha, round(avg(coalesce(1 / first, 0)), 6) as mrr, round(avg((coalesce(first, 99) <= 3)::int), 6) as recall from m group by 1)
  select 'mrr' as metric, max_by(alpha, mrr - alpha * 1e-9)::double as best_weight, max(mrr) as best from s union all select 'recall', max_by(alpha, recall - alpha * 1e-9)::double, max(recall) from s""")
def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Both sides are ranked and normalised once; the grid of weights multiplies their few candidates only."""
    a = R.minmax(_bm25(spark, d, 20)).select("query_id", "doc_id", F.col("norm").alias("lex"), F.lit(0.0).alias("vec"))
    b = R.minmax(_by_vector(spark, d, 20)).select("query_id", "doc_id", F.lit(0.0).alias("lex"), F.col("norm").alias("vec"))
    both = a.unionByName(b).groupBy("query_id", "doc_id").agg(F.sum("lex").alias("lex"), F.sum("vec").alias("vec"))
    grid = both.withColumn("alpha", F.explode(F.array(*[F.lit(w / 4) for w in range(5)]))).withColumn("score", F.round((1 - F.col("alpha")) * F.col("lex") + F.col("alpha") * F.col("vec"), 9))
    from pyspark.sql import Window

    ranked = grid.withColumn("rank", F.row_number().over(Window.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "doc_id")))
    asked = _expected(spark, d).withColumn("alpha", F.explode(F.array(*[F.lit(w / 4) for w in range(5)])))
    first = asked.join(ranked, ["alpha", "query_id", "doc_id"], "left").groupBy("alpha", "query_id").agg(F.min("rank").alias("first"))
    sweep = first.groupBy("alpha").agg(F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.coalesce("first", F.lit(99)) <= 3).cast("double")), 6).alias("recall"))
    return E.best_by_metric(sweep, "alpha", ["mrr", "recall"])


@query("""with t as (select conv_id, turn, regexp_replace(text, '[\\s,]+', '', 'g') as plain from conversations where role = 'assistant')
  select conv_id, turn, (contains(plain, 'the')::int + (contains(plain, 'und') and contains(plain, 'die'))::int + (turn % 2 = 1)::int)::bigint as matched from t""")
def fact_coverage(spark: SparkSession, d: str) -> DataFrame:
    groups = F.expr("array(array('the'), array('zzz zzz', 'und die'), array('2024-10-31', '20241031'))")
    answer = F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit(" 2024. 10. 31."))).otherwise(F.col("text"))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", E.matched_facts(answer, groups).cast("long").alias("matched"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a citation block at the end, in the middle, twice, or not at all."""
    k, nl = F.col("turn") % 4, F.lit("\n")
    block = F.concat(F.lit("[근거: a"), F.col("conv_id").cast("string"), F.lit(".hwp, b[재].pdf]"))
    plain = F.regexp_replace("text", r"\s+", " ")
    answer = F.when(k == 0, F.concat(plain, nl, block)).when(k == 1, F.concat(plain, nl, block, nl, F.lit("more"))).when(k == 2, F.concat(block, nl, plain, nl, F.lit("[근거: b[재].pdf, c]"))).otherwise(plain)
    return table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer"), plain.alias("plain"))


_ID = "'a' || cast(conv_id as varchar) || '.hwp'"


@query(f"""select conv_id, turn, case turn % 4 when 0 then 'valid' when 1 then 'misplaced' when 2 then 'valid' else 'missing' end as status,
  case turn % 4 when 0 then {_ID} || ', b[재].pdf' when 1 then {_ID} || ', b[재].pdf' when 2 then 'b[재].pdf, c' else '' end as documents from conversations""")
def citation_status(spark: SparkSession, d: str) -> DataFrame:
    out = _answers(spark, d).select("conv_id", "turn", E.citation_status(F.col("answer")).alias("c"))
    return out.select("conv_id", "turn", "c.status", F.array_join("c.documents", ", ").alias("documents"))


@query(rf"""with t as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as p, regexp_replace(text, '\s+', ' ', 'g') as plain from conversations)
  select conv_id, turn, md5(case turn % 4 when 0 then p || chr(10) || chr(10) || '[근거: ' || {_ID} || ', b[재].pdf]' when 1 then p || chr(10) || chr(10) || 'more' || chr(10) || chr(10) || '[근거: ' || {_ID} || ', b[재].pdf]'
    when 2 then p || chr(10) || chr(10) || '[근거: ' || {_ID} || ', b[재].pdf, c]' else plain end) as digest from t""")
def citation_to_end(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("conv_id", "turn", F.md5(E.citation_to_end(F.col("answer"))).alias("digest"))


@query(f"""select conv_id, turn, (case turn % 4 when 0 then 0.5 when 2 then 0.5 else 0.0 end)::double as recall, (case turn % 4 when 0 then 0.5 when 2 then 1 / 3 else 0.0 end)::double as precision, (case turn % 4 when 0 then 1 when 2 then 2 else 0 end)::bigint as unsupported from conversations where turn % 4 <> 2
  union all select conv_id, turn, 0.5, 0.5, 1 from conversations where turn % 4 = 2""")
def citation_scores(spark: SparkSession, d: str) -> DataFrame:
    gold = F.array(F.lit("b[재].pdf"), F.lit("zz"))
    kept = F.array(F.lit("b[재].pdf"))
    out = _answers(spark, d).select("conv_id", "turn", E.citation_scores(E.cited(F.col("answer"), r"(?i)\[\s*근거\s*:\s*(a[^\n]+|b[^\n]+)\]\s*$"), gold, kept).alias("s"))
    return out.select("conv_id", "turn", "s.recall", "s.precision", F.col("s.unsupported").cast("long").alias("unsupported"))


@query("select conv_id, turn, 'n [긴급] ' || cast(conv_id as varchar) || ';x' as documents from conversations")
def context_documents(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("[문서: n [긴급] "), F.col("conv_id").cast("string"), F.lit("]\n"))
    text = F.concat(name, F.lit("body\n"), F.lit("[문서: x]\nbody\n"), name)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(E.context_documents(text), ";").alias("documents"))


@query("""select case turn % 6 when 0 then 'execution_error' when 1 then 'empty_response' when 2 then 'abstained' when 3 then 'partial_answer' when 4 then 'partial_answer' else 'answered' end as status, count(*) as n from conversations group by 1""")
def response_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 6
    answer = F.when(k == 1, " ").when(k == 2, "확인할 수 없습니다.\n[근거: a]").when(k == 3, "금액은 알 수 없으나 3건").when(k == 4, "알 수 없지만 " + "가나다라마바사아자차카타파하거너").otherwise(F.lit("예산은 5억원"))
    error = F.when(k == 0, "timeout")
    return table(spark, d, "conversations").groupBy(E.response_status(answer, error).alias("status")).agg(F.count("*").alias("n"))


@query()
def option_matching(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text", F.lit("the of and 12").alias("option"))
    rows = rows.withColumn("answer", T.normal_form(F.concat("text", F.lit(" 12"))))
    return rows.select("conv_id", "turn", S.states_option(F.col("answer"), F.col("option")).alias("matches"))


@query("""select conv_id, turn, (case turn % 5 when 0 then 0 when 1 then 40 when 2 then 100 when 3 then 50 end)::double as score from conversations""")
def item_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 5
    score = E.item_score(F.when(k == 1, "set").otherwise("answer"), F.when(k == 0, "empty_response").when(k == 2, "abstained").otherwise("answered"), F.lit(0.4), k == 2, F.lit(1), F.when(k == 3, 2).otherwise(0))
    return table(spark, d, "conversations").select("conv_id", "turn", score.alias("score"))


@query("""with r as (select conv_id, turn, case when turn % 5 = 0 then 'empty_response' when turn % 2 = 0 and turn % 3 = 0 then 'facts,citation' when turn % 2 = 0 then 'facts' when turn % 3 = 0 then 'citation' else 'none' end as reasons from conversations)
  select reason, count(*) as n from (select unnest(string_split(reasons, ',')) as reason from r) where reason <> 'none' group by 1""")
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    reasons = E.failure_reasons({"facts": t % 2 == 0, "citation": t % 3 == 0}, F.when(t % 5 == 0, "empty_response").otherwise("answered"))
    return table(spark, d, "conversations").select(F.explode(reasons).alias("reason")).where("reason <> 'none'").groupBy("reason").agg(F.count("*").alias("n"))


@query("select coalesce(event_type, 'all') as lane, count(*) as n, round(avg(value), 6) as value from events group by grouping sets ((event_type), ())")
def lane_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.lane_summary(table(spark, d, "events").withColumnRenamed("event_type", "lane"), "lane", ["value"]).select("lane", "n", F.round("value", 6).alias("value"))


@query("""with m as (select event_type, avg(value) as m from events group by 1) select round(avg(m), 6) as mean, round(stddev_samp(m), 6) as std, round(min(m), 6) as low, round(max(m), 6) as high, round(max(m) - min(m), 6) as spread,
  round(avg(m) - max(case when event_type = 'click' then m end), 6) as delta from m""")
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = E.run_statistics(table(spark, d, "events"), "event_type", "user_id", "value", "click")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("select user_id, count(distinct event_type) as n_values from events group by 1 having count(distinct event_type) > 1")
def variable_cases(spark: SparkSession, d: str) -> DataFrame:
    return E.variable_cases(table(spark, d, "events"), "user_id", "event_type")


_FINAL = "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as k, event_type <> 'error' as ok from events) qualify row_number() over (partition by user_id order by ok desc, case when ok then -k else k end) = 1"


@query(_FINAL)
def final_attempt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return E.final_attempts(rows, "user_id", "ok", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(_FINAL)
def final_attempt_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the log."""
    from docforge.streaming import attempts

    root = shared_folder(spark, "attempts")
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", (F.col("event_type") != "error").alias("ok"))
    n = max(4, spark.sparkContext.defaultParallelism)  # files, read in two batches
    rows.repartition(n, "event_id").write.mode("overwrite").parquet(f"{root}/log")
    schema = "user_id long, event_id long, ts timestamp, event_type string, ok boolean"
    attempts.follow(spark, f"{root}/log", schema, f"{root}/table", f"{root}/checkpoint", "user_id", "ok", ["ts", "event_id"], files=-(-n // 2)).awaitTermination()
    return attempts.finals(spark, f"{root}/table", schema, "user_id", "ok", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n from events group by all")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from docforge.streaming.attempts import windowed_counts as counts

    return counts(table(spark, d, "events"), "ts", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("select distinct user_id from events where user_id not in (select user_id from events where event_type = 'purchase' and value > 90)")
def pending_cases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return E.pending(e.select("user_id").distinct(), e.where("event_type = 'purchase' and value > 90"), "user_id")


@query("select doc_id, 'ev_' || substr(sha256(cast(doc_id as varchar) || '-chunk' || chr(0) || text), 1, 24) as evidence_id from documents")
def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", E.evidence_id(F.concat(F.col("doc_id").cast("string"), F.lit("-chunk")), F.col("text")).alias("evidence_id"))


@query("""select case turn % 4 when 0 then 'empty_answer,answer_without_citation' when 1 then '' when 2 then 'citation_without_evidence,unsupported_mismatch' else 'citation_without_evidence' end as errors, count(*) as n from conversations group by 1""")
def replay_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("turn") % 4
    none = F.expr("cast(array() as array<string>)")
    ids = F.when(k == 0, none).when(k == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("z")))
    errors = E.replay_errors(F.when(k == 0, "").otherwise(F.col("text")), F.lit(False), ids, F.array(F.lit("a")), F.when(k == 3, F.array(F.lit("z"))).otherwise(none))
    return table(spark, d, "conversations").groupBy(F.array_join(errors, ",").alias("errors")).agg(F.count("*").alias("n"))


@query("select c_nationkey as query_id, count(*) filter (where c_custkey % 3 > 0)::bigint as n_mapped, count(*) filter (where c_custkey % 3 = 0)::bigint as n_unmatched from customer group by 1")
def label_mapping(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    labels = c.select(F.col("c_nationkey").alias("query_id"), F.concat(F.lit("문서:  "), F.regexp_replace("c_name", "#", "   no  ")).alias("label"))
    corpus = c.where("c_custkey % 3 > 0").select(F.regexp_replace("c_name", "#", " no ").alias("doc_id"))
    return E.label_map(labels, corpus).select("query_id", F.size("mapped").cast("long").alias("n_mapped"), F.size("unmatched").cast("long").alias("n_unmatched"))


@query("""with a as (select user_id, round(avg(value), 6) as x from events where event_id % 2 = 0 group by 1), b as (select user_id, round(avg(value), 6) as y from events where event_id % 2 = 1 group by 1)
  select count(*) as n, count_if(y > x)::bigint as up, count_if(y < x)::bigint as down, round(avg(y - x), 5) as mean_change from a join b using (user_id)""")
def run_flips(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    return E.flips(half(0), half(1), "user_id", "v").select("n", "up", "down", F.round("mean_change", 5).alias("mean_change"))


@query("""with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all) select c_nationkey, c_mktsegment, n from c qualify rank() over (partition by c_nationkey order by n desc) = 1""")
def mode_with_ties(spark: SparkSession, d: str) -> DataFrame:
    from docforge.operators.analytics import extremes

    return extremes(table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")), "n", True, ["c_nationkey"])


@query()
def name_matching(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest part name for each of the misspelt ones: the sixth character of every name is another."""
    p = table(spark, d, "part").select("p_name").distinct()
    asked = p.select(F.concat(F.substring("p_name", 1, 5), F.lit("x"), F.expr("substring(p_name, 7)")).alias("asked")).distinct()
    return E.likeliest_names(asked, p, "asked", "p_name").select("asked", F.col("p_name").alias("found"))


_STATED = """a as (select doc_id, case doc_id % 6 when 0 then text when 1 then '제공된 문서에서 확인할 수 없습니다.' when 2 then string_split(text, chr(10))[1] || '. 확인할 수 없습니다.' when 3 then '확인되지 않습니다. 예산은 ' || doc_id || '억원입니다.'
  when 4 then '알 수 없습니다. 따라서 ' || lang || ' 참여는 가능합니다. ' || lang || ' 수준이 높습니다.' else source || ': 확인할 수 없습니다' end as answer from documents)"""


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """Answers that decline wholly, in part, first or not at all, with the documents' own texts in them."""
    k, text, lang = F.col("doc_id") % 6, F.col("text"), F.col("lang")
    answer = (
        F.when(k == 0, text).when(k == 1, "제공된 문서에서 확인할 수 없습니다.").when(k == 2, F.concat(F.get(F.split(text, "\n"), F.lit(0)), F.lit(". 확인할 수 없습니다.")))
        .when(k == 3, F.concat(F.lit("확인되지 않습니다. 예산은 "), F.col("doc_id").cast("string"), F.lit("억원입니다.")))
        .when(k == 4, F.concat(F.lit("알 수 없습니다. 따라서 "), lang, F.lit(" 참여는 가능합니다. "), lang, F.lit(" 수준이 높습니다."))).otherwise(F.concat("source", F.lit(": 확인할 수 없습니다")))
    )
    return table(spark, d, "documents").select("doc_id", answer.alias("answer"))


@query(f"""with {_STATED} select doc_id, case when answer is null then true else contains(answer, '확인할 수 없습니다') and len(list_filter(regexp_split_to_array(answer, '\\r\\n|\\n|\\r'),
  lambda x: length(regexp_replace(replace(replace(x, '제공된 문서에서 확인할 수 없습니다', ''), '확인할 수 없습니다', ''), '[\\s.,:;\\-·※]+', '', 'g')) >= 15)) = 0 end as declined from a""")
def abstention_lines(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d).select("doc_id", S.declines_by_lines(F.col("answer")).alias("declined"))


_SENTENCE = f"""case when regexp_matches(x, '{S.DECLINES}') then regexp_matches(regexp_replace(regexp_replace(x, '{S.DECLINES}', ' ', 'g'), '\\([^)]*\\)', ' ', 'g'), '{S.QUANTITY}')
  else regexp_matches(regexp_replace(lower(x), '{S.NO_CONTENT}', '', 'g'), '\\d') or length(regexp_replace(lower(x), '{S.NO_CONTENT}', '', 'g')) >= 15 end"""


@query(f"""with {_STATED}, b as (select doc_id, answer, regexp_replace(trim(answer), '{S.FILE_IN_BRACKETS}', ' ', 'g') as body from a)
  select doc_id, case when trim(coalesce(answer, '')) = '' then 'empty_response' when regexp_matches(body, '{S.DECLINES_FIRST}') and not regexp_matches(regexp_replace(body, '{S.DECLINES_FIRST}', ''), '{S.FIRM}') then 'abstained'
    when not regexp_matches(body, '{S.DECLINES}') then 'answered' when len(list_filter(regexp_split_to_array(body, '{S.SENTENCE_END}'), lambda x: {_SENTENCE})) > 0 then 'partial_answer' else 'abstained' end as status from b""")
def response_statuses(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d).select("doc_id", S.response_status_leading(F.col("answer"), F.lit(None).cast("string")).alias("status"))


@query(r"""with w as (select doc_id, lower(coalesce(text, '')) as answer, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z가-힣%]+') as ws from documents),
  o as (select doc_id, answer, concat_ws(' ', ws[4], ws[2], 'absent' || doc_id % 3, case when doc_id % 2 = 0 then 'missingword' end, case when doc_id % 5 = 0 then '77' end) as opt from w),
  p as (select *, regexp_replace(answer, '[^0-9a-z가-힣%]+', '', 'g') as have, regexp_replace(opt, '[^0-9a-z가-힣%]+', '', 'g') as want, list_filter(regexp_extract_all(opt, '[0-9a-z가-힣%]+'), lambda x: not regexp_matches(x, '^\d') and length(x) >= 2) as words,
    list_filter(list_transform(regexp_extract_all(replace(opt, ',', ''), '\d+(?:\.\d+)?'), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end), lambda x: length(x) >= 2) as numbers,
    list_transform(regexp_extract_all(replace(answer, ',', ''), '\d+(?:\.\d+)?'), lambda x: case when ltrim(x, '0') = '' then '0' else ltrim(x, '0') end) as own from o)
  select doc_id, contains(have, want) or (list_has_all(own, numbers) and case when len(words) > 0 then len(list_filter(words, lambda x: contains(have, x))) / len(words) >= 0.4 else len(numbers) > 0 end) as stated from p""")
def stated_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of words from each text with some that it lacks, and a number that few texts have."""
    k = F.col("doc_id")
    words = lambda x: F.slice(F.regexp_extract_all(x["answer"], F.lit("[0-9a-z가-힣%]+"), F.lit(0)), 1, 4)
    option = lambda w: F.concat_ws(" ", F.get(w, F.lit(3)), F.get(w, F.lit(1)), F.concat(F.lit("absent"), (k % 3).cast("string")), F.when(k % 2 == 0, "missingword"), F.when(k % 5 == 0, "77"))
    stated = lambda x: T.once(lambda y: S.states_option(y["answer"], option(y["words"])), answer=x["answer"], words=words(x))
    # dealt by key: the work is in the expressions, and the table may be read from one row group
    return table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", T.once(stated, answer=F.lower(F.coalesce("text", F.lit("")))).alias("stated"))


@query("""with c as (select conv_id, list(turn) as turns from conversations group by 1), m as (select conv_id, list_sort(list_distinct(list_transform(turns, lambda t: t - t % 2))) as turns from c)
  select conv_id, array_to_string(case when conv_id % 3 = 0 then list_sort(list_distinct(list_append(turns, 99))) else turns end, ',') as turns from m""")
def golden_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Odd turns are excluded as repeats of the even ones before them; every third case gets one more by a patch."""
    turns = table(spark, d, "conversations")
    cases = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    dups = turns.where("turn % 2 = 1").select(F.col("turn").alias("doc_id"), (F.col("turn") - 1).alias("dup_of")).distinct()
    patch = cases.where("conv_id % 3 = 0").select("conv_id", F.array(F.lit(99).cast("long")).alias("turns"), F.lit(None).cast("int").alias("n_expected"))
    out = S.overlaid(S.remapped(cases, dups, "conv_id", "turns"), patch, "conv_id", "turns")
    return out.select("conv_id", F.array_join(F.array_sort("turns"), ",").alias("turns"))
