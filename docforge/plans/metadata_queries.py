"""Queries on notice metadata: cleaning, overrides, exclusions, reports, constraints, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import analytics as A
from docforge.operators import filters as C
from docforge.operators import metadata as M
from docforge.plans.common import NOTICES_SQL, notices, table
from docforge.plans.registry import query

_CLEAN = "cleaned as (select *, (raw is null or raw <= 1) as budget_unknown, case when raw > 1 then raw end as budget, case when raw > 1 then 'csv' end as budget_source from notices)"
_N = f"with {NOTICES_SQL}, {_CLEAN}"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return M.clean_budget(notices(spark, d), "raw")


@query(f"{_N} select doc_id, budget_unknown, budget, budget_source from cleaned")
def budget_clean(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).select("doc_id", "budget_unknown", "budget", "budget_source")


@query(f"""{_N}, o as (select o_orderkey as k, max_by(o_totalprice + v, v) as confirmed from orders, (values (10), (20)) t(v) where o_orderkey % 14 = 0 group by 1)
  select doc_id, case when k is not null then confirmed else budget end as budget, case when k is not null then 'manual_confirmed' else budget_source end as budget_source,
    case when k is not null then false else budget_unknown end as budget_unknown from cleaned left join o on doc_id = k""")
def override_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 14 = 0").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice", F.explode(F.array(F.lit(10), F.lit(20))).alias("v"))
    o = o.select("doc_id", (F.col("o_totalprice") + F.col("v")).alias("confirmed"), "v")
    return M.apply_overrides(_clean(spark, d), o, "doc_id", "confirmed", "v", "budget", "budget_source", "budget_unknown").select("doc_id", "budget", "budget_source", "budget_unknown")


@query(f"{_N} select agency, count(*) as n from cleaned where doc_id not in (select l_orderkey from lineitem where l_quantity >= 50) group by agency")
def duplicate_exclusion(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("doc_id"))
    return M.exclude(_clean(spark, d), out).groupBy("agency").agg(F.count("*").alias("n"))


@query(f"""{_N} select doc_id, coalesce(start_day, published) as start_day, start_day is null as start_estimated, deadline is null as deadline_missing, deadline as deadline_clean,
  case when deadline is not null then 'csv' end as deadline_source from cleaned""")
def date_columns(spark: SparkSession, d: str) -> DataFrame:
    out = M.deadline_columns(M.impute_start(_clean(spark, d), "start_day", "published"), "deadline")
    return out.select("doc_id", "start_day", "start_estimated", "deadline_missing", "deadline_clean", "deadline_source")


@query(f"""{_N} select doc_id, case when not budget_unknown then 'resolved' else 'no_info' end as resolution, budget_unknown, deadline is null as deadline_missing, start_day is null as start_estimated, number_missing
  from cleaned where budget_unknown or deadline is null or start_day is null or number_missing""")
def issue_report(spark: SparkSession, d: str) -> DataFrame:
    out = M.issues(M.deadline_columns(M.impute_start(_clean(spark, d), "start_day", "published"), "deadline"))
    return out.select("doc_id", "resolution", "budget_unknown", "deadline_missing", "start_estimated", "number_missing")


@query(f"""{_N} select doc_id, raw as before, after from (select doc_id, raw, case when doc_id % 3 = 0 then raw when doc_id % 3 = 1 then null else raw + 1 end as after from cleaned) where raw is distinct from after""")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _clean(spark, d)
    after = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("raw")).when(F.col("doc_id") % 3 == 1, None).otherwise(F.col("raw") + 1).alias("raw"))
    return M.changed(rows, after, "doc_id", "raw")


@query("""with t as (select c_custkey as doc_id, '[' || c_mktsegment || '] ' || p_name || ' (no. ' || cast(c_custkey % 3 as varchar) || ')' as title, c_nationkey as owner from customer join part on p_partkey = c_custkey % 50),
  n as (select *, trim(regexp_replace(regexp_replace(regexp_replace(title, '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '\\s+', ' ', 'g')) as title_norm from t)
  select doc_id, title, owner, title_norm, count(*) over (partition by title_norm, owner) > 1 as is_true_duplicate from n qualify count(*) over (partition by title_norm) > 1""")
def duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "part"), F.col("p_partkey") == F.col("c_custkey") % 50)
    title = F.concat(F.lit("["), "c_mktsegment", F.lit("] "), "p_name", F.lit(" (no. "), (F.col("c_custkey") % 3).cast("string"), F.lit(")"))
    return M.duplicate_titles(rows.select(F.col("c_custkey").alias("doc_id"), title.alias("title"), F.col("c_nationkey").alias("owner")), "doc_id", "title", "owner")


@query(f"{_N} select doc_id, array_to_string(regexp_extract_all(title, '\\[([^\\[\\]]+)\\]', 1), ',') as tags, split_part(title, '] ', 2)[:-(length(cast(doc_id as varchar)) + 4)] as title_norm from cleaned")
def title_tags(spark: SparkSession, d: str) -> DataFrame:
    return notices(spark, d).select("doc_id", T.name_tags(F.col("title")).alias("tags"), T.normalized_title(F.col("title")).alias("title_norm"))


_TEXTS = ("추정가격은 비공개 입니다", "총 사업비는 1,000만원 입니다", "no amount here", "사업예산 설명. 그 뒤의 사업비 500원")


@query("""select o_orderkey as doc_id, ['undisclosed', 'candidate', 'no_info', 'candidate'][o_orderkey % 4 + 1] as source,
  [null, '사업비는 1,000만원 입니다', null, '사업예산 설명. 그 뒤의 사업비 500원'][o_orderkey % 4 + 1] as snippet from orders""")
def budget_candidates(spark: SparkSession, d: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, _TEXTS)), (F.col("o_orderkey") % 4).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), F.lit(True).alias("unknown"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("snippet"))
    return M.resolve(rows, "unknown", "source", "snippet", M.budget_candidate(F.col("text"))).select("doc_id", "source", "snippet")


_DEADLINES = ("제출 마감일은 추후 공지", "x" * 20 + "입찰 마감: 2024. 5. 31 까지", "마감 없음", "별도 공지하는 마감일시")


@query(f"""select o_orderkey as doc_id, ['announced_later', 'candidate', 'no_info', 'announced_later'][o_orderkey % 4 + 1] as source,
  [null, '{"x" * 10}입찰 마감: 2024. 5. 31 까지', null, null][o_orderkey % 4 + 1] as snippet from orders""")
def deadline_candidates(spark: SparkSession, d: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, _DEADLINES)), (F.col("o_orderkey") % 4).cast("int"))
    told = M.deadline_candidate(text)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), told.alias("t")).select("doc_id", "t.source", "t.snippet")


@query("select o_orderkey as doc_id, case when o_orderkey % 6 = 5 then null else cast(o_orderdate as date) end as day from orders")
def date_coercion(spark: SparkSession, d: str) -> DataFrame:
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    form = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyy. M. d")).when(k == 2, F.date_format(t, "yyyy년 M월 d일")).when(k == 3, F.date_format(t, "yyyyMMdd")).when(k == 4, F.date_format(t, "yyyy/MM/dd HH:mm:ss")).otherwise("soon")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), T.lenient_date(form).alias("day"))


@query("select o_orderkey as doc_id, 2::bigint as n_spans, (o_orderkey % 30 + 5)::bigint as max_gap from orders")
def date_span_gaps(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    gap = (F.col("o_orderkey") % 30).cast("int")
    text = F.concat(F.date_add(day, gap), F.lit(" ~ "), F.date_add(day, gap + 9), F.lit(" or "), F.date_sub(day, gap + 5), F.lit("~"), day.cast("string"))
    out = M.date_spans(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), day.alias("day")), "doc_id", "text", "day")
    return out.select("doc_id", F.col("n_spans").cast("long").alias("n_spans"), F.col("max_gap").cast("long").alias("max_gap"))


@query(f"{_N} select doc_id, budget, agency from cleaned where budget > 200000 and contains(lower(agency), 'on_1')")
def constraint_filter(spark: SparkSession, d: str) -> DataFrame:
    c = C.parse_constraints("예산 2억 넘는 사업", organization=" ON_1 ", unit=100_000)
    return _clean(spark, d).where(c.predicate(F.col("budget"), F.col("agency"))).select("doc_id", "budget", "agency")


@query(f"{_N} select agency, count(*) as n from cleaned where coalesce(budget >= 100000, true) group by agency")
def constraint_unknown_passes(spark: SparkSession, d: str) -> DataFrame:
    c = C.parse_constraints("1억 이상", unit=100_000)
    return _clean(spark, d).where(c.predicate(F.col("budget"), F.col("agency"), unknown_passes=True)).groupBy("agency").agg(F.count("*").alias("n"))


@query(f"{_N} select doc_id, budget from cleaned where budget >= 100000 and budget < 150000")
def amount_bounds(spark: SparkSession, d: str) -> DataFrame:
    bounds = C.amount_bounds("100천 이상 150천 미만인 사업", {"천": 1000})
    return _clean(spark, d).where(C.within_bounds(F.col("budget"), bounds)).select("doc_id", "budget")


@query(f"{_N} select doc_id, title from cleaned where lower(title) like '%machinery%' or lower(agency) like '%machinery%' order by doc_id limit 50")
def document_search(spark: SparkSession, d: str) -> DataFrame:
    return C.search(_clean(spark, d), ["title", "agency"], "Machinery", "doc_id", 50).select("doc_id", "title")


@query(f"{_N} select doc_id, agency from cleaned where doc_id in (select l_orderkey from lineitem where l_discount >= 0.1)")
def scope_restriction(spark: SparkSession, d: str) -> DataFrame:
    chosen = table(spark, d, "lineitem").where("l_discount >= 0.1").select(F.col("l_orderkey").alias("doc_id"))
    return C.in_scope(_clean(spark, d), chosen).select("doc_id", "agency")


@query("select coalesce(case when o_orderkey % 5 = 0 then 'disabled' when o_orderkey % 3 = 0 then 'csv_only' when o_orderkey % 2 = 0 then 'follow_up' end, 'kept') as reason, count(*) as n from orders group by 1")
def golden_row_selection(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    reason = C.disabled_reason(k % 5 != 0, k % 3 == 0, k % 2 == 0)
    return table(spark, d, "orders").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{_N} select agency, doc_id, budget from cleaned where budget is not null qualify rank() over (partition by agency order by budget desc) = 1")
def extreme_budget_by_agency(spark: SparkSession, d: str) -> DataFrame:
    return A.extremes(_clean(spark, d), "budget", True, ["agency"]).select("agency", "doc_id", "budget")


@query("select p_partkey, p_size from part where p_size = (select min(p_size) from part)")
def extreme_ties(spark: SparkSession, d: str) -> DataFrame:
    return A.extremes(table(spark, d, "part"), "p_size", False).select("p_partkey", "p_size")


@query(f"{_N} select doc_id, budget, abs(budget - 150000) as gap from cleaned where budget is not null and doc_id <> 1 order by gap, doc_id limit 3")
def closest_budget(spark: SparkSession, d: str) -> DataFrame:
    return A.closest(_clean(spark, d), "budget", 150000, "doc_id", 1, 3).select("doc_id", "budget", "gap")


_WINDOW = "anchor as (select case when date_diff('day', max(published), date '1998-12-01') <= 180 then date '1998-12-01' else max(published) end as a from cleaned)"


@query(f"""{_N}, {_WINDOW}, w as (select c.* from cleaned c, anchor where published between a - 60 and a)
  select doc_id, published, budget, (select count(*) from w where budget is null) as n_unknown from w where budget <= 100000""")
def recent_under_budget(spark: SparkSession, d: str) -> DataFrame:
    return A.recent_window(_clean(spark, d), "published", "budget", "doc_id", 60, 100000, "1998-12-01").select("doc_id", "published", "budget", "n_unknown")


_PERIODS = "select l_orderkey as k, l_linenumber as n, l_quantity::int as q, l_partkey as r from lineitem"


@query(f"""with l as ({_PERIODS}), p as (select k, min_by(case when n % 2 = 0 then q * 30 else q end, n * 100000000 + r) as days from l where q > 10 group by k)
  select k as doc_id, days::bigint as days from p where days <= 90""")
def short_periods(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = F.when(q > 10, F.concat(F.lit("용역 기간: 계약체결일로부터 "), q.cast("string"), F.when(n % 2 == 0, "개월").otherwise("일"))).otherwise("용역 기간: 계약일로부터 0일")
    days = A.period_days(table(spark, d, "lineitem").select("l_orderkey", (n.cast("long") * 100000000 + F.col("l_partkey")).alias("place"), text.alias("text")), "l_orderkey", "place", "text")
    return A.short_periods(days).select(F.col("l_orderkey").alias("doc_id"), F.col("days").cast("long").alias("days"))


@query(f"""{_N}, l as ({_PERIODS}), p as (select k, min(q) as days from l group by k)
  select doc_id, days::bigint as days, budget from cleaned join p on k = doc_id where days <= 30 and budget <= 120000""")
def period_and_budget(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min(F.col("l_quantity").cast("int")).cast("long").alias("days"))
    return A.period_and_budget(_clean(spark, d).join(days, "doc_id"), "days", "budget", "doc_id", 30, 120000).select("doc_id", "days", "budget")


@query(f"""{_N} select l_orderkey as doc_id, l_linenumber::bigint as nth, l_partkey from lineitem where l_orderkey in (select doc_id from cleaned where budget > 400000)
  qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) <= 3""")
def filtered_first_chunks(spark: SparkSession, d: str) -> DataFrame:
    from docforge.operators.retrieval import first_per_group

    own = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("nth"), "l_partkey")
    return first_per_group(C.in_scope(own, _clean(spark, d).where("budget > 400000")), ["doc_id"], ["nth", "l_partkey"], 3)


@query("select o_orderkey as doc_id, round((o_orderkey % 50 + 1) * ([100000000, 10000, 1])[o_orderkey % 3 + 1], 6)::double as amount from orders")
def amount_parsing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("약 "), (k % 50 + 1).cast("string"), F.when(k % 3 == 0, "억").when(k % 3 == 1, "만").otherwise(""), F.lit("원"))
    return table(spark, d, "orders").select(k.alias("doc_id"), T.amount(text).cast("double").alias("amount"))
