"""Queries on documents and their parses: conditions, schedules, missing values, pages, merged texts, vectors, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import contexts as X
from docforge.operators import diagnostics as D
from docforge.operators import filters as C
from docforge.operators import generation as G
from docforge.operators import metadata as M
from docforge.operators import retrieval as R
from docforge.plans.common import NOTICES_SQL, notices, shared_folder, table
from docforge.plans.registry import query
from docforge.plans.text_queries import _bars
from docforge.sources import merged, parsing, vectors

_CLEAN = "cleaned as (select *, (raw is null or raw <= 1) as budget_unknown, case when raw > 1 then raw end as budget, case when raw > 1 then 'csv' end as budget_source from notices)"
_N = f"with {NOTICES_SQL}, {_CLEAN}"


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return M.clean_budget(notices(spark, d), "raw")


def _chosen(by: str, values: tuple[str, ...]):
    """One of some strings by a key's remainder."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


_OWNERS, _NAMES = ("서울시", "철도공사", "한국대학교", "대학협의회", "울릉군 ", ""), (" 긴급", " 보안 공고", " 재난", "")
_OWNER_SQL = f"agency || {list(_OWNERS)}[doc_id % {len(_OWNERS)} + 1]"
_NAME_SQL = f"title || {list(_NAMES)}[doc_id % {len(_NAMES)} + 1]"


@query(rf"""{_N}, n as (select doc_id, budget, {_OWNER_SQL} as owner, {_NAME_SQL} as name from cleaned)
  select 1 as question, doc_id from n where budget >= 200000 and regexp_matches(trim(owner), '(광역시|특별시|특별자치도|특별자치시|[가-힣]+도|[가-힣]+시|[가-힣]+군|[가-힣]+구)$')
  union all select 2, doc_id from n where contains(owner, '공사') and contains(name, '긴급')
  union all select 3, doc_id from n where regexp_matches(owner, '대학교|대학|과학기술원') and not regexp_matches(owner, '협의회|협회') and contains(name, '보안')""")
def topic_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _clean(spark, d).select("doc_id", "budget", F.concat("agency", _chosen("doc_id", _OWNERS)).alias("owner"), F.concat("title", _chosen("doc_id", _NAMES)).alias("name"))
    asked = ("2억 이상인 지자체 사업", "발주기관이 OO공사인 긴급 사업", "대학교에서 낸 보안 및 AI 사업")
    found = [rows.where(C.topics_of(q, 100_000).predicate(F.col("budget"), F.col("owner"), F.col("name"))).select(F.lit(i + 1).alias("question"), "doc_id") for i, q in enumerate(asked)]
    return reduce(DataFrame.union, found)


@query("select doc_id as question_id, doc_id % 4 in (0, 2) as told from documents")
def where_stated(spark: SparkSession, d: str) -> DataFrame:
    asked = F.concat(F.substring("text", 1, 40), _chosen("doc_id", (" 예산이 명시되어 있나요?", " 예산은 얼마인가요?", " 마감일이 표기되어 있나요", "")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), C.asks_where_stated(asked).alias("told"))


_STATES = "case when doc_id % 2 = 0 then 'candidate' when doc_id % 3 = 0 then 'no_info' end"


@query(rf"""{_N}, s as (select *, {_STATES} as state, repeat('about ' || title || ' ', 4) as told from cleaned)
  select doc_id, md5('  발주 기관: ' || agency || chr(10) || '  예산: ' || case when budget is not null then format('{{:,}}', round_even(budget, 0)::bigint) || '원' when state = 'candidate' then '확정 안 됨(후보 문구만 있음) - "' || left(told, 80) || '"' else '정보 없음(상태=' || coalesce(state, 'None') || ')' end
    || chr(10) || '  참여 시작일: ' || coalesce(start_day, published)::varchar || case when start_day is null then '(추정값 - 공개일자로 대체)' else '' end
    || chr(10) || '  참여 마감일: ' || case when deadline is not null then deadline::varchar when state = 'candidate' then '확정 안 됨(후보 문구만 있음) - "' || left(told, 80) || '"' else '정보 없음(상태=' || coalesce(state, 'None') || ')' end) as digest from s""")
def schedule_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = M.impute_start(_clean(spark, d).withColumnRenamed("start_day", "start"), "start", "published")
    state, told = F.expr(_STATES), F.repeat(F.concat(F.lit("about "), "title", F.lit(" ")), 4)
    rows = rows.withColumn("budget_source", F.when(F.col("budget_unknown"), state).otherwise(F.col("budget_source"))).withColumn("budget_snippet", told)
    rows = rows.withColumn("deadline_clean", F.col("deadline")).withColumn("deadline_source", state).withColumn("deadline_snippet", told)
    return rows.select("doc_id", F.md5(F.concat_ws("\n", M.issuer_text(F.col("agency")), M.schedule_text(rows))).alias("digest"))


#: Texts of notices by key, and what the SQL says of each.
_TEXTS = ("본 사업의 사업예산 : 500,000원 이내", "사업비는 비공개로 한다", "접수기간 2024.01.02 ~ 마감일 2024-02-03", "마감일은 추후 공지", "내용 없음")
_FOUND_BUDGET = "['candidate', 'undisclosed', 'no_info', 'no_info', 'no_info'][doc_id % 5 + 1]"
_FOUND_DEADLINE = "['no_info', 'no_info', 'candidate', 'announced_later', 'no_info'][doc_id % 5 + 1]"


@query(rf"""{_N}, m as (select *, doc_id % 13 <> 0 as held, case when doc_id % 17 = 0 then 5.0 else budget end as now, {_FOUND_BUDGET} as b, {_FOUND_DEADLINE} as e from cleaned)
  select doc_id, '예산' as category, case when held then b end as classification, case when not held then 'N/A' when now is not null then '확정값과 스니펫이 일치하는지 확인' when b = 'no_info' then '값 없음 - 원본 직접 확인 필요' else 'candidate 스니펫 확인 후 확정값 기입' end as action from m where budget_unknown
  union all select doc_id, '마감일', case when held then e end, case when not held then 'N/A' when e = 'no_info' then '본문에 마감일 언급 없음' when e = 'announced_later' then '조치 불필요' else 'candidate 스니펫 확인 후 확정값 기입' end from m where deadline is null
  union all select doc_id, '시작일', '재검토 필요', '본문의 날짜가 맞는지 확인' from m where held and start_day is null and doc_id % 5 = 2
  union all select doc_id, '공고번호', null, '조치 불필요' from m where number_missing""")
def missing_value_report(spark: SparkSession, d: str) -> DataFrame:
    rows = M.impute_start(_clean(spark, d).withColumnRenamed("start_day", "start"), "start", "published")
    held = rows.where("doc_id % 13 <> 0").select("doc_id", F.lit("raw_parsed").alias("source"), _chosen("doc_id", _TEXTS).alias("text"), F.when(F.col("doc_id") % 17 == 0, 5.0).otherwise(F.col("budget")).alias("budget"), F.col("deadline").alias("deadline_clean"), "start", "start_estimated")
    return D.missing_values(rows, held).select("doc_id", "category", "classification", "action")


@query("select doc_id, 2::bigint as n_spans, (doc_id % 30 + 5)::bigint as max_gap, row_number() over (order by doc_id % 30 desc, doc_id) as place from (select o_orderkey as doc_id from orders) order by place limit 100")
def widest_gaps(spark: SparkSession, d: str) -> DataFrame:
    day, gap = F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 30).cast("int")
    text = F.concat(F.date_add(day, gap), F.lit(" ~ "), F.date_add(day, gap + 9), F.lit(" or "), F.date_sub(day, gap + 5), F.lit("~"), day.cast("string"))
    spans = M.date_spans(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"), day.alias("day")), "doc_id", "text", "day")
    first = M.widest_first(spans, "doc_id").limit(100)  # a report of the first hundred
    return first.select("doc_id", F.col("n_spans").cast("long").alias("n_spans"), F.col("max_gap").cast("long").alias("max_gap"), F.expr("row_number() over (order by max_gap desc, doc_id)").cast("long").alias("place"))


_BARS_SQL = """r as (select doc_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | ')), lambda line: string_split(line, ' | ')) as lines from documents)"""


@query(rf"""with {_BARS_SQL},
  c as (select doc_id, list_filter(list_transform(flatten(lines), lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: x <> '') as cells, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not contains(x, ' | ')), chr(10)), '\s+', '', 'g') as body from r where len(lines) > 0),
  s as (select len(list_filter(cells, lambda x: contains(body, x))) / len(cells) as ratio from c where len(cells) > 0)
  select case when ratio >= 0.9 then 'full' when ratio > 0 then 'partial' else 'unique' end as state, count(*) as n from s group by 1""")
def table_repeat_states(spark: SparkSession, d: str) -> DataFrame:
    body = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.contains(x, F.lit(" | "))), "\n")
    return D.repeat_states(_bars(spark, d).withColumn("body", body)).groupBy("state").agg(F.count("*").alias("n"))


@query(f"""with {_BARS_SQL} select len(lines)::int as n_rows, list_max(list_transform(lines, lambda x: len(x)))::int as n_columns, count(*) as n from r where len(lines) > 0 group by all order by n desc, n_rows, n_columns limit 15""")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    return D.shapes(_bars(spark, d))


@query("""with t as (select doc_id, doc_id % 7 + 1 as plain, length(text) % 3 as inner_, length(text) % 2 as foot from documents),
  c as (select doc_id, plain + inner_ + foot as n_tables, inner_ as n_nested, foot as n_outside, plain + case doc_id % 3 when 0 then 0 when 1 then foot else inner_ end as n_marks from t)
  select doc_id, n_tables::int as n_tables, n_nested::int as n_nested, n_outside::int as n_outside, n_marks::int as n_marks, case when n_tables = n_marks then 'none' when n_tables - n_nested = n_marks then 'nested' when n_tables - n_outside = n_marks then 'outside' else 'unknown' end as difference from c""")
def placeholder_differences(spark: SparkSession, d: str) -> DataFrame:
    plain, inner, foot = F.col("doc_id") % 7 + 1, F.length("text") % 3, F.length("text") % 2
    mine = lambda n, x: F.repeat(F.lit(x), n.cast("int"))
    nested = F.concat(F.lit('<Table class="a"><tr><td>'), mine(inner, "<table><tr><td>x</td></tr></table>"), F.lit("</td></tr></Table>"))
    markup = F.concat(F.lit("<body><br/>"), nested, mine(plain - 1, "<table><tr><td/></tr></table>"), F.lit("<div.PageFooter id='1'>"), mine(foot, "<table></table>"), F.lit("</div.PageFooter></body>"))
    marks = plain + F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, foot).otherwise(inner)
    docs = table(spark, d, "documents").select("doc_id", markup.alias("markup"), F.concat(F.lit("a\n"), mine(marks, "<표>\n"), F.lit("b <표>")).alias("text"))
    return D.placeholder_report(docs).select("doc_id", "n_tables", "n_nested", "n_outside", "n_marks", "difference")


@query(r"""with p as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) as pages from documents where text is not null),
  o as (select doc_id, pages, list_transform(pages, lambda x, i: case when length(x) < 20 and doc_id % 2 = 0 then case when i % 3 = 0 then '' else 'read ' || i::varchar end else x end) as texts from p)
  select doc_id, md5(array_to_string(texts, chr(10) || chr(10))) as digest, len(pages)::int as n_pages, len(list_filter(pages, lambda x: length(x) < 20))::int as n_scanned,
    doc_id % 2 = 0 and len(list_filter(list_transform(pages, lambda x, i: length(x) < 20 and i % 3 <> 0), lambda x: x)) > 0 as used_ocr from o""")
def page_rules(spark: SparkSession, d: str) -> DataFrame:
    """Lines as pages; what is recognised of every third one failed."""
    pages = F.split("text", "\n")
    read = F.transform(pages, lambda p, i: F.when((i + 1) % 3 != 0, F.concat(F.lit(" read "), (i + 1).cast("string"))))
    told = parsing.page_texts(pages, F.when(F.col("doc_id") % 2 == 0, read))
    return table(spark, d, "documents").where("text is not null").select("doc_id", told.alias("p")).select("doc_id", F.md5("p.text").alias("digest"), "p.n_pages", "p.n_scanned", "p.used_ocr")


@query(r"""select doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' and (length(x) % 10) / 10 >= 0.5), chr(10))) as digest from documents where text is not null""")
def recognised_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    scores = F.transform(lines, lambda x: (F.length(x) % 10) / F.lit(10))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(parsing.recognised_lines(lines, scores)).alias("digest"))


@query("""select doc_id % 3 = 0 and doc_id % 2 = 0 as failed, case when doc_id % 3 = 0 and doc_id % 2 = 0 then null when doc_id % 7 = 6 then '표 추출 비활성화' when doc_id % 5 = 4 then '표 추출 실패: timeout' when doc_id % 5 = 0 then '표 추출 시도함 - 표를 찾지 못함' else '표 ' || (doc_id % 5)::varchar || '개 추출 성공' end as note, count(*) as n from documents group by all""")
def parse_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    told = parsing.parse_outcome(F.when(k % 2 == 1, F.col("text")).otherwise(""), F.when(k % 3 == 0, "broken"), F.when(k % 5 != 4, (k % 5).cast("int")).otherwise(0), F.when(k % 5 == 4, "timeout"), k % 7 != 6, F.lit(None).cast("string"))
    return table(spark, d, "documents").select(told.alias("p")).groupBy(F.col("p.error").isNotNull().alias("failed"), F.col("p.table_note").alias("note")).agg(F.count("*").alias("n"))


@query(rf"""{_N} select coalesce(case when budget_unknown then {_FOUND_BUDGET} else 'csv' end, '') as budget_source, coalesce(case when deadline is null then {_FOUND_DEADLINE} else 'csv' end, '') as deadline_source, count(*) as n,
    sum(length(['본 사업의 사업예산 : 500,000원 이내', '사업비는 비공개로 한다', '접수기간 2024.01.02 ~ 마감일 2024-02-03', '마감일은 추후 공지', '내용 없음'][doc_id % 5 + 1]))::bigint as characters
  from cleaned where doc_id % 13 <> 0 and doc_id % 19 <> 0 group by all""")
def reloaded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Merged, written, and read again: placeholders go, open values are looked for anew, excluded documents go."""
    none = F.lit(None).cast("string")
    rows = M.deadline_columns(_clean(spark, d), "deadline").withColumn("budget_snippet", none).withColumn("deadline_snippet", none)
    parsed = rows.where("doc_id % 13 <> 0").select("doc_id", F.concat(F.lit("<그림>\n"), _chosen("doc_id", _TEXTS), F.lit("\n<표>")).alias("text"), F.lit(True).alias("raw"))
    path = shared_folder(spark, "merged")
    merged.merge_all(rows, parsed).write.parquet(path)
    found = merged.reload(spark, path, rows.where("doc_id % 19 = 0").select("doc_id"))
    return found.groupBy("budget_source", "deadline_source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


@query("select doc_id, length(text)::int as n, (length(text) - length(replace(text, 'e', '')))::int as n_e from documents")
def keyed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Made once, found the second time."""
    root = shared_folder(spark, "vectors")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    embed = lambda t: F.array(F.length(t), F.regexp_count(t, F.lit("e")))
    vectors.stored_vectors(docs, root, "letters/1", embed)
    rows = vectors.stored_vectors(docs, root, "letters/1", lambda t: F.raise_error(F.lit("embedded twice")).cast("array<int>"))
    return rows.select("doc_id", F.get("vector", F.lit(0)).alias("n"), F.get("vector", F.lit(1)).alias("n_e"))


@query("""with c as (select o_custkey as query_id, o_orderkey as candidate_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos from orders),
  s as (select *, row_number() over (partition by query_id order by pos) - 1 as nth, count(*) over (partition by query_id) > 3 as again from c where pos % 2 = 0),
  f as (select query_id, candidate_id, nth from s where not again union all select query_id, candidate_id, nth from (select query_id, candidate_id, row_number() over (partition by query_id order by pos desc) - 1 as nth from s where again) where nth < 3)
  select query_id, md5(string_agg('[doc ' || query_id::varchar || ' / page=' || case when candidate_id % 2 = 0 then 'unknown' else candidate_id::varchar end || ' / ' || candidate_id::varchar || '] seen', chr(10) order by nth) filter (where candidate_id % 5 <> 0)) as digest, count(*) filter (where candidate_id % 5 <> 0) = 0 as none from f group by query_id""")
def visual_selection(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in batches of four, every second one picked; above three the last picks win the final round."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("candidate_id"))
    batched = R.batches(rows, ["query_id"], [F.col("candidate_id")], 4)
    placed = batched.withColumn("at", F.expr("row_number() over (partition by query_id order by candidate_id)").cast("int") - 1)
    picks = placed.where("at % 2 = 0").select("query_id", "batch", "at", "candidate_id")
    strange = picks.withColumn("candidate_id", -F.col("candidate_id"))
    chosen = X.selected_candidates(rows, picks.union(strange).union(picks.withColumn("batch", F.col("batch") + 100)))
    final = picks.select("query_id", F.expr("row_number() over (partition by query_id order by at desc)").cast("int").alias("at"), "candidate_id").withColumn("at", F.col("at") - 1)
    read = X.finalists(chosen, final, rows).select("query_id", "nth", F.concat(F.lit("doc "), F.col("query_id").cast("string")).alias("doc_id"), F.when(F.col("candidate_id") % 2 != 0, F.col("candidate_id")).alias("page"), F.col("candidate_id").cast("string").alias("candidate_id"), F.when(F.col("candidate_id") % 5 != 0, " seen ").alias("evidence"))
    return X.visual_texts(read).select("query_id", F.when(F.col("error").isNull(), F.md5("evidence_text")).alias("digest"), F.col("error").isNotNull().alias("none"))


@query("select item_id::varchar as query_id, case when length(text) % 3 > 0 then 'A ' || length(text)::varchar end as answer, length(text) % 3 = 0 as failed from benchmark")
def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    """The offline generator; prompts of some lengths make a generator fail."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.concat("text", F.lit("\n"), F.when(F.length("text") % 3 == 0, "fail").otherwise(F.concat(F.lit("A "), F.length("text").cast("string"))), F.lit("\n \n")).alias("prompt"))

    def careful(prompt: str) -> str:
        told = G.last_line(prompt)
        if told == "fail":
            raise ValueError("no answer")
        return told

    return G.generated(rows, careful).select("query_id", "answer", F.col("execution_error").isNotNull().alias("failed"))


@query(rf"""{_N} select doc_id, md5('data:text/plain;base64,' || base64(encode(title))) as url, regexp_replace(left(regexp_replace(regexp_replace(title, '[^0-9a-zA-Z가-힣_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), '^$', 'document') || '-' || left(sha256('a/b.c/' || title || '.hwp'), 10) as slug,
    case doc_id % 3 when 0 then '사업' when 1 then '사업 일' else '은' end as bare, case doc_id % 3 when 0 then 'x' when 1 then 'y' end as value from cleaned""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    ended = _chosen("doc_id", ("사업에서는", "사업 일은", "은"))
    held = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("n"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("b"), F.lit("y"))).otherwise(F.create_map(F.lit("c"), F.lit("z")))
    return notices(spark, d).select(
        "doc_id", F.md5(T.data_url(F.encode("title", "UTF-8"), "text/plain")).alias("url"), T.slug(F.concat(F.lit("a/b.c/"), "title", F.lit(".hwp"))).alias("slug"),
        T.without_ending(ended, ("은", "는", "에서는")).alias("bare"), T.first_of(held, ["a", "b"]).alias("value"),
    )
