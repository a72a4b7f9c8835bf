"""Questions, contexts, archives, triage."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from docforge.operators import candidates, contexts, evaluation
from docforge.plans import questions as Q
from docforge.sources import archives


@pytest.mark.parametrize(
    "text,kind",
    [
        ("예산 차이가 가장 작은 사업은?", "closest"), ("예산이 가장 큰 사업은?", "extreme_budget"), ("기간이 가장 짧은 사업", "extreme_period"),
        ("최근 3개월 5억 이하 사업", "recent"), ("60일 이내 사업", "short_period"), ("전부 몇 건인가", "count"), ("3억 이상 사업", "listing"), ("제출 서류는?", "retrieval"),
    ],
)
def test_routes(text, kind):
    assert Q.route(text).kind == kind


def test_answers(session):
    day = datetime.date(2024, 5, 1)
    rows = [(1, "정보 시스템", 5e8, 30, day, "서울시"), (2, "정보 구축", 5e8, 90, day, "연구원"), (3, "교육", 1e8, 30, day - datetime.timedelta(100), "부산시"), (4, "무", None, None, day, "x")]
    df = session.createDataFrame(rows, "doc_id int, title string, budget double, days int, published date, agency string")
    ids = lambda q, **k: [r.doc_id for r in Q.answer(q, df, "2024-05-10", **k).collect()]
    assert sorted(ids("예산이 가장 큰 사업은?")) == [1, 2]
    assert ids("'구축'이 포함된 사업 중 예산이 가장 큰 것") == [2]
    assert sorted(ids("기간이 가장 짧은 사업")) == [1, 3]
    assert ids("예산 차이가 가장 작은 사업은?", reference=1) == [2]
    assert sorted(ids("최근 3개월 5억 이하 사업")) == [1, 2]
    assert ids("30일 이내 사업") == [3, 1]
    assert ids("3억 이상 지자체 사업") == [1]
    assert Q.answer("전부 몇 건인가", df, "2024-05-10").first().n == 4
    assert Q.answer("제출 서류는?", df, "2024-05-10") is None


def test_hints_and_chunks(session):
    catalogue = session.createDataFrame([("a", "한국연구재단", "ERP 구축"), ("b", "한국연구재단", "ISP 수립"), ("c", "서울특별시청", "도로 정비")], "doc_id string, owner string, title string")
    qs = session.createDataFrame([(1, "한국연구재단 ERP 구축 예산은?"), (2, "한국연구재단과 서울특별시청 사업 비교"), (3, "아무 말")], "query_id int, text string")
    best = contexts.best_hints(contexts.hint_scores(qs, catalogue), catalogue)
    got = {(r.query_id, r.doc_id) for r in best.collect()}
    assert (1, "a") in got and (1, "b") not in got and {(2, "a"), (2, "c")} <= got and not any(q == 3 for q, _ in got)
    chunks = session.createDataFrame([(d, f"{d}{i}", i, f"text {i} {'budget' if i == 30 else ''}") for d in "abc" for i in range(40)], "doc_id string, chunk_id string, nth int, text string")
    words = session.createDataFrame([(1, ["Budget"])], "query_id int, words array<string>")
    out = contexts.routed_chunks(best.select("query_id", "doc_id"), chunks, words)
    n = {q: sorted(r.nth for r in out.where(F.col("query_id") == q).collect()) for q in (1, 2)}
    assert n[1] == [*range(10), 30] and n[2] == sorted([*range(8)] * 2)


def test_visual_evidence_and_anchors(session):
    qs = session.createDataFrame([(1, "red blue table")], "query_id int, text string")
    seen = session.createDataFrame([(1, "d")], "query_id int, doc_id string")
    ev = session.createDataFrame([("d", "e1", "red", None), ("d", "e2", "red blue", None), ("d", "e3", "table", "x"), ("d", "e4", "none", None), ("d", "e5", "table", None)], "doc_id string, evidence_id string, evidence_text string, error string")
    assert [r.evidence_id for r in contexts.visual_evidence(qs, seen, ev).orderBy(F.desc("overlap"), "evidence_id").collect()] == ["e2", "e1"]
    body = "the quick brown fox jumps over the lazy dog and runs far away"
    chunks = session.createDataFrame([("d", "p", None, "parent", 0, "P " + body), ("d", "c", "p", "child", 1, body), ("e", "x", None, "recursive", 0, "else")], "doc_id string, chunk_id string, parent_chunk_id string, strategy string, nth int, text string")
    cands = session.createDataFrame([("d", 0, body[4:50]), ("e", 0, "not to be found here")], "doc_id string, nth int, text string")
    got = {r.doc_id: (r.context, r.from_chunks) for r in contexts.candidate_contexts(cands, chunks).collect()}
    assert got == {"d": ("P " + body, True), "e": ("not to be found here", False)}
    df = session.createDataFrame([("aa  bb\ncc dd", "bb cc"), ("aa", "zz")], "d string, c string")
    assert [r.x for r in df.select(contexts.excerpt(F.col("d"), F.col("c"), 40).alias("x")).collect()] == ["aa bb cc dd", "zz"]


def test_candidates(session):
    """Spans as a plain reading of the rules gives them, on texts with one, several and no matches."""
    text = "제안서 작성 규격은 다음과 같다. A4 용지 30쪽 이내로 한다.\n" + "가 " * 300 + "계약보증금은 계약금액의 10/100 이상으로 한다.\n"
    forms = "앞 글\n[별지 서식 제1호] 입찰 신청서\n[별지  서식 제1호] 다시\n【붙임 2】 서약서  그리고"
    phones = "x" * 30 + "\n담당 부서: 과\n" + "y " * 40 + "TEL: 02-123-4567 끝. 다음 글 TEL: 02-999-9999 바로 뒤"
    contents = "사업 목적 - 1\n개요 - 2\n배경 - 3\n" + "z " * 200 + "\n사업 목적\n우리는 한다.\n그리고 더"
    docs = session.createDataFrame([("a", text, " sum "), ("b", forms, None), ("c", phones, ""), ("d", contents, None), ("e", None, "only"), ("f", "", None)], "doc_id string, text string, summary string")
    got = {}
    for r in candidates.extract(docs, summary="summary").collect():
        got.setdefault((r.doc_id, r.question), []).append((r.start, r.method, r.text, r.end))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    spec = sorted(got["a", "specification"])
    assert [m for _, m, *_ in spec] == ["heading", "paper_size"] and spec[0][0] == 0
    assert len(got["a", "bond"]) == 1 and got["a", "bond"][0][2].startswith("계약보증금") and got["a", "bond"][0][3] == len(text)
    assert got["a", "purpose"] == [(-1, "metadata", "sum", -1)] == [(*x[:2], "sum", -1) for x in got["e", "purpose"]]
    assert sorted(x[1:3] for x in got["b", "form_list"]) == [("[별지 서식 제1호]", "앞 글 | 입찰 신청서"), ("【붙임 2】", got_before(forms, "【") + " | 서약서")]
    assert [m for _, m, *_ in got["c", "contact"]] == ["phone"], "the second number is too near, headings are a way out only"
    start, _, passage, end = got["c", "contact"][0]
    assert passage == phones[start:end].strip() + "…" and "TEL: 02-123-4567 끝." in passage  # cut behind a word
    assert len(got["d", "purpose"]) == 1 and got["d", "purpose"][0][2].startswith("사업 목적\n우리는")
    assert not [k for k in got if k[0] == "f"]
    for (doc, _), rows in got.items():
        for start, method, passage, end in rows:
            if start >= 0 and not method.startswith(("[", "【")):
                assert passage.rstrip("…") == texts[doc][start:end].strip()
    wide = candidates.widened(session.createDataFrame([(text, 5, 10)], "text string, start int, end int"), F.lit(10)).first()
    assert wide.at_start and not wide.at_end and wide.end - wide.start >= 90 and wide.passage.startswith("제안서")


def got_before(text, mark):
    at = text.index(mark)
    return text[max(0, at - 40) : at].replace("\n", " ").strip()


def test_archives(session, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("x/Report one.pdf", "Plan long name.hwp", "dup a.txt", "dup b.txt"):
            z.writestr(name, b"1")
    index = archives.members(session, str(tmp_path / "*.zip"))
    wanted = session.createDataFrame([("report  ONE.pdf",), ("Plan long",), ("dup",), ("none",)], "source string")
    assert {r.source: r.member for r in archives.find_members(wanted, index).collect()} == {"report  ONE.pdf": "x/Report one.pdf", "Plan long": "Plan long name.hwp"}
    old = session.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, archives.patch_rows(old, session.createDataFrame([(2, "c")], "k int, v string"), "k").collect())) == [(1, "a"), (2, "c")]


def test_triage_and_progress(session):
    labels = session.createDataFrame([("doc one.pdf",), ("twin.pdf",), ("doc on.pdf",), ("zzz",)], "label string")
    corpus = session.createDataFrame([("doc one.pdf",), ("main.pdf",)], "doc_id string")
    twins = session.createDataFrame([("twin.pdf", "main.pdf")], "doc_id string, dup_of string")
    assert {r.label: (r.found, r.how) for r in evaluation.triage(labels, corpus, twins).collect()} == {"doc one.pdf": ("doc one.pdf", "exact"), "twin.pdf": ("main.pdf", "duplicate"), "doc on.pdf": ("doc one.pdf", "fuzzy"), "zzz": (None, "unresolved")}
    golden = session.createDataFrame([("easy",), ("easy",)], "level string")
    targets = session.createDataFrame([("easy", 3), ("hard", 2)], "level string, target int")
    assert sorted((r.level, r.n, r.missing) for r in evaluation.progress(golden, targets, "level").collect()) == [("easy", 2, 1), ("hard", 0, 2)]


def test_all_routes(session):
    chunks = session.createDataFrame([(d, f"{d}{i:02}", i, f"text {i} {'word' if i % 3 == 1 else ''}") for d in "abc" for i in range(40)], "doc_id string, chunk_id string, nth int, text string")
    catalogue = session.createDataFrame([("a", "the word office"), ("b", None), ("c", "other")], "doc_id string, owner string")
    asked = [(1, ["word"], True), (2, ["word"], False), (3, ["absent"], False), (4, ["word"], False), (5, None, False), (6, [], False), (7, None, None), (8, ["absent"], False)]
    q = session.createDataFrame(asked, "query_id int, words array<string>, aggregates boolean")
    hints = session.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "b", 0), (3, "a", 0), (4, "a", 0), (4, "c", 1), (5, "c", 0), (8, "b", 0), (8, "c", 1)], "query_id int, doc_id string, nth int")
    fits = session.createDataFrame([(6, "a"), (6, "c"), (1, "c")], "query_id int, doc_id string")
    searched = session.createDataFrame([(k, "c", "c07", 1) for k in range(1, 9)] + [(7, "a", "a01", 2)], "query_id int, doc_id string, chunk_id string, rank int")
    got = {}
    for r in contexts.assembled(q, hints, chunks, catalogue, fits, searched).orderBy("query_id", "place").collect():
        got.setdefault((r.query_id, r.route), []).append(r.chunk_id)
    name = lambda d, xs: [f"{d}{i:02}" for i in xs]
    hit = [i for i in range(40) if i % 3 == 1]
    assert got == {
        (1, "all"): name("a", range(40)), (2, "words"): name("b", hit) + name("b", [i for i in range(10) if i % 3 != 1]), (3, "search"): ["c07"], (4, "several"): name("a", hit[:8]) + name("c", hit[:8]),
        (5, "document"): name("c", range(15)), (6, "conditions"): name("a", range(3)) + name("c", range(3)), (7, "search"): ["c07", "a01"], (8, "several"): name("b", range(8)) + name("c", range(8)),
    }


def test_candidates_are_worked_out_once(session):
    """A pattern stands in the plan as often as a text is read for it: to see whether it has a match, and for gaps and matches."""
    docs = session.createDataFrame([("a", "담당 부서: TEL: 02-123-4567"), ("b", "none"), ("c", None)], "doc_id string, text string")
    found = candidates.extract(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (candidates.PHONE, candidates.FORM_HEADER, candidates.CONTACT_HEADING, candidates.QUESTIONS["purpose"][0]):
        assert plan.count(pattern) == 3, pattern
    assert [(r.doc_id, r.question, r.method) for r in found.collect()] == [("a", "contact", "phone")]


def test_no_text_no_candidates(session):
    spans = session.createDataFrame([(None,), ("",), ("x",)], "t string").select(candidates.places(F.col("t"), "x").alias("v")).collect()
    assert [r.v if r.v is None else [tuple(x) for x in r.v] for r in spans] == [None, [], [(0, 1)]]


def test_literals_of_patterns(session):
    """Every branch of a pattern has one of its literals; a match is found with them as without."""
    said = ["계약 체결 방법", "계약방법", "계약 방식", "낙찰자 결정 방법", "낙찰 방법", "하도급", "공동수급", "공동이행", "분담이행", "컨소시엄", "입찰 참가 자격", "참가자격", "지역 제한", "참가 제한", "평가 배점", "배점표", "평가 항목 및 배점", "기술 평가와 그 배점",
            "정성적 평가", "사업 목적", "사업개요", "과업 개요", "추진 배경", "[별지 서식 제1호]", "[별지 제1호]", "【별첨 2】", "[붙임 3]", "TEL: 02-123-4567", "Tel 02-123-4567", "전화 02-123-4567", "FAX:02-123-4567", "Fax 02-123-4567", "팩스 02-123-4567", "담당 부서", "문의처",
            "문의 사항", "연락처", "제안서 작성 규격", "제안서 작성요령", "제안서의 규격", "제출 규격", "제안서 규격", "제안서 제출 형식", "A4 30매", "계약보증금 10%", "10분의 1 100분의 5 입찰보증금", "3/100 하자보수보증금", "5％ 하자보증금", "보증금율 7 프로", "보증금률 1 퍼센트"]
    df = session.createDataFrame([(t,) for t in said], "t string")
    patterns = list(candidates.NEEDS)
    for r in df.select("t", *[F.col("t").rlike(p).alias(f"m{i}") for i, p in enumerate(patterns)], *[F.size(candidates.places(F.col("t"), p)).alias(f"n{i}") for i, p in enumerate(patterns)]).collect():
        assert [r[f"m{i}"] for i in range(len(patterns))] == [r[f"n{i}"] > 0 for i in range(len(patterns))], r.t
