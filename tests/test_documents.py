"""Rules on parses, merged documents, vectors and reports that the SQL checks do not reach."""

import pytest
from pyspark.sql import functions as F

from docforge.operators import diagnostics, filters, generation
from docforge.sources import merged, parsing, vectors


def test_topics(session):
    assert filters.topics_of("모든 사업").predicate(F.lit(1), F.lit("a"), F.lit("b")) is None
    assert filters.topics_of("AI 사업") == filters.Topics(ai=True)
    assert filters.topics_of("3억 이상 공사") == filters.Topics(minimum=300_000_000)  # the word alone asks for no owner
    assert filters.topics_of("대학 긴급 재난") == filters.Topics(owners=("school",), words=("긴급", "재난"))


def test_topics_of_null_values(session):
    rows = session.createDataFrame([(1, None, None, None), (2, 3e8, "서울시", "긴급")], "id int, budget double, owner string, name string")
    t = filters.topics_of("지자체 긴급 3억 이상")
    kept = rows.where(t.predicate(F.col("budget"), F.col("owner"), F.col("name"))).collect()
    assert [r["id"] for r in kept] == [2]
    assert rows.where(~filters.topics_of("긴급").predicate(F.col("budget"), F.col("owner"), F.col("name"))).count() == 1  # false, not null


def test_contexts_are_cut_around_keywords(session):
    text = "x" * 30 + "\n시작일" + "y" * 300 + "접수기간"
    got = session.createDataFrame([(text,), ("",)], "t string").select(diagnostics.contexts(F.col("t"), ("접수기간", "시작일")).alias("c")).collect()
    assert got[0]["c"] == [("시작일" + "y" * 300 + "접수기간")[-24:], "x" * 19 + " 시작일" + "y" * 197]
    assert got[1]["c"] == []


def test_outcomes_and_missing_files(session):
    rows = session.createDataFrame([("kept", "broken", 2, None, True, "slow"), ("", "broken", 2, None, True, None), (None, None, 0, None, False, None)], "t string, e string, n int, te string, asked boolean, b string")
    got = [tuple(r["p"]) for r in rows.select(parsing.parse_outcome(*(F.col(c) for c in rows.columns)).alias("p")).collect()]
    assert got == [("kept", 2, None, "표 2개 추출 성공 | slow"), ("", 0, "broken", None), ("", 0, None, "표 추출 비활성화")]
    parsed = session.createDataFrame([("a", "x", None), ("b", "", "bad")], "path string, text string, error string")
    wanted = session.createDataFrame([("a",), ("b",), ("c",), ("a",)], "path string")
    assert {r["path"]: r["error"] for r in parsing.with_missing_files(wanted, parsed).collect()} == {"a": None, "b": "bad", "c": "파일 없음: c"}


def test_recognised_lines_need_all_scores(session):
    rows = session.createDataFrame([([" a ", "b", None, ""], [0.5, float("nan"), 0.9, 1.0])], "t array<string>, s array<double>")
    assert rows.select(parsing.recognised_lines(F.col("t"), F.col("s")).alias("x")).first()["x"] == "a"
    short = session.createDataFrame([(["a"], [0.5, 0.7])], "t array<string>, s array<double>")
    with pytest.raises(Exception, match="as many scores"):
        short.select(parsing.recognised_lines(F.col("t"), F.col("s"))).collect()


def test_pages_without_recognition_stay(session):
    rows = session.createDataFrame([([" a ", "long enough to be a page"], None), ([" a "], ["read"]), ([], [])], "p array<string>, r array<string>")
    got = [tuple(r["x"]) for r in rows.select(parsing.page_texts(F.col("p"), F.col("r")).alias("x")).collect()]
    assert got == [("a\n\nlong enough to be a page", 2, 1, False), ("read", 1, 1, True), ("", 0, 0, False)]


def test_headers_and_fullest_pages(session):
    cell = "array<array<struct<text:string,colspan:int,bg:string>>>"
    rows = session.createDataFrame([(1, [[("문서번호 1", 1, None), ("개정번호", 1, None)]], "문서번호1"), (2, [[(" ", 1, None)]], "b"), (1, [[("q", 1, None)]], None)], f"page int, cells {cell}, body string")
    got = {(r["page"], r["state"], r["header_like"]) for r in diagnostics.repeat_states(rows).collect()}
    assert got == {(1, "partial", True), (1, "unique", False)}
    assert [tuple(r) for r in diagnostics.fullest_pages(rows, "page", 1).collect()] == [(1, 2)]


def test_vectors_follow_content(session, tmp_path):
    rows = session.createDataFrame([("c1", 1, "a"), ("c2", 2, None)], "chunk_id string, doc_id int, text string")
    again = rows.orderBy(F.desc("chunk_id"))
    other = rows.union(rows.limit(1))
    assert vectors.content_digest(rows) == vectors.content_digest(again) != vectors.content_digest(other)
    embed = lambda t: F.array(F.length(t))
    vectors.stored_vectors(rows, str(tmp_path), "b", embed)
    assert vectors.of_document(vectors.stored_vectors(other, str(tmp_path), "b", embed), 1).count() == 2
    assert len(list((tmp_path / "b").iterdir())) == 2
    empty = vectors.stored_vectors(rows.limit(0), str(tmp_path), "b", embed)
    assert empty.count() == 0 and "vector" in empty.columns
    got = session.createDataFrame([({"a": "1", "b": None},)], "m map<string,string>").select(vectors.plain_metadata(F.col("m")).alias("m")).first()["m"]
    assert got == {"a": "1"}


def test_nothing_to_reload(session, tmp_path):
    assert merged.reload(session, str(tmp_path / "none")) is None


def test_generators(session):
    rows = session.createDataFrame([(1, "a\nb \n"), (2, ""), (3, None)], "query_id int, prompt string")
    got = {r["query_id"]: (r["prompt"], r["answer"], r["execution_error"]) for r in generation.generated(rows, "offline").collect()}
    assert got == {1: ("a\nb \n", "b", None), 2: ("", None, None), 3: (None, None, None)}
    with pytest.raises(KeyError):
        generation.generated(rows, "unknown")
