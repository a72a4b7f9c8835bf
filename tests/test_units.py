"""Operators that SQL cannot express: splitter, candidates, period tables, readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import candidates, chunking, evaluation, filters, metadata, retrieval, scoring, tables
from docforge.operators import retrieval as R
from docforge.sources import readers, sinks


def test_splitter_limits_and_order():
    text = ("word " * 300 + "\n\n") * 3 + "x" * 2000 + "\n" + "end. " * 50
    pieces = chunking.split_text(text)
    assert all(0 < len(p) <= chunking.CHILD and p == p.strip() for p in pieces)
    assert "".join(pieces).count("x") >= 2000
    at = 0
    for p in pieces:  # in order, each inside the text
        at = text.index(p, max(0, at - chunking.CHILD_OVERLAP - 50))
    assert chunking.split_text("") == [] and chunking.split_text(" \n ") == []
    assert chunking.split_text("a b c d", 4, 0, (" ", "")) == ["a b", "c d"]
    assert chunking.split_text("aa bb cc dd", 6, 3, (" ", "")) == ["aa bb", "bb cc", "cc dd"]


def test_nested_chunks(session):
    docs = session.createDataFrame([("d", "para one. " * 400, True, "x"), ("e", "short", False, "y"), ("f", None, False, None)], "doc_id string, text string, nested boolean, lang string")
    rows = chunking.chunk_documents(docs).collect()
    parents = {r.chunk_id: r.text for r in rows if r.strategy == "parent"}
    children = [r for r in rows if r.strategy == "child"]
    assert parents and all(r.text in parents[r.parent_chunk_id] for r in children)
    assert all(len(t) <= chunking.PARENT for t in parents.values())
    assert [(r.chunk_id, r.metadata["lang"]) for r in rows if r.doc_id == "e"] == [("e::rec::0", "y")]
    assert not [r for r in rows if r.doc_id == "f"]


def test_period_table(session):
    cell = lambda t, n=1, bg=None: (t, n, bg)
    cells = [[cell("task"), cell("M"), cell("M+1"), cell("M+2")], [cell("plan"), cell("", 1, "grey"), cell(""), cell(""), cell("")], [cell("build"), cell(""), cell("▲"), cell(""), cell("")], [cell("rest"), cell("", 4)]]
    df = session.createDataFrame([(1, cells), (2, [[cell("a"), cell("b")], [cell(""), cell("c")]])], f"table_id long, cells {tables.TABLE}")
    got = {r.table_id: r.text for r in tables.gantt_lines(df).collect()}
    # the header counts its label cell, body rows do not: column 1 is M, column 0 is before it
    assert got == {1: tables.GANTT_HEADING + f"\nplan: {tables.NO_PERIOD}\nbuild ({tables.MARKED}): M\nrest: {tables.NO_PERIOD}"}
    assert df.select(tables.flat_rows(F.col("cells")).alias("t")).collect()[1].t == "[표]\na | b\nc"


def test_repeats_and_css(session):
    cell = lambda t: (t, 1, None)
    df = session.createDataFrame([([[[cell("a b"), cell("c")]], [[cell("zz"), cell("c")]]], "x ab c"), ([[[cell("q")]]], "")], f"ts array<{tables.TABLE}>, body string")
    assert [len(r.k) for r in df.select(tables.without_repeats(F.col("ts"), F.col("body")).alias("k")).collect()] == [1, 1]
    css = session.createDataFrame([(".a { background-color: #FF0000 } .b{color:red; background:blue}",)], "c string")
    assert css.select(tables.css_backgrounds(F.col("c")).alias("m")).first().m == {"a": "#ff0000", "b": "blue"}


def test_constraints():
    c = filters.parse_constraints("3억원 초과하는 지자체 사업")
    assert (c.minimum, c.exclusive, c.local) == (3e8, True, True)
    assert filters.parse_constraints("아무 조건 없음").predicate(F.lit(1) if False else None, None) is None
    assert filters.amount_bounds("1억 이상 5,000만원 미만", T.UNITS) == [(">=", 1e8), ("<", 5e7)]


def test_options_and_names(session):
    rows = [("예산은 5억원이다", "5억원", True), ("예산은 6억원이다", "5억원", False), ("alpha beta gamma", "beta delta gamma", True), (None, "x", False), ("010 days", "10 days", True)]
    df = session.createDataFrame([(a, o) for a, o, _ in rows], "a string, o string")
    assert [r.m for r in df.select(T.normal_form("a").alias("a"), T.normal_form("o").alias("o")).select(scoring.states_option(F.col("a"), F.col("o")).alias("m")).collect()] == [w for *_, w in rows]
    assert session.createDataFrame([("abc", "abd")], "a string, b string").select(evaluation.name_likeness("a", "b").alias("r")).first().r == pytest.approx(2 / 3)


def test_unique_ids(session):
    df = session.createDataFrame([("a",), ("b",), ("a",)], "name string")
    with pytest.raises(ValueError):
        metadata.unique_ids(df, "name")
    assert metadata.unique_ids(df.distinct(), "name").columns == ["name", "doc_id"]


def test_readers(session, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿name,text\na,"two\nlines"\n', encoding="utf-8")
    assert readers.read_metadata(session, str(p), ["name", "text"]).first().text == "two\nlines"
    with pytest.raises(ValueError):
        readers.read_metadata(session, str(p), ["budget"])
    assert readers.read_side_table(session, str(tmp_path / "none.csv"), ["name"]) is None
    j = tmp_path / "x.jsonl"
    j.write_text('﻿{"id": "1", "n": 2}\n\n{"id": "2", "n": 3}\n', encoding="utf-8")
    assert [r.n for r in readers.read_jsonl(session, str(j), "id string, n int").orderBy("id").collect()] == [2, 3]
    j.write_text('{"id": "1"}\nbroken\n')
    with pytest.raises(Exception, match="malformed|MALFORMED|raise"):
        readers.read_jsonl(session, str(j), "id string, n int").collect()
    for k, v in enumerate(({"id": "1"}, [{"id": "2"}, {"id": "3"}], {"runtime": {}, "result": {"id": "4"}})):
        (tmp_path / f"r{k}.json").write_text(json.dumps(v))
    got = [r.id for k in range(3) for r in readers.read_results(session, str(tmp_path / f"r{k}.json"), "id string").collect()]
    assert got == ["1", "2", "3", "4"]
    assert readers.parse_tables("<table><tr><td>a<table><tr><td>in</td></tr></table></td><td colspan=3 style='background-color: red;'>b</td></tr></table>")[0][0][1] == {"text": "b", "colspan": 3, "bg": "red"}


def test_binary_files(session, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.zzz").write_bytes(b"?")
    (tmp_path / "c.bad").write_bytes(b"?")

    def broken(_: bytes):
        raise RuntimeError("no")

    files = session.read.format("binaryFile").load(str(tmp_path))
    rows = {r.path[-5:]: r for r in readers.parse_files(files, {"txt": lambda b: (b.decode(), 0, 1, 0, None), "bad": broken}).collect()}
    assert rows["a.txt"].text == "hello" and "unsupported" in rows["b.zzz"].error and "RuntimeError" in rows["c.bad"].error


def test_sinks(session, tmp_path):
    df = session.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part*")).read_bytes().startswith("﻿k,v".encode())
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert session.read.json(str(tmp_path / "j")).count() == 4
    one = sinks.manifest(session, str(tmp_path / "c"), model="m")
    sinks.check_resume(None, one)
    sinks.check_resume(one, one)
    with pytest.raises(ValueError):
        sinks.check_resume(one, sinks.manifest(session, str(tmp_path / "c"), model="n"))


def test_embedding_and_folding(session):
    df = session.createDataFrame([("Ｈｅllo ß 가나 %",), (None,), ("",)], "t string")
    assert [r.f for r in df.select(T.folded("t").alias("f")).collect()] == ["helloss가나%", "", ""]
    v = df.select(R.hash_embedding(32)("t").alias("v")).collect()
    assert sum(x * x for x in v[0].v) == pytest.approx(1) and set(v[1].v) == {0.0}


def test_json_in_fences(session):
    df = session.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 2}',), ("no",)], "t string")
    assert [r.j and r.j.a for r in df.select(T.json_fields(F.col("t"), "a int").alias("j")).collect()] == [1, 2, None]


def _one(session, value):
    return session.range(1).select(value.alias("v")).first().v


def test_places(session):
    import re

    texts = ["", "ab", "abab xab", "no", "ababab "]
    df = session.createDataFrame([(t,) for t in texts], "t string")
    got = [[tuple(x) for x in r.v] for r in df.select(candidates.places(F.col("t"), "ab+").alias("v")).collect()]
    assert got == [[m.span() for m in re.finditer("ab+", t)] for t in texts]
    places = F.transform(F.array(*map(F.lit, [0, 5, 9, 20, 31])), lambda x: F.struct(x.alias("start"), x.alias("end")))
    assert [x.start for x in _one(session, candidates.spaced(places, 10, 3))] == [0, 20, 31]


def test_answers_that_decline(session):
    lines = [(None, True), ("확인할 수 없습니다.", True), ("하도급: 확인할 수 없습니다.\n공동수급: 모두 허용되며 최대 다섯 개 업체까지 가능하다고 적혀 있음", False), ("답은 5억원", False), ("제공된 문서에서 확인할 수 없습니다.\n[근거: a.hwp]", True)]
    df = session.createDataFrame(lines, "a string, w boolean")
    assert [r.v for r in df.select(scoring.declines_by_lines(F.col("a")).alias("v")).collect()] == [w for _, w in lines]
    rows = [
        ("제공된 문서에서 확인할 수 없습니다.\n[근거: 문서.hwp]", None, "abstained", "abstained"),
        ("사업 예산은 5억원입니다. 기간은 확인할 수 없습니다.", None, "partial_answer", "partial_answer"),
        ("예산 10억원 여부는 확인할 수 없습니다.", None, "partial_answer", "partial_answer"),
        ("확인할 수 없습니다 (2025년 계획.hwp).", None, "abstained", "abstained"),
        ("확인할 수 없습니다. 예산은 2024년에 5억원이었다.", None, "partial_answer", "abstained"),
        ("판단할 수 없습니다. 따라서 참여가 가능합니다.", None, "abstained", "abstained"),
        ("알 수 없습니다. 그러나 입찰 참여 가능성이 높습니다. 아주 높습니다.", None, "partial_answer", "partial_answer"),
        ("예산은 5억원이다", None, "answered", "answered"), (" ", None, "empty_response", "empty_response"), (None, None, "empty_response", "empty_response"), ("x", "failed", "execution_error", "execution_error"),
    ]
    df = session.createDataFrame([r[:2] for r in rows], "a string, e string")
    got = [(r.x, r.y) for r in df.select(scoring.response_status(F.col("a"), F.col("e")).alias("x"), scoring.response_status_leading(F.col("a"), F.col("e")).alias("y")).collect()]
    assert got == [r[2:] for r in rows]


def test_strict_options(session):
    rows = [
        ("요율은 100분의 10 이다", "10%", True), ("예산은 20억원", "20억", True), ("3억 이상", "3억 미만", False), ("참여 불가능", "참여 가능", False), ("참여할 수 있습니다", "참여 가능", True),
        ("본문 페이지", "본문 200페이지", False), ("2024년 3월 5일에 마감", "2024-03-05 마감", True), ("제출 서류는 신청서와 계획서", "신청서 계획서 제출", True), ("신청서", "계획서 보고서 신청서", False), (None, "x", False),
    ]
    df = session.createDataFrame([r[:2] for r in rows], "a string, o string")
    got = [r.v for r in df.select(T.normal_form("a").alias("a"), T.normal_form("o").alias("o")).select(scoring.states_option_strictly(F.col("a"), F.col("o")).alias("v")).collect()]
    assert got == [r[2] for r in rows], list(zip(rows, got))
    groups = F.array(F.array(F.lit("5억"), F.lit("500백만")), F.array(F.lit("없는 말")))
    assert _one(session, scoring.stated_groups(F.lit("예산 5억원"), groups)) == 0.5
    assert _one(session, scoring.stated_groups(F.lit("x"), F.expr("cast(array() as array<array<string>>)"))) is None


def test_golden_sets(session):
    from pyspark.errors import SparkRuntimeException

    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if x is not None else F.lit(None).cast("array<string>")
    nest = lambda x: F.array(*[arr(y) for y in x]) if x else F.expr("cast(array() as array<array<string>>)")
    assert _one(session, scoring.fact_groups(nest([["a", " "]]), nest([["b"]]), arr(["c"]))) == [["a"]]
    assert _one(session, scoring.fact_groups(nest([]), nest([["b"], [""]]), arr(["c"]))) == [["b"]]
    assert _one(session, scoring.fact_groups(nest([]), nest([]), arr(["c", ""]))) == [["c"]]
    assert _one(session, scoring.expected_decision(F.lit(" Abstain "), F.lit("answer"), F.lit(None))) == "abstain"
    assert _one(session, scoring.expected_decision(F.lit(""), F.lit(None), F.lit("ABSTAIN"))) == "abstain"
    assert _one(session, scoring.expected_decision(F.lit(None), F.lit(None), F.lit(None))) == "answer"
    assert _one(session, scoring.first_document_set(arr(["x.csv", " "]), arr(["B 1.hwp", "a.pdf", "b1.hwp"]), arr(["c"]))) == ["apdf", "b1hwp"]
    assert _one(session, F.array(scoring.within_set(arr(["a"]), arr(["b", "a"])), scoring.same_set(arr(["a", "b"]), arr(["b", "a", "a"])), scoring.same_set(arr(["a"]), arr(["b"])))) == [True, True, False]
    cases = session.createDataFrame([("q1", ["d2", "d1", "d3"]), ("q2", ["d1"]), ("q3", [])], "id string, docs array<string>")
    dups = session.createDataFrame([("d2", "d3")], "doc_id string, dup_of string")
    assert {r.id: r.docs for r in scoring.remapped(cases, dups, "id", "docs").collect()} == {"q1": ["d3", "d1"], "q2": ["d1"], "q3": []}
    patch = lambda n: session.createDataFrame([("q2", ["d1", "d9"], n)], "id string, docs array<string>, n_expected int")
    assert {r.id: r.docs for r in scoring.overlaid(cases, patch(2), "id", "docs").collect()} == {"q1": ["d2", "d1", "d3"], "q2": ["d1", "d9"], "q3": []}
    with pytest.raises(SparkRuntimeException):
        scoring.overlaid(cases, patch(3), "id", "docs").collect()
    predictions = session.createDataFrame([("q1", "예산은 5억원", None), ("q2", "답", "timeout")], "id string, answer string, execution_error string")
    assert {r.id: r.status for r in scoring.with_predictions(cases, predictions, "id").collect()} == {"q1": "answered", "q2": "execution_error", "q3": "empty_response"}
    old, new = (session.createDataFrame(x, "id string, s double") for x in ([("a", 1.0), ("b", None), ("c", 2.0)], [("a", 1.0), ("b", None), ("c", 3.0)]))
    assert [tuple(r) for r in scoring.rescored(old, new, "id", ["s"]).collect()] == [("c", 2.0, 3.0)]


def test_likeliest_names(session):
    """As holding every asked string against every name, also for short and repetitive ones."""
    import difflib
    import random

    rng = random.Random(5)
    names = ["".join(rng.choices("abcde ", k=rng.randint(1, 24))) for _ in range(120)] + ["aaaa", "aaaaaaaa", "x", "ab"]
    asked = [n[: len(n) // 2] + rng.choice("xya") + n[len(n) // 2 + 1 :] for n in names] + ["aaa", "x", "nothing like it"]
    make = lambda values, c: session.createDataFrame([(v,) for v in values], f"{c} string")
    got = {r.asked: (r.found, round(r.ratio, 9)) for r in evaluation.likeliest_names(make(asked, "asked"), make(names, "found"), "asked", "found").collect()}
    want = {}
    for a in asked:
        best = max((difflib.SequenceMatcher(None, a, n).ratio(), n) for n in names)
        if best[0] >= 0.85:
            want[a] = (best[1], round(best[0], 9))
    assert got == want


def test_containing(session):
    docs = session.createDataFrame([(1, "xalpha beta gamma delta epsilon zetay more"), (2, "alpha beta gamma delta epsilon"), (3, "short one here"), (4, None)], "doc_id long, text string")
    items = session.createDataFrame([(10, "alpha beta gamma delta epsilon zeta"), (11, "one he"), (12, "beta  gamma delta epsilon zeta more"), (13, None)], "q long, p string")
    assert sorted(map(tuple, retrieval.containing(docs, items, "doc_id", "text", "q", "p").collect())) == [(10, 1), (11, 3)]


def test_citation_alone(session):
    df = session.createDataFrame([("[근거: a, b]",), ("x [근거: a]\n\n\n\ny\n[근거: b]",), ("none",)], "a string")
    assert [r.v for r in df.select(evaluation.citation_to_end(F.col("a")).alias("v")).collect()] == ["[근거: a, b]", "x\n\ny\n\n[근거: a, b]", "none"]


def test_options_fold_an_answer_once(session):
    df = session.createDataFrame([("alpha beta", "beta delta gamma")], "a string, o string").select(scoring.states_option(F.col("a"), F.col("o")).alias("m"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count(f" {scoring.CONTENT}, 0") + plan.count(scoring.NO_CONTENT) == 3, "the answer, the option and its words, whatever the number of words"
    assert df.first().m is False
