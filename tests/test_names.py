"""Names in texts, beginnings and hints against comparing every pair."""

import random
import time

from docforge.operators import contexts, names
from docforge.sources import archives


def test_contained_touched_and_beginning(session):
    r = random.Random(2)
    word = lambda n: "".join(r.choices("abc é", k=n))
    texts = [(i, word(r.choice([0, 3, 12, 60]))) for i in range(60)] + [(60, None), (61, "")]
    own = [(i, t[1][a : a + n] if (t := r.choice(texts))[1] and (a := r.randrange(len(t[1]))) >= 0 else word(n)) for i in range(40) for n in [r.randint(1, 10)]] + [(40, None), (41, "")]
    t, n = session.createDataFrame(texts, "k int, t string"), session.createDataFrame(own, "n int, name string")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    plan = names.contained(t, n, "k", "t", "n", "name", piece=4)
    assert pairs(plan) == sorted((k, i) for k, x in texts for i, y in own if x and y and y in x)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
    cut = lambda s: {s[a : a + 4] for a in range(len(s or "") - 3)}
    good = lambda p: p.strip(" ") == p and "ab" not in p
    assert pairs(names.touched(t, n, "k", "t", "n", "name", piece=4, common=("ab",))) == sorted((k, i) for k, x in texts for i, y in own if any(good(p) for p in cut(x) & cut(y)))
    begin = names.beginning(t, n, "k", "t", "n", "name")
    assert pairs(begin) == sorted((k, i) for k, x in texts for i, y in own if x is not None and y and x.startswith(y))
    assert "NestedLoop" not in begin._jdf.queryExecution().toString()
    assert names.contained(t, n.limit(0), "k", "t", "n", "name").count() == 0 and names.beginning(t, n.limit(0), "k", "t", "n", "name").count() == 0


def test_hints_by_alias_and_rank(session):
    catalogue = session.createDataFrame([("a", "서울특별시 (본청)", "도로 정비"), ("b", "한국수자원공사", "댐 관리"), ("c", "부산광역시", "항만 x-ray")], "doc_id string, owner string, title string")
    aliases = session.createDataFrame([("한국수자원공사", "K water"), ("unknown", "nobody")], "owner string, alias string")
    asked = session.createDataFrame([(1, "서울의 사업"), (2, "서울 특별시 예산"), (3, "k-water와 K WATER"), (4, "한국수자원 예산"), (5, "X-Ray 도입"), (6, None), (7, "한국수자원공사의 댐 관리 사업")], "query_id int, text string")
    plan = contexts.hint_scores(asked, catalogue, aliases)
    got = {(r.query_id, r.doc_id): r.score for r in plan.collect()}
    assert got == {(2, "a"): 20, (3, "b"): 20, (5, "c"): 6, (7, "b"): 22}
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()


def test_members_by_beginnings(session):
    index = session.createDataFrame([("z", "a/Report One.pdf", "report one.pdf"), ("z", "b/plan.hwp", "plan.hwp"), ("z", "b/plan two.hwp", "plan two.hwp"), ("z", "c/long", "long")], "archive string, member string, name string")
    wanted = session.createDataFrame([("report",), ("plan",), ("Long name.pdf",), ("plan.hwp",), (None,), (" ",), ("other",)], "source string")
    got = {r.source: r.member for r in archives.find_members(wanted, index).collect()}
    assert got == {"report": "a/Report One.pdf", "Long name.pdf": "c/long", "plan.hwp": "b/plan.hwp"}


def test_beginnings_of_many_equal_names_are_shuffled_and_dealt(session, monkeypatch):
    monkeypatch.setattr(names, "TOGETHER", 3)
    long = [(i, f"ab{i % 3}") for i in range(30)] + [(0, "ab7"), (1, "ab1")]
    short = [(i, "ab") for i in range(20)] + [(i, "ab1") for i in range(10)] + [(3, "ab"), (40, None), (41, "")]
    plan = names.beginning(session.createDataFrame(long, "k int, t string"), session.createDataFrame(short, "n int, name string"), "k", "t", "n", "name")
    assert sorted(map(tuple, plan.collect())) == sorted({(k, i) for k, x in long for i, y in short if y and x.startswith(y)})
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().toString(), "the driver builds no table of names"


def test_names_in_a_long_text(session):
    text = "".join(random.Random(1).choices("abcdé😀 \n", k=600_000))
    own = [(0, text[199:230]), (1, text[-30:]), (2, text[:24]), (3, text[399_990:400_020] + "#"), (4, text[5:10]), (5, "\U0001f601")]
    began = time.time()
    found = names.contained(session.createDataFrame([(1, text)], "k int, t string"), session.createDataFrame(own, "n int, name string"), "k", "t", "n", "name", piece=24)
    assert sorted(r.n for r in found.collect()) == [0, 1, 2, 4] and time.time() - began < 40, "pieces are cut in time linear in the text"


def test_many_pieces_are_joined(session, monkeypatch):
    monkeypatch.setattr(names, "LITERAL_PIECES", 1)
    test_contained_touched_and_beginning(session)
