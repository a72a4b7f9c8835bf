"""Cuts of words against all cuts, a model of glued words, and the words it gives to ranking and comparison."""

import itertools
import random

from pyspark.sql import functions as F

from docforge.operators import scoring, segments, term_index

WORDS = [s + p for s in ("학교", "학생", "사업", "예산", "제안서", "기관") for p in ("", "은", "는", "에서", "으로", "입니다", "까지")]


def every_cut(word, prices, unknown, longest):
    found = []
    for marks in itertools.product((0, 1), repeat=len(word) - 1):
        pieces, a = [], 0
        for i, m in enumerate((*marks, 1)):
            if m:
                pieces.append(word[a : i + 1])
                a = i + 1
        if all(len(p) <= longest and (p in prices or len(p) == 1) for p in pieces):
            found.append((sum(prices.get(p, unknown) for p in pieces), len(pieces), [-len(p) for p in pieces], pieces))
    return min(found)


def test_cheapest_of_all_cuts():
    r = random.Random(5)
    for _ in range(300):
        word = "".join(r.choices("abc", k=r.randint(1, 9)))
        prices = {word[a:b]: r.randint(1, 6) for a in range(len(word)) for b in range(a + 1, min(len(word), a + 4) + 1) if r.random() < 0.6}
        want = every_cut(word, prices, 7, 4)
        assert segments.best_cut(word, prices, 7, 4) == (want[0], want[3])


def model_of(session):
    docs = session.createDataFrame([(i, " ".join(w for k, w in enumerate(WORDS) if (k * 7 + i) % 3)) for i in range(30)], "doc_id long, text string")
    return docs, segments.fit(segments.word_counts(docs, F.split("text", " ")), longest=4, least=3, turns=3)


def test_glued_words(session):
    docs, model = model_of(session)
    assert segments.cut("학교에서", model) == ["학교", "에서"] and segments.cut("제안서입니다", model) == ["제안서", "입니다"]
    assert segments.cut("예산으로", model) == ["예산", "으로"]
    rows = session.createDataFrame([(1, "학교에서 예산까지"), (2, None), (3, ""), (4, "에서")], "doc_id long, text string")
    got = {r.doc_id: r.w for r in rows.select("doc_id", segments.content_words(model)(F.col("text")).alias("w")).collect()}
    assert got[1] == ["학교", "예산"] and got[3] == [] and got[4] == ["에서"]
    assert not got[2]
    assert segments.cut("학교" * 100, model) == ["학교"] * 100  # longer than a lattice


def test_ranking_and_comparison_by_pieces(session, tmp_path):
    docs, model = model_of(session)
    words = segments.content_words(model)
    rows = session.createDataFrame([(1, "학교에서 사업"), (2, "학생은 예산"), (3, "기관은 제안서")], "doc_id long, text string")
    index = term_index.build(rows, f"{tmp_path}/i", words=words(F.col("text")))
    asked = session.createDataFrame([(1, "학교는")], "query_id long, text string")
    assert [r.doc_id for r in term_index.search(index, asked, 3, f"{tmp_path}/w", query_words=words(F.col("text")), floor=None)[0].collect()] == [1]
    plain = term_index.build(rows, f"{tmp_path}/p")
    assert term_index.search(plain, asked, 3, f"{tmp_path}/v", floor=None)[0].count() == 0  # whole words never meet
    said = session.createDataFrame([("예산은 학교에서", "학교 예산"), ("학생에서 기관은", "학교 예산")], "answer string, option string")
    got = said.select(scoring.states_option_strictly(F.col("answer"), F.col("option"), words=words).alias("x")).collect()
    assert [r.x for r in got] == [True, False]
