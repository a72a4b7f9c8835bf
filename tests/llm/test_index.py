"""Ranked search against brute force: exact scores, ties, shards, rows without ids, odd texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docforge.llm import lexical_index as L

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, questions, k):
    """docs: (id, text); (question number, rank, id, score)."""
    split = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(w for _, own in split for w in set(own))
    out = []
    for q, text in enumerate(questions):
        found = []
        for i, own in split:
            tf, m = Counter(own), 25 + (75 * len(own) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in terms(text) if tf[w])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.mark.parametrize("shard", [60, 5_000, L.SHARD_BYTES])
def test_search_is_exact(spark, make, sample, shard):
    docs = [*enumerate(sample), (None, sample[0]), (None, "Straße ünï"), (7, sample[7]), (9_000, sample[2]), (5, sample[2])]
    asked = [sample[2][:200], sample[0], "STRASSE straße ÜNÏ", "", None, "no-such-term-anywhere", "the The THE a_b", sample[-1], "x"]
    bench = spark.createDataFrame([(10 + i, t) for i, t in enumerate(asked)], "item_id long, text string")
    index = L.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes=shard)
    got = sorted(((r.item_id - 10, r["rank"], r.doc_id, r.score) for r in L.search(index, bench, 10).collect()), key=lambda x: x[:2])
    assert got == brute(docs, asked, 10)
    assert index.shards.count() >= (3 if shard > 60 else 50)


def test_blocks_of_questions_and_repeated_items(spark, sample, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_QUESTIONS", 2)
    docs = list(enumerate(sample))
    bench = spark.createDataFrame([(1, sample[1]), (1, sample[1]), (None, sample[2]), (4, sample[3])], "item_id long, text string").coalesce(1)
    rows = L.search(L.build(spark.createDataFrame(docs, "doc_id long, text string")), bench, 3).collect()
    want = brute(docs, [sample[1], sample[2], sample[3]], 3)
    by = {i: sorted((r["rank"], r.doc_id, r.score) for r in rows if r.item_id == i) for i in (1, None, 4)}
    for q, i in enumerate((1, None, 4)):
        assert by[i] == sorted(x[1:] for x in want if x[0] == q for _ in range(2 if i == 1 else 1))


def test_odd_tables(spark):
    schema = "doc_id long, text string, ids string, number string, terms string"
    odd = spark.createDataFrame([(None, None, "a", "b", "c"), (1, "", None, None, None), (2, " \n", "", "", "")], schema)
    bench = spark.createDataFrame([(1, "word"), (None, None)], "item_id long, text string")
    assert L.report(odd, bench).collect() == [] and L.report(odd.limit(0), bench).collect() == [] and L.report(odd, bench.limit(0)).collect() == []
    one = spark.createDataFrame([(3, "word " * 300_000, "a", "b", "c")], schema)
    assert [(r.item_id, r["rank"], r.doc_id) for r in L.report(one.union(odd).union(spark.createDataFrame([(4, "other words", "", "", "")], schema)), bench).collect()] == [(1, 1, 3)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.booleans()), max_size=40), st.integers(1, 6))
def test_selection_is_safe_for_ties(rows, k):
    scores, ids, none = (np.array([r[i] for r in rows], t) for i, t in ((0, np.int64), (1, np.int64), (2, bool)))
    order = sorted((i for i in range(len(rows)) if scores[i] > 0), key=lambda i: (-scores[i], none[i], ids[i], i))
    got = L.best(scores, ids, none, k).tolist()
    key = lambda i: (scores[i], none[i], ids[i])
    assert [key(i) for i in got] == [key(i) for i in order[:k]]


def test_two_words_of_one_hash(monkeypatch):
    """Words are told apart by a second hash where the first is the same for all."""
    real = L._term_keys
    monkeypatch.setattr(L, "_term_keys", lambda *a: (np.zeros_like(real(*a)[0]), real(*a)[1]))
    import pyarrow as pa

    from docforge.llm import textkernel as K

    data, offsets = K.flat(pa.array(["b a b", "c a", ""]))
    row = L._shard([1, 2, 3], [(data, offsets)]).to_pylist()[0]
    assert row["terms"] == b"abc" and np.frombuffer(row["starts"], np.int64).tolist() == [0, 2, 3, 4]
    assert np.frombuffer(row["docs"], np.int32).tolist() == [0, 1, 0, 1] and np.frombuffer(row["counts"], np.int32).tolist() == [1, 1, 2, 1]


def test_shards_are_held_one_at_a_time(spark, monkeypatch):
    """Row groups and what workers are handed hold one shard, however many a partition has."""

    def watched(make):
        def made(*args):
            inner = make(*args)

            def run(batches):
                def alone():
                    for batch in batches:
                        assert batch.num_rows == 1, f"{batch.num_rows} shards at once"
                        yield batch

                yield from inner(alone())

            return run

        return made

    import pyarrow.parquet as pq

    docs = [(i, " ".join(f"w{j:06d}" for j in range(i * 70_000, (i + 2) * 70_000))) for i in range(4)]
    for step in ("_weighing", "_counting", "_searching"):
        monkeypatch.setattr(L, step, watched(getattr(L, step)))
    index = L.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), shard_bytes=1_000_000)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.shards.inputFiles()]
    assert [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)] == [1] * len(docs)
    assert not any(m.row_group(i).column(j).is_stats_set for m in files for i in range(m.num_row_groups) for j in range(m.num_columns))  # the writer keeps them for all of a file
    asked = ["w000003", "w100000 w150000", "w349999 W349998"]
    bench = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in L.search(index, bench, 10).collect()), key=lambda x: x[:2])
    assert got == brute(docs, asked, 10) and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize("size", [1, 7, 50])
def test_long_texts_are_split_in_pieces(size, monkeypatch):
    """The same shard, whatever the size of a piece; words longer than a piece stay whole."""
    import pyarrow as pa

    from docforge.llm import textkernel as K

    texts = ["", "a b a", "é☃ x-" * 40 + "tail", "word" * 60 + " " + "word " * 30, None, " - " * 50, "b" * 120, "a"]
    parts = [K.flat(pa.array(x)) for x in (texts, texts[:3], texts[2:4])]
    whole = L._shard(list(range(13)), parts).to_pylist()
    monkeypatch.setattr(L, "PIECE_BYTES", size)
    assert L._shard(list(range(13)), parts).to_pylist() == whole
    pieces = list(L._pieces(*parts[0]))
    assert b"".join(p.tobytes() for _, p, _ in pieces) == parts[0][0].tobytes() and len(pieces) > len(texts)
