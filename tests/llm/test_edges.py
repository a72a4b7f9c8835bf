"""Nulls in any column, empty texts, repeated rows, empty tables and columns with the operators' own names."""

import pytest

from docforge.llm import contamination, fingerprints, jaccard, lines, packing, quality, records, relative_lz, secrets, suffix_dedup
from docforge.llm.queries import tokenizer_file

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone " * 2
ROWS = [(0, LONG), (1, LONG), (1, LONG), (2, None), (None, LONG), (None, None), (3, ""), (4, " \n "), (5, "short"), (7, "é" * 200), (8, LONG + "\n" + LONG)]
NAMES = ("node", "key", "n", "start", "_gone", "_id", "_kept", "_hit", "length", "task", "span", "tail", "row_id", "place", "line", "pos", "component", "quality_score", "spans", "ids")


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, None, None, None, *NAMES) for i, t in ROWS], schema)


@pytest.fixture(scope="module")
def side(spark):
    bench = spark.createDataFrame([(1, LONG[:60]), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, None), (3, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return bench, labels


def reports(bench, labels):
    return {
        1: lines.report, 2: jaccard.jaccard_classes, 3: secrets.report, 4: relative_lz.report, 5: lambda d: packing.report(d, tokenizer_file("word_bpe_49k.json")), 6: lambda d: quality.report(d, labels),
        7: suffix_dedup.report, 8: lambda d: records.report(d, tokenizer_file("byte_bpe_50k.json")), 9: fingerprints.edited_report, 10: lambda d: contamination.report(d, bench),
    }


@pytest.mark.parametrize("n", range(1, 11))
def test_odd_rows(odd, side, n):
    out = reports(*side)[n](odd)
    rows = out.collect()
    assert len(rows) == len(ROWS), "each row has its row"
    assert len(set(out.columns)) == len(out.columns)
    assert reports(*side)[n](odd.limit(0)).count() == 0


def test_filters_keep_columns(odd, side):
    for out in (lines.without_repeats(odd), jaccard.first_of_class(odd), contamination.clean_documents(odd, side[0]), quality.accepted(odd, side[1])):
        assert out.columns == odd.columns
        out.collect()
    kept = [(r.doc_id, r.text) for r in lines.without_repeats(odd).collect()]
    assert (0, LONG) in kept and (2, None) in kept and (3, "") in kept


def test_first_of_class_keeps_documents_without_id(spark, odd):
    kept = [(r.doc_id, r.text) for r in jaccard.first_of_class(odd).collect()]
    assert sorted((x for x in kept if x[0] is None), key=str) == sorted([(None, LONG), (None, None)], key=str)
    named = [(i, t) for i, t in ROWS if i is not None and i not in (1, 8)]  # 1 and 8 have copies of 0
    assert sorted((x for x in kept if x[0] is not None), key=str) == sorted(named, key=str)
    unique = spark.createDataFrame([(None, "words that stand in no other text at all"), (None, "")], "doc_id long, text string")
    assert jaccard.first_of_class(unique).count() == 2
    other = "entirely different words that were never written before in any of the rows"
    both = spark.createDataFrame([(1, LONG), (2, other), (None, LONG), (None, other)], "doc_id long, text string")
    assert jaccard.first_of_class(both).count() == 4  # rows without an id do not tie their texts together


def test_decontamination_without_ids(spark):
    item = "the quick answer to this question is that nobody knows it yet"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "before " + item), (None, "clean text"), (None, None), (1, item), (1, "clean too"), (2, "other text")]
    kept = contamination.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[2], rows[5]], key=str)


def test_records_without_ids(spark):
    """A row without an id comes back without one, beside rows with the ids -1 and 0."""
    rows = [(None, "a b"), (-1, "a b"), (0, "a b"), (1, None)]
    out = records.report(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_file("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted([None, -1, 0, 1], key=str)
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [None, -1, 0, 1]


def test_one_very_long_text(spark, side):
    """One text of a megabyte among short ones: every operator gives its rows, and those that remove text remove the repeat."""
    long = " ".join(f"word{i * 7919 % 100_003}" for i in range(100_000))
    docs = spark.createDataFrame([(0, long), (1, "short text"), (2, "prefix " + long)], "doc_id long, text string").cache()
    found = {n: {r.doc_id: r for r in f(docs).collect()} for n, f in reports(*side).items()}
    assert all(set(rows) == {0, 1, 2} for rows in found.values())
    assert found[2][2].component_id == 0 and found[4][2].n_removed == 100_000 and found[4][0].n_removed == 0
    assert found[7][2].n_removed == len(long) and found[7][1].n_removed == 0
    assert found[9][0].near_next == 0 and found[9][2].near_next == 1 and found[9][0].n_chars == len(long)  # after the last comes the first


def test_all_stages_on_odd_rows(spark, odd, side, tmp_path):
    """Five stages over null and repeated ids, and over an empty table: columns stay, documents with text do not vanish without reason."""
    import corpus_pipeline

    side[1].write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item that stands in none of the documents at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, rows in (("odd", odd), ("empty", odd.limit(0))):
        docs = rows
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            assert stage == "packing" or docs.columns == odd.columns
        pieces = docs.collect()
        ends = {}
        for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert bool(pieces) == (name == "odd")
