import os
import zlib

import numpy as np
import pytest
from test_jaccard import brute as brute_classes
from test_lines import brute as brute_lines
from test_scans import brute_contamination

import corpus_pipeline as P
from docforge.llm.queries import tokenizer_file

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no generated tables")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(120).cache()
    columns = docs.columns
    ids = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = P.STAGES[0][1](spark, docs, D)
    assert good.columns == columns and set(ids(good)) <= set(ids(docs))
    some = ids(docs)

    order = sorted(some)
    texts = [some[i][:600] for i in order]  # the brute force is slow
    short = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(order, texts)], docs.schema)
    gone = brute_lines(texts)
    want = {}
    for k, (i, t) in enumerate(zip(order, texts)):
        left = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(k, ()))
        if left.strip(" "):
            want[i] = left
    out = P.STAGES[1][1](spark, short, D)
    assert ids(out) == want and out.columns == columns
    assert out.where("n_chars != length(text)").count() == 0

    out = P.STAGES[2][1](spark, docs, D)
    classes = brute_classes([some[i] for i in order])
    assert set(ids(out)) == {i for k, i in enumerate(order) if classes[k][1] == k}

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    out = P.STAGES[3][1](spark, docs, D)
    hits = brute_contamination([some[i] for i in order], bench)
    assert set(ids(out)) == {i for i, h in zip(order, hits) if not h[1]}

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = P.STAGES[4][1](spark, docs, D).collect()
    for r in rows:
        ids_ = np.array([*tokenizer.encode(some[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids_[r.start : r.start + r.length].tobytes()) == r.ids_crc32


@pytest.mark.skipif(not os.path.isdir(D), reason="no generated tables")
def test_run(spark):
    out = P.run(spark, D)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
