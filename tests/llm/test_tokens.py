import zlib

import numpy as np
import pyarrow as pa
import pytest

from docforge.llm import packing, records
from docforge.llm import pretrained_tokens as T
from docforge.llm import textkernel as K
from docforge.llm.queries import tokenizer_file

ODD = ["", " ", "\n", "a\n", "\nb", " a", "a ", "a\n\nb  c\n d", "don't we'll", "<|endoftext|> hi", "é́té úx", "  \n  x", "日本 語　テ", "a\tb", "été\nx", "x\né", "a\x1cb \x1fc\x85d", "ΣΑΣ ΑΣ", " ́a  b"]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_pieces_give_the_ids_of_whole_texts(sample, name, kind):
    texts = [t or "" for t in [*ODD, *sample, *ODD]]
    encoder = T.PieceEncoder(tokenizer_file(name), kind)
    got = []
    for a, b, part, offs in K.chunks(*K.flat(pa.array(texts)), 5000):
        ids, first = encoder.encode(part, offs)
        got += [ids[first[i] : first[i + 1]].tolist() for i in range(b - a)]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")])
def test_words_are_learnt_once_whatever_mark_follows(name, kind):
    marks = ["", ",", ".", "?", "!", ":", ";", ")", "'", "\"", "...", "1", "_", "'s", "'ll,"]
    texts = [f"say {w}{m} again" for w in ("word", "Other", "x") for m in marks]
    texts += ["a=\u0338b c<\u0338d", "x'll,don't(s't)'s's", "a<|endoftext|>b", "a1b2 3c'd", "a'", "A.B.C.", "\u00e9.x", "x.\u00e9 x,\u0301y", "a", ",", "b", ".c\nd.\n e,\nf", "http://a.b/c?d=e&f", "ab\u0301,c", "\u03a3a,\u03a3.", "a, \tb"]
    encoder = T.PieceEncoder(tokenizer_file(name), kind)
    ids, first = encoder.encode(*K.flat(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder.clear()
    encoder.encode(*K.flat(pa.array(texts[: 3 * len(marks)])))
    assert encoder.table.count < 30


def test_records_round_trip(spark, make, sample):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want, start = {}, 0
    for i, t in enumerate(sample):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = records.report(make(sample).repartition(5), tokenizer_file("byte_bpe_50k.json")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    assert records.report(make([]), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_damage_is_found():
    record = records.frame(b"abcdef")
    assert records.unframe(memoryview(record), 0) == (b"abcdef", len(record))
    for at in range(len(record)):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)), 0)


def _sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    return by


def test_packing(spark, make, sample):
    path = tokenizer_file("word_bpe_49k.json")
    rows = packing.pack(make([*sample, "many words here " * 3000]).repartition(3), path).collect()
    for spans in _sequences(rows).values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == 4096 * r.piece and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate([*sample, "many words here " * 3000])}
    assert packing.pack(make([]), path).count() == 0


def test_plan_uses_all_and_stays_near_the_bound():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 101, 400), np.full(7, 51), np.array([100, 1, 99, 50, 50]), rng.integers(30, 40, 200)):
        counts = np.bincount(sizes, minlength=101)
        used, runs = np.zeros(101, int), packing.plan(counts, 100)
        for fill, repeat in runs:
            assert sum(fill) <= 100
            for x in fill:
                used[x] += repeat
        assert (used == counts).all()
        assert packing.waste_bound(counts, 100) <= sum(r for _, r in runs) <= packing.waste_bound(counts, 100) * 1.2 + 1


def test_plan_backtracks_over_bins():
    counts = np.bincount([60, 59, 57, 28, 25, 22, 18, 16, 15], minlength=101)
    assert sum(r for _, r in packing.plan(counts, 100)) == 3
    assert sum(packing.completion(counts, np.flatnonzero(counts), 40)) == 40
    rng = np.random.default_rng(1)
    for _ in range(30):  # lengths cut from full bins: the best plan is known
        cuts = [np.diff([0, *np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 4), replace=False)), 60]) for _ in range(6)]
        counts = np.bincount(np.concatenate(cuts), minlength=61)
        runs, used = packing.plan(counts, 60), np.zeros(61, int)
        for fill, repeat in runs:
            assert sum(fill) <= 60
            np.add.at(used, fill, repeat)
        assert (used == counts).all() and sum(r for _, r in runs) == 6
