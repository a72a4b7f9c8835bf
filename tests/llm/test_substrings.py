import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from docforge.llm import anchors, induced, relative_lz, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passages(seed=0, words=200):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(words)]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(15, 60))) for _ in range(8)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 50))))
        words_ = " ".join(parts).split(" ")
        if rng.random() < 0.3:
            words_[rng.randrange(len(words_))] = "changed"
        out.append(" ".join(words_) if rng.random() < 0.8 else "\n".join(words_))
    return [*out, "y " * 100, "z " * 70 + "y " * 40, "a b c " * 30]


def brute_words(texts, size=20):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            if x in seen:
                gone.update(range(i, i + size))
            seen.add(x)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_relative_lz_against_brute_force(spark, make, sample):
    for texts in ([*sample, *passages()], passages(1, 4)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in relative_lz.report(make(texts).repartition(4)).collect()}
        want = brute_words(texts)
        assert [got[i] for i in range(len(texts))] == want
    assert relative_lz.report(make([])).count() == 0


def test_small_batches(spark, make):
    texts = passages(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in relative_lz.report(make(texts)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(len(texts))] == brute_words(texts)


def test_large_anchors_are_parted(spark, make, monkeypatch):
    """With a bound that most anchors exceed, results stay the same."""
    common = "a b c d e f g h i j "  # the anchor of many different passages
    rng = random.Random(3)
    texts = passages(3, 8) + [" ".join(rng.choices("pqrs", k=12)) + " " + common + " ".join(rng.choices("tuvw", k=12)) for _ in range(60)]
    for most in (40, 300):
        monkeypatch.setattr(relative_lz, "MOST", most)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in relative_lz.report(make(texts).repartition(4)).collect()}
        assert [got[i] for i in range(len(texts))] == brute_words(texts)
    monkeypatch.setattr(suffix_dedup, "SHARD", 300)
    texts = [t[:1500] for t in texts]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(make(texts).repartition(4)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts)


def test_frequent_anchors_are_salted(spark, make, monkeypatch):
    """Anchors and contents count as frequent early, so most rows are salted by content or document; results stay the same."""
    for name, value in (("SAMPLED", 1), ("LEAST", 3), ("FREQUENT", 1_000_000), ("SALT", 3)):
        monkeypatch.setattr(anchors, name, value)
    same = " ".join(f"w{i}" for i in range(30))
    texts = passages(5, 8) + [same] * 100 + ["x " + same + " y"] * 3
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in relative_lz.report(make(texts).repartition(6)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts)
    texts = [t[:1500] for t in texts]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(make(texts).repartition(6)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts)


def test_factors_are_the_longest_of_all_places_and_blocks():
    h = lambda x: relative_lz._window_hashes(np.array(x, np.uint64), 3).tolist()
    blocks = [relative_lz.ReferenceBlock(3), relative_lz.ReferenceBlock(3)]
    for block, ref in ((0, [1, 2, 3, 4, 5, 6]), (0, [1, 2, 3, 9]), (1, [1, 2, 3, 4, 8]), (1, [6, 7, 8])):
        blocks[block].add(ref, h(ref))
    text = [1, 2, 3, 4, 5, 6, 7, 8]
    assert relative_lz.factors(text, h(text), blocks, 3) == [(0, 6), (5, 3)]
    rng = random.Random(0)
    for _ in range(200):
        refs = [[rng.randrange(3) for _ in range(rng.randint(3, 15))] for _ in range(6)]
        blocks = [relative_lz.ReferenceBlock(3) for _ in range(2)]
        for k, ref in enumerate(refs):
            blocks[k % 2].add(ref, h(ref))
        text = [rng.randrange(3) for _ in range(rng.randint(3, 20))]
        longest = lambda i: max([n for n in range(3, len(text) - i + 1) if any(text[i : i + n] == r[k : k + n] for r in refs for k in range(len(r)))], default=0)  # noqa: E731, B023
        for start, n in relative_lz.factors(text, h(text), blocks, 3):
            assert n == longest(start)


def test_factors_are_greedy_and_checked_at_boundaries():
    import numpy as np

    block = relative_lz.ReferenceBlock(3)
    h = lambda x: relative_lz._window_hashes(np.array(x, np.uint64), 3).tolist()
    for ref in ([1, 2, 3, 4, 5], [4, 5, 6, 7]):
        block.add(ref, h(ref))
    text = [9, 1, 2, 3, 4, 5, 6, 7, 8]
    assert relative_lz.factors(text, h(text), [block], 3) == [(1, 5), (4, 4)]


def brute_bytes(texts, size=50):
    seen, out = {}, []
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - size + 1):
            x = raw[i : i + size]
            if seen.setdefault(x, d) < d:
                gone[i : i + size] = [True] * size
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_against_brute_force(spark, make, sample):
    texts = [t and t[:3000] for t in [*sample, *passages(), "ab" * 60, "ab" * 40, "c" * 200, "d" + "c" * 49, "c" * 51]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(make(texts).repartition(4)).collect()}
    want = brute_bytes(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert suffix_dedup.report(make([])).count() == 0


def test_induced_order_and_common_prefixes():
    rng = random.Random(0)
    for turn in range(300):
        text = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 40))]
        text = (text * 5)[:60] if turn % 3 == 0 else text
        order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        shared = [0]
        for a, b in zip(order, order[1:]):
            k = 0
            while k < 8 and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            shared.append(k)
        for memory in (1000, 3):  # the second spills to disk
            got = list(induced.suffix_order(np.array(text), 8, memory))
            assert np.concatenate([x[0] for x in got]).tolist() == order
            assert np.concatenate([x[1] for x in got]).tolist() == shared


def test_contents_of_one_anchor_are_told_by_the_whole_hash(make):
    """Two passages of one anchor whose contents have the upper half of their hashes in common, found among 300,000."""
    import pyarrow as pa

    from docforge.llm import textkernel as K

    names = [f"w{i}" for i in range(20_000)]
    hashes, _ = relative_lz.words(*K.flat(pa.array([" ".join(names)])))
    rng = np.random.default_rng(0)
    grams = rng.integers(0, len(names), (200_000, 5))
    acc = K.prefix_hash(hashes[grams].ravel())
    at = np.arange(len(grams)) * 5
    picked = rng.integers(0, len(names), (300_000, 20))
    picked[:, :5] = grams[np.argmin(K.span_hash(acc, at, at + 5))]  # a rare low hash: the anchor of nearly all rows
    row, _, _, key, content = anchors.spans(hashes[picked].ravel(), np.arange(len(picked) + 1) * 20, 20, 5)
    same = np.flatnonzero(key == key[0])
    order = same[np.argsort(content[same], kind="stable")]
    high = content[order] >> np.uint64(32)
    k = np.flatnonzero((high[1:] == high[:-1]) & (content[order][1:] != content[order][:-1]))
    assert len(same) > 250_000 and len(k)
    texts = [" ".join(names[i] for i in picked[row[order[k[0] + j]]]) for j in (0, 1)]
    assert [r.n_removed for r in relative_lz.report(make([*texts, texts[1]])).orderBy("doc_id").collect()] == [0, 0, 20]


def test_spans_that_share_only_an_anchor_are_not_sorted(monkeypatch):
    rng, sorted_spans, repeats = random.Random(8), [], suffix_dedup.repeats
    letters = lambda n: bytes(rng.choices(b"abcdefghij ", k=n))
    texts = [letters(200) for _ in range(40)]
    anchor = min(((int(anchors.spans(np.frombuffer(t, np.uint8).astype(np.int64), np.array([0, 200]), 50, 20)[3][0]), t) for t in texts))[1]
    texts = [t[:60] + anchor + t[60:] for t in texts[:30]] + [texts[0][:40] + anchor[20:120]]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    row, start, n, key, _ = anchors.spans(data.astype(np.int64), at, 50, 20)
    alone = [letters(30) + anchor[60:80] + letters(30) for _ in range(40)]  # of an anchor, but with no window of another
    key_of = anchors.K.span_hash(anchors.K.prefix_hash(np.frombuffer(anchor[60:80], np.uint8)), np.array([0]), np.array([20]))[0].astype(np.int64)
    rows = [(int(k), int(r), int(s - at[r]), int(m), texts[r][s - at[r] : s - at[r] + m + 49]) for k, r, s, m in zip(key.astype(np.int64), row, start, n)]
    rows += [(int(key_of), 100 + i, 0, 11, t[10:70]) for i, t in enumerate(alone)]
    rows.sort(key=lambda r: r[:3])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["key", "doc_id", "start", "n", "elements"])
    monkeypatch.setattr(suffix_dedup, "repeats", lambda contents, *a: sorted_spans.extend(contents) or repeats(contents, *a))
    some = pa.Table.from_batches(suffix_dedup._shards(iter([batch]))).to_pylist()
    assert some and not {t[10:70] for t in alone} & set(sorted_spans)
    monkeypatch.setattr(suffix_dedup, "met", lambda data, at, keys, docs: np.ones(len(keys), bool))
    places = lambda found: {(r["doc_id"], r["start"] + k) for r in found for k in range(r["n"])}
    assert places(some) == places(pa.Table.from_batches(suffix_dedup._shards(iter([batch]))).to_pylist())
