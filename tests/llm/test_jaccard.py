import random
import re

import numpy as np
import pyarrow as pa

from docforge.llm import jaccard
from docforge.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, size=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(texts, size=5, percent=75):
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))
    owners = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        met = {}
        for x in s:
            for j in owners[x]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def variants(seed=3):
    """Chains of near copies around the similarity, and passages that unrelated texts share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=30))
    out = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(10):
            words = list(words)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
            if rng.random() < 0.3:
                out.append(" ".join(words) + " " + passage)
    out += [passage + " " + " ".join(rng.choices(vocabulary, k=40)) for _ in range(30)]
    rng.shuffle(out)
    return out


def check(spark, make, texts):
    rows = jaccard.jaccard_classes(make(texts).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts)
    assert len(rows) == len(texts)


def test_against_brute_force(spark, make, sample):
    check(spark, make, [*sample, *variants()])


def test_many_near_copies(spark, make):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(300):
        words = list(base)
        words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    check(spark, make, texts)


def test_empty_and_small(spark, make):
    check(spark, make, [None, "", "a b", "A  b", "a b c d e f", "  "])
    assert jaccard.jaccard_classes(make([])).count() == 0
    kept = jaccard.first_of_class(make(["same text here again now ok", "same text here again now ok", None]).withColumnRenamed("lang", "node"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and "node" in kept.columns


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for n in (3, 20, 100, 700):
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: len(a) - rng.integers(0, n // 4 + 1)], rng.integers(0, 1 << 62, rng.integers(0, n // 4 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert jaccard.may_link(np.array([len(a)]), np.array([len(b)]), np.array([jaccard._distance(jaccard.bitmap(a), jaccard.bitmap(b))]), 75)[0]


def test_shingles_do_not_cross_texts():
    texts = ["a b c d e", "f g", "", "h i j k l m"]
    got = jaccard.sets(*K.flat(pa.array(texts)), 5)
    assert [len(s) for s in got] == [1, 1, 0, 2]
    alone = [jaccard.sets(*K.flat(pa.array([t])), 5)[0] for t in texts]
    assert all((x == y).all() for x, y in zip(got, alone))


def test_long_texts_that_share_one_shingle_make_no_pairs():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    sets = [np.unique(np.append(draw(int(n)), np.uint64(0))) for n in rng.integers(1000, 9000, 60)]
    twin = np.unique(np.append(sets[0][: len(sets[0]) * 19 // 20], draw(len(sets[0]) // 20)))  # links with the first
    sets = sorted([*sets, twin], key=len)
    n = pa.array([len(s) for s in sets], pa.int64())
    own = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), n, pa.array([jaccard.bitmap(s) for s in sets], pa.binary())], ["node", "n", "bitmap"])
    maps = next(jaccard._narrowed(iter([own]))).column(1)
    zero = pa.array([0] * len(sets), pa.int64())
    tile = pa.RecordBatch.from_arrays([zero, n, own.column(0), own.column(0), zero, maps], ["key", "n", "node", "group", "rank", "bitmap"])
    twins = sorted(k for k, s in enumerate(sets) if np.array_equal(s, twin) or len(np.intersect1d(s, twin)) > len(s) // 2)
    for closest in (False, True):
        got = pa.Table.from_batches(jaccard._across(75, closest)(iter([tile])))
        assert [list(r.values()) for r in got.to_pylist()] == [twins]


def test_small_tiles_are_compared_as_large_ones():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (4, 90, 150, 800, 1100)]
    sets = []
    for k in rng.integers(0, len(base), 300).tolist():
        s = base[k]
        sets.append(np.unique(np.append(s[rng.random(len(s)) < 0.97], rng.integers(0, 1 << 62, max(1, len(s) // 30)).astype(np.uint64))))
    tile = rng.integers(0, 60, len(sets))
    order = np.lexsort(([len(s) for s in sets], tile))
    sets, tile = [sets[k] for k in order], np.unique(tile[order], return_inverse=True)[1]
    n, node, group, rank = np.array([len(s) for s in sets]), np.arange(len(sets)) + 1000, rng.integers(0, 200, len(sets)), rng.integers(0, 3, len(sets))
    maps = [jaccard.folded(np.frombuffer(jaccard.bitmap(s), np.uint8)[None], jaccard.narrow_bytes(len(s))).tobytes() for s in sets]
    data, at = np.frombuffer(b"".join(maps), np.uint8), np.append(0, np.cumsum([len(m) for m in maps]))
    one = [jaccard.tile_pairs(n[t], node[t], group[t], rank[t], [maps[k] for k in t], 75) for t in (np.flatnonzero(tile == k) for k in range(tile[-1] + 1))]
    want = np.unique(np.concatenate(one), axis=0)
    assert len(want) > 100
    before, jaccard.PAIRS = jaccard.PAIRS, 50
    try:
        assert np.array_equal(np.unique(jaccard.small_tiles(tile, n, node, group, rank, data, at, 75), axis=0), want)
        near = jaccard.small_tiles(tile, n, node, group, rank, data, at, 75, closest=True)
    finally:
        jaccard.PAIRS = before
    assert {tuple(p) for p in near.tolist()} <= {tuple(p) for p in want.tolist()}
    assert set(near.ravel().tolist()) == set(want.ravel().tolist())
