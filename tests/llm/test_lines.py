import random

import pytest
from pyspark.sql import functions as F

from docforge.llm import fingerprints, lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some_lines(seed=0):
    rng = random.Random(seed)
    out = []
    for _ in range(25):
        base = "".join(rng.choices("abcdé ", k=rng.randint(15, 60))).strip()
        for _ in range(6):
            line = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(line))
                if rng.random() < 0.4:
                    line[at] = rng.choice("abcxyz")
                elif rng.random() < 0.5:
                    del line[at]
                else:
                    line.insert(at, rng.choice("abcxyz"))
            out.append("".join(line))
    rng.shuffle(out)
    return out


def test_band_distance(spark):
    rng = random.Random(4)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc"), ("abc", "xyz"), ("ab", "ba")]
    for _ in range(400):
        a = "".join(rng.choices("abc", k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        if abs(len(a) - len(b)) <= 3:
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    for tau in (1, 2, 3):
        out = df.where(F.abs(F.length("a") - F.length("b")) <= tau).select("a", "b", lines.edit_distance_band(chars("a"), chars("b"), tau).alias("d")).collect()
        for r in out:
            true = edits(r.a, r.b)
            assert (r.d == true) if true <= tau else (r.d > tau), (r, true, tau)
        kept = {(r.a, r.b) for r in df.where(lines.within(F.col("a"), F.col("b"), tau)).collect()}
        assert kept == {p for p in pairs if edits(*p) <= tau}


def brute(texts, tau=2, least=20):
    all_lines = [(i, k, x.strip(" ")) for i, t in enumerate(texts) for k, x in enumerate((t if t is not None else "").split("\n"))]
    use = [x for x in all_lines if x[2].strip()]
    out = {}
    for i, k, x in use:
        near = lambda y: x == y or min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= tau and edits(x, y) <= tau
        if any(near(y) for a, b, y in use if (a, b) < (i, k)):
            out.setdefault(i, set()).add(k)
    return out


def checked(got, texts):
    """Every line that must go goes and no other; the documents named as first have such a line."""
    gone = brute(texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i].kept_text == want, (i, t, want)
        assert got[i].n_removed == len(gone.get(i, ()))
        assert got[i].n_lines == (len(t.split("\n")) if t is not None else 0)
        assert 0 <= got[i].n_links <= got[i].n_removed and bool(got[i].first_docs) == (i in gone)
        for d in got[i].first_docs:
            assert d <= i and any(edits(x.strip(" "), y.strip(" ")) <= 2 for k in gone[i] for x in [t.split("\n")[k]] for y in texts[d].split("\n"))


def test_line_dedup_against_brute_force(spark, make):
    pool = some_lines()
    texts = ["\n".join(pool[k : k + 3]) for k in range(0, len(pool), 3)] + [None, "", "\n\n", pool[0], pool[3] + "\n" + pool[3], "short\nshort", " \t\n \t", "  " + pool[5] + "  "]
    checked({r.doc_id: r for r in lines.line_dedup(make(texts).repartition(3)).collect()}, texts)
    assert lines.line_dedup(make([])).count() == 0


def families(seed, n):
    """Lines of three kinds: one word changed anywhere, random digits in one place, one head with different ends."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aehinorst", k=rng.randint(2, 7)))
    base = [word() for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.choice((1, 1, 2))):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
        out.append("the number of this certificate is " + "".join(rng.choices("0123456789", k=rng.choice((3, 8)))) + " as printed")
        out.append("every line of this kind begins alike: " + " ".join(word() for _ in range(8)))
        near = list(rng.choice(out))
        near[rng.randrange(len(near))] = rng.choice("abc")
        out.append("".join(near))
    rng.shuffle(out)
    return out


def test_large_groups_lose_no_line(spark, make, monkeypatch):
    """Groups are parted several times when few lines count as many; nothing is missed and candidates stay few."""
    texts = families(3, 60)
    monkeypatch.setattr(lines, "SMALL", 4)
    monkeypatch.setattr(lines, "LARGE", 6)
    checked({r.doc_id: r for r in lines.line_dedup(make(texts).repartition(3)).collect()}, texts)


def test_reach(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choices("ab", k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "z"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "x string, hub string")
    for r in df.select("x", "hub", lines.reach(F.col("x"), F.col("hub")).alias("r")).collect():
        ends = [e for e in range(len(r.hub) + 1) if any(edits(r.x[:k], r.hub[:e]) <= 2 for k in range(len(r.x) + 1))]
        head = next((i for i, (p, q) in enumerate(zip(r.x, r.hub)) if p != q), min(len(r.x), len(r.hub)))
        assert (r.r.head, r.r.end) == (head, max(ends)), r


def test_frames_meet(spark):
    """Lines within two edits have a key in common that both may use, at any length."""
    rng = random.Random(2)
    rows = []
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 129, 255, 256, 257]:
        for _ in range(12):
            a = rng.choices("abcdefgh", k=n)
            b = list(a)
            for _ in range(2):
                at = rng.randint(0, len(b))
                b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"[:1]])
            if edits("".join(a), "".join(b)) <= 2:
                rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")

    def keyed(c):
        f = [x.alias(f"{c}{i}") for i, x in enumerate(lines.frames_of(F.length(c)))]
        return f, lines.segment_keys(F.col(c), F.length(c), [F.col(f"{c}{i}") for i in range(3)])

    (fa, ka), (fb, kb) = keyed("a"), keyed("b")
    for r in df.select("a", "b", *fa, *fb).select("a", "b", ka.alias("ka"), kb.alias("kb")).collect():
        assert any(x.key == y.key and not x.kind & y.kind for x in r.ka for y in r.kb), (r.a, r.b)


def test_fingerprints(spark, make, sample):
    import hashlib

    docs = make(sample).repartition(3)
    rows = {r.doc_id: r for r in fingerprints.edited_report(docs).collect()}
    assert len(rows) == len(sample)
    for i, t in enumerate(sample):
        t, after = t or "", sample[(i + 1) % len(sample)] or ""
        half = len(t) // 2
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    copy = len(sample) - 3
    assert rows[0].fingerprint == rows[copy].fingerprint and rows[0].fingerprint
    assert rows[copy].near_next > 0.9  # the next text is the same with a tail
    assert fingerprints.edited_report(make([])).count() == 0
    one = fingerprints.edited_report(make(["only one text here with a few words"])).first()
    assert one.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(0)
    words = [rng.choice("abcdefgh") + str(rng.randrange(5000)) for _ in range(6000)]
    long, part, other = " ".join(words), " ".join(words[1000:2000]), " ".join(reversed(words))
    df = spark.createDataFrame([(long, part, other)], "a string, b string, c string")
    s = {k: fingerprints.sketch(F.col(k)) for k in "abc"}
    r = df.select(fingerprints.containment(s["a"], s["b"]).alias("ab"), fingerprints.containment(s["a"], s["c"]).alias("ac"), (fingerprints.merged(s["a"], s["b"]) == s["a"]).alias("same"), F.size(s["a"]).alias("n")).first()
    assert r.ab > 0.97 and r.ac == 0 and r.same and r.n == pytest.approx(6000 / fingerprints.SCALE, rel=0.2)


def test_likeness_is_near_the_exact_one(spark, make, sample):
    """Against the exact containment of the smaller set of shingles in the other."""
    import re

    def shingles(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    texts = [t or "" for t in sample]
    errors = []
    for r in fingerprints.edited_report(make(sample)).collect():
        text, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        half = len(text) // 2
        a, b = shingles(text), shingles(text[: len(text) - half] + after[:half])
        if a and b:
            errors.append(abs(r.near_edited - len(a & b) / min(len(a), len(b))))
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.25, (sum(errors) / len(errors), max(errors))
