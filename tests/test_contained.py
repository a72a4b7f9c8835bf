"""Contained sets of shingles against brute force, and what the plan works out."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from docforge.plans.text_queries import tables_of_contained

SIZE = 3


def expected(docs):
    classes = defaultdict(list)
    for i, t in docs.items():
        w = t.split()
        if len(w) >= SIZE:
            classes[frozenset(zip(*(w[k:] for k in range(SIZE))))].append(i)
    sets = sorted((min(ids), len(ids), grams) for grams, ids in classes.items())
    out = set()
    for a, ca, x in sets:
        for b, cb, y in sets:
            n, m = len(x & y), min(len(x), len(y))
            if a < b and 10 * n >= 9 * m:
                out.add((a, b, ca, cb, round(n / m, 6)))
    return out


def test_all_pairs_are_found_and_texts_are_split_once(session):
    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([2, 3, 12, 40, 90]))] for _ in range(40)]
    texts = []
    for ws in base:
        other = list(ws)
        other[r.randrange(len(other))] = "edited"
        texts += [ws, list(ws), other, ws[: len(ws) // 2], ws + [f"v{r.randrange(400)}" for _ in range(20)], ["same"] * 9]
    docs = {7 * i: " ".join(ws) for i, ws in enumerate(texts)}
    seen = session.sparkContext.accumulator(0)

    def words(text):
        seen.add(1)
        return text.split()

    split = F.udf(words, "array<string>").asNondeterministic()
    rows = session.createDataFrame(list(docs.items()), "doc_id long, text string").select("doc_id", split("text").alias("ws"))
    got = {tuple(x) for x in tables_of_contained(rows, SIZE).select("a", "b", "copies_a", "copies_b", "contained").collect()}
    assert got == expected(docs) and len(got) > 50
    assert seen.value == len(docs)
