"""Words of a language that glues endings and particles to its words: a unigram lattice segmenter.

A model prices pieces of words in whole numbers, ``floor(1000 * ln(total / count))``. A word is cut where the prices of
its pieces add up least; on a tie the fewest pieces win, then the longest first piece, and so on. The model is learned
from the distinct words of a corpus: pieces are priced by how often they stand in words, and then, in each turn, by how
often they stand in the best cuts, so pieces that explain words stay and accidents go.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.operators.retrieval import tokens

#: Characters of a piece at most, words that a piece of several characters must stand in, pieces of a model at most, and turns.
LONGEST, LEAST, PIECES, TURNS = 8, 5, 200_000, 2
#: Characters of a word that are looked at in one lattice; longer words are cut in runs of so many.
RUN = 64
# Endings and particles that carry no content of their own.
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "에", "에서", "에게", "으로", "로", "와", "과", "도", "만", "까지", "부터", "보다", "처럼", "하고", "입니다", "합니다", "한다", "했다", "하는", "하여", "된다", "되는", "이다", "였다")


@dataclass(frozen=True)
class Model:
    """Prices of pieces; ``unknown`` is the price of a character that is no piece."""

    prices: dict[str, int]
    unknown: int
    longest: int


def best_cut(word: str, prices: dict[str, int], unknown: int, longest: int) -> tuple[int, list[str]]:
    """The price and the pieces of the cheapest cut of a word. The lattice is walked from the end, so ties are settled from the front."""
    n = len(word)
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # price, pieces, minus the length of the first piece
    for a in range(n - 1, -1, -1):
        options = []
        for size in range(1, min(longest, n - a) + 1):
            price = prices.get(word[a : a + size], unknown if size == 1 else None)
            if price is not None:
                rest = best[a + size]
                options.append((price + rest[0], 1 + rest[1], -size))
        best[a] = min(options)
    pieces, a = [], 0
    while a < n:
        pieces.append(word[a : a - best[a][2]])
        a -= best[a][2]
    return best[0][0], pieces


def _runs(word: str) -> list[str]:
    return [word[i : i + RUN] for i in range(0, len(word), RUN)]


def cut(word: str, model: Model) -> list[str]:
    return [p for run in _runs(word) for p in best_cut(run, model.prices, model.unknown, model.longest)[1]]


def word_counts(docs: DataFrame, words: Column) -> DataFrame:
    """(word, n) of all texts; the counts are summed in each task first."""
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _priced(counts: DataFrame, longest: int, least: int, most: int) -> Model:
    """A model of counted pieces (piece, n): all single characters, others from ``least`` on, the most frequent ``most``."""
    kept = counts.where((F.length("piece") == 1) | (F.col("n") >= least)).orderBy(F.desc("n"), "piece").limit(most).collect()
    total = sum(r.n for r in kept)
    price = lambda n: math.floor(1000 * math.log(total / n))
    return Model({r.piece: price(r.n) for r in kept}, price(0.5) if total else 0, longest)


def _recounting(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = shared.value, {}
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for piece in cut(word, model):
                    found[piece] = found.get(piece, 0) + 1
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    return run


def fit(words: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = PIECES, turns: int = TURNS) -> Model:
    """Learn prices from distinct words. Each counts once, so a frequent word is no piece unless it stands in others.

    All words take part; the model is bounded by ``most`` pieces, the rarest of which go first. Substrings are counted
    in the JVM with partial sums, cuts in Arrow batches. ``words`` is read ``turns`` + 1 times.
    """
    spark, words = words.sparkSession, words.select("word")
    places = F.sequence(F.lit(1), F.length("word"))
    ends = lambda a: F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - a + 1))
    within = F.flatten(F.transform(places, lambda a: F.transform(ends(a), lambda k: F.substring(F.col("word"), a, k))))
    seeds = words.where(F.length("word") > 0).select(F.explode(within).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    model = _priced(seeds, longest, least, most)
    for _ in range(turns):
        shared = spark.sparkContext.broadcast(model)
        again = words.mapInArrow(_recounting(shared), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        model = _priced(again, longest, least, most)
    return model


def pieces_of(model: Model):
    """A column function from an array of words to the array of arrays of their pieces; each distinct word of a batch is cut once."""

    @F.pandas_udf("array<array<string>>")
    def cut_all(words: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        return pd.Series([None if own is None else [known[w] if w in known else known.setdefault(w, cut(w, model)) for w in own] for own in words])

    return cut_all


def content_words(model: Model, particles: tuple[str, ...] = PARTICLES):
    """A word function for ranking and comparison: pieces of the tokens of a text, in order, without particles that follow another piece.

    It takes a text column and gives an array of strings, as ``retrieval.tokens`` does. A null or empty text has none.
    """
    cut_all, dropped = pieces_of(model), F.array(*map(F.lit, particles))

    def words(text: Column) -> Column:
        kept = lambda own: F.filter(own, lambda p, i: (i == 0) | ~F.array_contains(dropped, p))
        return F.flatten(F.transform(cut_all(tokens(text)), kept))

    return words


def _cutting(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [[best_cut(r, model.prices, model.unknown, model.longest) for r in _runs(w)] for w in batch.column(0).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([sum(c for c, _ in f) for f in found], pa.int64()), pa.array([[p for _, own in f for p in own] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "price", "pieces"])

    return run


def cut_words(counts: DataFrame, model: Model) -> DataFrame:
    """(word, n, price, pieces) of words (word, n): the cheapest cut and its price."""
    shared = counts.sparkSession.sparkContext.broadcast(model)
    return counts.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_cutting(shared), "word string, n long, price long, pieces array<string>")
