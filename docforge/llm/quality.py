"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text (sizes, character and word statistics) is binned; cyclic boosting of shallow trees
learns a lookup table for each feature, then tables for the pairs of features that explain most of what is
left. A score is the logistic function of a sum of table entries, so scoring is bin search and additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import textkernel as K

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "marks", "symbols", "stops", "exclaims", "bars", "beyond_ascii",
    "lines_per_word", "distinct_words", "distinct_trigrams", "short_words", "capital_words", "marked_words", "distinct_lines",
)
#: Labelled rows that a model is fitted on at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000

_CLASSES = np.zeros(256, np.int64)
_CLASSES[[*range(97, 123)]] = 1
_CLASSES[[*range(65, 91)]] = 2
_CLASSES[[*range(48, 58)]] = 3
_CLASSES[[*b",;:'\"()-?"]] = 4
_CLASSES[[*b"#$%&*@^~<>{}[]\\/=+_`"]] = 5
_CLASSES[[*b"."]] = 6
_CLASSES[[*b"!"]] = 7
_CLASSES[[*b"|"]] = 8
_CLASSES[128:] = 9
_CLASSES[[*b" \t\n\r\x0b\x0c"]] = 10


def _distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes in each row."""
    own = np.unique(K.mix(hashes + rows.astype(K.U) * K.U(0x9E3779B97F4A7C15)), return_index=True)[1]
    return np.bincount(rows[own], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(row_of * 11 + _CLASSES[data], minlength=11 * n).reshape(n, 11)
    starts, ends, first = K.words(data, offsets, K.SPACES)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    h = K.word_hashes(data, starts, ends)
    tri, tri_row = K.windows(first, 3)
    th = h[tri] * K.U(3) + h[tri + 1] * K.U(5) + h[tri + 2] * K.U(7) if len(tri) else np.zeros(0, K.U)
    lines, line_ends, line_first = K.words(data, offsets, K.table(b"\n"))
    n_lines = np.diff(line_first)
    line_row = np.repeat(np.arange(n), n_lines)
    long = ends - starts
    head = _CLASSES[data[starts]] if len(starts) else np.zeros(0, np.int64)
    tail = _CLASSES[data[ends - 1]] if len(starts) else np.zeros(0, np.int64)
    per = lambda values: np.bincount(row, values, n) / np.maximum(words, 1)
    share = lambda k: kinds[:, k] / np.maximum(size - kinds[:, 10], 1)
    out = (
        np.log1p(size), np.log1p(words), per(long), share(1) + share(2), share(2), share(3), share(4), share(5), share(6), share(7), share(8), share(9),
        n_lines / np.maximum(words, 1), _distinct(h, row, n) / np.maximum(words, 1), _distinct(th, tri_row, n) / np.maximum(words - 2, 1),
        per(long <= 3), per(head == 2), per((tail == 5) | (tail == 7) | (tail == 8)), _distinct(K.word_hashes(data, lines, line_ends), line_row, n) / np.maximum(n_lines, 1),
    )
    return np.column_stack(out) if n else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """Bin edges, a table for each feature and for each chosen pair (on coarser bins)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for i, j, table in self.pairs:
                out += table[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values over bins of a tree that splits best first."""
    cuts, total_g, total_h = [0, len(g)], np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    part = lambda a, b: (total_g[b] - total_g[a]) ** 2 / (total_h[b] - total_h[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = part(a, m) + part(m, b) - part(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(m[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = -(total_g[b] - total_g[a]) / (total_h[b] - total_h[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four leaves: its gain and their values."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    n, m = g.shape

    def corner(c: np.ndarray) -> list[np.ndarray]:
        a, top, left, all_ = c[1:n, 1:m], c[1:n, m:], c[n:, 1:m], c[n, m]
        return [a, top - a, left - a, all_ - top - left + a]

    parts = list(zip(corner(cg), corner(ch)))
    gain = sum(x**2 / (y + ridge) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros((n, m))
    for (x, y), at in zip(parts, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        out[at] = -x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j] - cg[n, m] ** 2 / (ch[n, m] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 12, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15, ridge: float = 3.0) -> AdditiveModel:
    """Deterministic for given rows; without both classes the model is the (smoothed) share of label 1."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model = AdditiveModel(base)
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = lambda k: [np.unique(np.quantile(x[:, j], np.arange(1, k) / k)) for j in range(x.shape[1])]
    model.edges, model.pair_edges = edges(bins), edges(coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    margin = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), 3, ridge)
            table += step
            margin += step[at[j]]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(cells[i] * wide[j] + cells[j], v, wide[i] * wide[j]).reshape(wide[i], wide[j])

    g, h = slopes()
    found = sorted(((_quadrants(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(len(wide)) for j in range(i) if min(wide[i], wide[j]) > 1), reverse=True)[:n_pairs]
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for _, i, j in found]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h), ridge)[1]
            table += step
            margin += step[cells[i], cells[j]]
    return model


def held_out(id_col) -> F.Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        at = 0
        for a, b, part, offs in K.chunks(data, offsets):
            x = features(part, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])
            at += b - a


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> AdditiveModel:
    """Fit on labelled rows that are not held out, at most ``max_labelled`` of them (smallest hash of the id).

    Rows with a null label or id are left out; of several labels of one id the smallest counts.
    Without labels every text scores one half.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("y")).dropna().where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "id").select("y", "text")
    got = rows.mapInArrow(_features_of, "y double, x array<double>").toPandas()
    if not len(got):
        return AdditiveModel()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same model whatever the order of rows
    return fit(x[order], y[order])


def scorer(docs: DataFrame, model: AdditiveModel):
    """A column function from texts to scores (0 to 1); null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        data, offsets = K.flat(pa.array(texts, pa.large_string(), from_pandas=True))
        out = [shared.value.score(features(part, offs)) for _, _, part, offs in K.chunks(data, offsets)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    score = scorer(docs, train(docs, labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents that score at least ``threshold``, with their own columns."""
    return docs.where(scorer(docs, train(docs, labels))(F.col("text")) >= threshold)
