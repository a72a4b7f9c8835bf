"""Substring dedup of words: relative Lempel-Ziv parsing against indexed reference blocks.

Passages come in document order, grouped by anchor (see ``anchors``). Each is factored greedily against every
reference block of its group: at a place whose window is in an index, the longest match with any place of any block
is taken as a factor; windows that cross the factor's end are then looked up one by one. Factors of at least a
window's size become duplicate spans, and the passage joins the newest block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import anchors
from docforge.llm import textkernel as K
from docforge.llm.workspace import Workspace

#: Words in a duplicate window, and in its anchor.
SIZE, GRAM = 20, 5
#: Windows in one reference block, and words of the passages of one anchor: beyond these it is parted by longer anchors.
BLOCK, MOST = 100_000, 400_000


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, as they are written."""
    starts, ends, first = K.words(data, offsets, K.SPACES)
    return K.word_hashes(data, starts, ends), first


class ReferenceBlock:
    """Passages one after the other; the index gives a window's newest place, and each place the one before it."""

    def __init__(self, size: int = SIZE):
        self.size, self.index, self.before, self.words = size, {}, {}, []

    def add(self, passage: list[int], windows: list[int]) -> None:
        base = len(self.words)
        for at, h in enumerate(windows, base):
            older = self.index.get(h)
            if older is not None:
                self.before[at] = older
            self.index[h] = at
        self.words += passage
        self.words.append(-1)  # no factor crosses passages

    def longest(self, passage: list[int], i: int, window: int, best: int) -> int:
        """The longest match of the passage from ``i`` on, if it is longer than ``best``; else ``best``."""
        at, words, end = self.index.get(window), self.words, len(passage)
        n = max(best, self.size - 1)
        while at is not None and i + n < end:
            # a longer match matches the word behind the best one too
            if at + n < len(words) and words[at + n] == passage[i + n] and words[at : at + n] == passage[i : i + n]:
                n += 1
                while i + n < end and words[at + n] == passage[i + n]:
                    n += 1
                best = n
            at = self.before.get(at)
        return best


def factors(passage: list[int], windows: list[int], blocks: list[ReferenceBlock], size: int = SIZE) -> list[tuple[int, int]]:
    """Greedy factors (start, length) of at least ``size`` words, overlapping at their boundaries only."""
    out, i = [], 0
    while i < len(windows):
        best = 0
        for block in blocks:
            best = block.longest(passage, i, windows[i], best)
        if best:
            out.append((i, best))
            i += best - size + 1  # the next window crosses the factor's end
        else:
            i += 1
    return out


def _window_hashes(passage: np.ndarray, size: int) -> np.ndarray:
    acc = K.prefix_hash(passage)
    at = np.arange(len(passage) - size + 1)
    return K.span_hash(acc, at, at + size)


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
    key, blocks = None, []
    for batch in batches:
        rows = []
        for k, doc, start, _, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                key, blocks = k, [ReferenceBlock()]
            values = np.frombuffer(raw, np.uint64)
            passage, windows = values.tolist(), _window_hashes(values, SIZE).tolist()
            rows += [(doc, start + i, n - SIZE + 1) for i, n in factors(passage, windows, blocks)]
            if len(blocks[-1].index) > BLOCK:
                blocks.append(ReferenceBlock())
            blocks[-1].add(passage, windows)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _keeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        for a, b, part, offs in K.chunks(data, offsets):
            starts, ends, first = K.words(part, offs, K.SPACES)
            gone = anchors.covered(first, batch.column(2).slice(a, b - a), SIZE)
            removed = anchors.per_text(first, gone)
            # kept words one after the other, a space behind each that is not its text's last
            starts, ends = starts[~gone], ends[~gone]
            left = np.diff(first) - removed
            bounds = np.append(0, np.cumsum(left))
            room = ends - starts + 1
            room[bounds[1:][left > 0] - 1] -= 1
            at = np.append(0, np.cumsum(room))
            out = np.full(int(at[-1]), 32, np.uint8)
            row, place = K.runs_to_ranges(ends - starts)
            out[at[row] + place] = part[starts[row] + place]
            kept = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(at[bounds].astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(removed.astype(np.int64)), kept.cast(pa.string())], schema=_OUT)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window of ``SIZE`` words over it has the same words as one that starts earlier: in a document with
    a smaller id, or before in the same. Windows are judged on the input. Texts with fewer words, empty and null ones lose
    nothing. A null id is not compared. Rows of a repeated id count as one document: what is found in one goes from each,
    as far as it reaches. Other columns are ignored; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "relative-lz")
    found = anchors.repeated_windows(docs, work, words, SIZE, GRAM, True, parse, MOST)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, "doc_id", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_keeper, "doc_id long, n_words long, n_removed long, kept_text string")


def report(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
