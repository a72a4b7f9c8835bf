"""Recursive and parent/child chunks, in bounded Arrow batches, and fixed windows of words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine, and sizes and overlaps in characters.
SEPARATORS = ("\n\n", "\n", "。", ". ", " ", "")
CHILD, CHILD_OVERLAP = 800, 120
PARENT, PARENT_OVERLAP = 2400, 200


def _cut(text: str, separator: str) -> list[str]:
    """Parts that begin with the separator, but for the first."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def split_text(text: str, size: int = CHILD, overlap: int = CHILD_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs; large parts are cut on at finer ones.

    Neighbouring small parts are joined up to ``size``; the last ones, up to ``overlap``, begin the next piece.
    Pieces are stripped; blank ones are left out.
    """
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer, out, window, width = separators[at + 1 :], [], [], 0

    def flush() -> None:
        piece = "".join(window).strip()
        if piece:
            out.append(piece)

    for part in _cut(text, separators[at]):
        if len(part) >= size and finer:
            if window:
                flush()
                window, width = [], 0
            out += split_text(part, size, overlap, finer)
            continue
        if width + len(part) > size and window:
            flush()
            while window and (width > overlap or width + len(part) > size):
                width -= len(window.pop(0))
        window.append(part)
        width += len(part)
    if window:
        flush()
    return out


def chunks_of(doc: object, text: str, nested: bool) -> list[tuple]:
    """(chunk_id, strategy, parent_chunk_id, nth, text) of a document."""
    if not nested:
        return [(f"{doc}::rec::{i}", "recursive", None, i, t) for i, t in enumerate(split_text(text))]
    out, nth = [], 0
    for p, parent in enumerate(split_text(text, PARENT, PARENT_OVERLAP)):
        name = f"{doc}::parent::{p}"
        out.append((name, "parent", None, nth, parent))
        nth += 1
        for c, child in enumerate(split_text(parent)):
            out.append((f"{name}::child::{c}", "child", name, nth, child))
            nth += 1
    return out


def chunk_documents(docs: DataFrame, nested: str = "nested") -> DataFrame:
    """(doc_id, chunk_id, strategy, parent_chunk_id, nth, text, metadata) of (doc_id, text, boolean ``nested``, others).

    All other columns travel as strings in ``metadata``. Rows need no shuffle: each document is cut where it lies.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "text", nested)]
    entries = [x for c in other for x in (F.lit(c), F.col(c).cast("string"))]
    meta = F.create_map(*entries) if entries else F.expr("cast(map() as map<string,string>)")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(nested), F.lit(False)).alias("nested"), F.to_json(meta).alias("meta"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, *c, m) for d, t, n, m in zip(pdf["doc_id"], pdf["text"], pdf["nested"], pdf["meta"]) for c in chunks_of(d, t, bool(n))]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "strategy", "parent_chunk_id", "nth", "text", "meta"])

    made = rows.mapInPandas(run, "doc_id string, chunk_id string, strategy string, parent_chunk_id string, nth int, text string, meta string")
    return made.select("doc_id", "chunk_id", "strategy", "parent_chunk_id", "nth", "text", F.from_json("meta", "map<string,string>").alias("metadata"))


def word_windows(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, nth, text): runs of ``size`` words, with built-in functions only."""
    words = F.filter(F.split(F.col(text), "[ \\n]+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(size))
    out = docs.select(key, words.alias("words")).where("size(words) > 0").select(key, "words", F.posexplode(starts).alias("nth", "at"))
    return out.select(key, "nth", F.array_join(F.slice("words", F.col("at") + 1, F.lit(size)), " ").alias("text"))
