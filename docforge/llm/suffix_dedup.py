"""Byte-level dedup on suffix arrays made by external induced sorting.

Windows meet by anchor (see ``anchors``); what equal contents leave open goes to shards, all spans of an anchor in one.
A shard has at most twice ``SHARD`` bytes: anchors with more are parted by longer ones.
Spans that share little more than their anchor are left out (see ``met``). The others are joined to one text,
its suffixes are sorted with their common prefixes (see ``induced``), and suffixes with a window's length in common are one group: its members in later documents are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import anchors, induced
from docforge.llm import textkernel as K
from docforge.llm.workspace import Workspace

#: Bytes in a duplicate window, and in its anchor.
SIZE, GRAM = 50, 20
#: Bytes of a shard before it is closed, and of the spans of one anchor.
SHARD = 2_000_000


def as_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def repeats(contents: list[bytes], docs: np.ndarray, size: int = SIZE, memory: int = 1 << 20) -> np.ndarray:
    """For the contents joined with a separator after each: at which places windows begin that a smaller document has too."""
    lengths = np.array([len(c) for c in contents], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    text = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8).astype(np.int16) + 1
    text[begin + lengths] = 0
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    whole = np.arange(len(text)) + size <= (begin + lengths)[owner]  # a group with a separator in it is no match
    gone = np.zeros(len(text), bool)
    held: list[np.ndarray] = []  # the group that may go on in the next chunk

    def settle(places: np.ndarray, fresh: np.ndarray) -> None:
        shared = ~fresh  # groups of one settle nothing
        shared[:-1] |= ~fresh[1:]
        places, fresh = places[shared], fresh[shared]
        if len(places):
            doc = docs[owner[places]]
            least = np.minimum.reduceat(doc, np.flatnonzero(fresh))
            gone[places[(doc > least[np.cumsum(fresh) - 1]) & whole[places]]] = True

    for places, shared in induced.suffix_order(text, size, memory):
        fresh = shared < size
        at = np.flatnonzero(fresh)
        if not len(at):
            held.append(places)
            continue
        head = np.concatenate([*held, places[: at[0]]])
        if len(head):
            settle(head, np.arange(len(head)) == 0)
        if len(at) > 1:
            settle(places[at[0] : at[-1]], fresh[at[0] : at[-1]])
        held = [places[at[-1] :]]
    if held:
        last = np.concatenate(held)
        settle(last, np.arange(len(last)) == 0)
    return gone


def met(data: np.ndarray, at: np.ndarray, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which spans may have a window of another document's span; ``at``: where each begins in ``data`` (one more than spans).

    Equal windows have their anchor at the same place, so with it they share the half of the other bytes that stands
    before it, or that after it. Spans whose key is not the hash of an anchor of ``GRAM`` bytes are all kept.
    """
    acc, n, half = K.prefix_hash(data), len(keys), (SIZE - GRAM) // 2
    start = at[:-1, None] + np.arange(SIZE - GRAM + 1)
    hit = K.span_hash(acc, start, start + GRAM) == keys.view(np.uint64)[:, None]
    anchor, keep = at[:-1] + hit.argmax(1), ~hit.any(1)
    for rows, begin in ((np.flatnonzero(anchor - at[:-1] >= half), anchor - half), (np.flatnonzero(anchor + GRAM + half <= at[1:]), anchor)):
        if len(rows):
            h = K.span_hash(acc, begin[rows], begin[rows] + GRAM + half)
            order = np.lexsort((docs[rows], h))
            h, own = h[order], rows[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            last = np.append(first[1:], len(h)) - 1
            keep[own[np.repeat(docs[own[first]] != docs[own[last]], last - first + 1)]] = True
    return keep


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        keep = met(*K.flat(rows.column(4)), rows.column(0).to_numpy(), rows.column(1).to_numpy())
        rows = rows.filter(pa.array(keep))
        if not len(rows):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in schema.types], schema=schema)
        docs, starts = (rows.column(k).to_numpy().astype(np.int64) for k in (1, 2))
        contents = rows.column(4).to_pylist()
        gone = np.append(repeats(contents, docs), False)
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
        first, end = edge[::2], edge[1::2]
        begin = np.append(0, np.cumsum([len(c) + 1 for c in contents[:-1]])).astype(np.int64)
        own = np.searchsorted(begin, first, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(docs[own]), pa.array((starts[own] + first - begin[own]).astype(np.int32)), pa.array((end - first).astype(np.int32))], schema=schema)

    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        at = K.flat(batch.column(4))[1] + np.arange(len(keys) + 1)
        heads = np.flatnonzero(np.append(keys[0] != last, keys[1:] != keys[:-1]))
        begin = 0
        for head in heads.tolist():
            # a shard ends where a key does
            if size + at[head] - at[begin] > SHARD:
                held.append(batch.slice(begin, head - begin))
                held = [h for h in held if len(h)]
                if held:
                    yield done(held)
                held, size, begin = [], 0, head
        held.append(batch.slice(begin))
        size += int(at[-1] - at[begin])
        last = keys[-1]
    held = [h for h in held if len(h)]
    if held:
        yield done(held)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _keeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        for a, b, part, offs in K.chunks(data, offsets):
            gone = anchors.covered(offs, batch.column(2).slice(a, b - a), SIZE)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inside = offs[:-1][offs[:-1] < len(gone)]
            begins[inside] = gone[inside]  # runs never cross texts
            removed = anchors.per_text(offs, gone)
            kept = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.append(0, np.cumsum(np.diff(offs) - removed)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(part[~gone]))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offs)), pa.array(removed.astype(np.int64)), pa.array(anchors.per_text(offs, begins).astype(np.int64)), kept.cast(pa.binary())], schema=_OUT)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary: removal may cut a character).

    A byte goes if a string of ``SIZE`` bytes over it also starts in a document with a smaller id; strings are judged on
    the input and never cross documents. Shorter, empty and null texts lose nothing. A null id is not compared. Rows of a
    repeated id count as one document: what is found in one goes from each, as far as it reaches. Other columns are
    ignored; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "suffixes")
    found = anchors.repeated_windows(docs, work, as_bytes, SIZE, GRAM, False, _shards, SHARD)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, "doc_id", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_keeper, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
