"""Anchored windows: how repeated passages of unrelated documents meet without comparing documents.

Every window of ``size`` elements (words or bytes) has an anchor: its k-gram with the smallest hash. Equal windows
have equal anchors at equal places, so windows need to meet only by anchor. Neighbouring windows mostly share
their anchor and travel as one span. Spans of equal content are settled by their hash alone; only the first of
each content goes on, and only where its anchor has several contents, which may overlap in part. Frequent anchors are
salted by content, frequent contents by document. Anchors whose open spans are too many for one task are parted by longer
anchors, in the end by whole windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import textkernel as K
from docforge.llm.workspace import Workspace

U = K.U
#: Frequent anchors are looked for in one of ``SAMPLED`` documents: more than one in ``FREQUENT`` of their spans, and more than ``LEAST``.
#: They are dealt to ``SALT`` tasks. This routes rows only; results do not depend on it.
SAMPLED, FREQUENT, LEAST, SALT = 64, 10_000, 50, 64


def spans(values: np.ndarray, first: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """For spans of windows with one anchor: row, first element, number of windows, hash of the anchor, hash of the span's elements."""
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.astype(U), none.astype(U)
    acc = K.prefix_hash(values)
    at = np.arange(n - gram + 1)
    low, where = K.span_hash(acc, at, at + gram), at.astype(np.int32)
    wide, reach = 1, size - gram + 1
    while wide < reach:
        shift = min(wide, reach - wide)
        later = low[shift:] < low[:-shift]
        low, where = np.where(later, low[shift:], low[:-shift]), np.where(later, where[shift:], where[:-shift])
        wide += shift
    windows, row = K.windows(first, size)
    anchor = where[windows]
    begin = np.ones(len(windows), bool)
    begin[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(begin)
    count = np.diff(np.append(at, len(windows)))
    start = windows[at]
    return row[at], start, count, low[start], K.span_hash(acc, start, start + count + size - 1)


# A content is told from others of its anchor by its whole hash of 64 bits: a frequent anchor has as many contents as contexts.
#: (bytes, offsets) of texts to their elements: values, and each row's first (one more than rows).
Elements = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

_ROW = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_ROW_SQL = "key long, content long, doc_id long, start int, n int"


def _scanner(elements: Elements, size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b, part, offs in K.chunks(data, offsets):
                values, first = elements(part, offs)
                row, start, n, key, content = spans(values, first, size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[a:b][row]), pa.array((start - first[row]).astype(np.int32)), pa.array(n.astype(np.int32))], schema=_ROW)

    return run


def _settler(own: bool, salted: np.ndarray):
    """Of spans sorted by key, content, doc_id and start: kind 0, repeats of a content; kind 1, spans that another content of the key may still cover.

    ``own``: a repeat within the first one's document counts too. ``salted`` keys have rows in other tasks, so they count
    as keys with several contents.
    """
    schema = pa.schema([*_ROW, ("kind", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content_key = content = first_doc = None
        waiting: pa.RecordBatch | None = None  # spans of the last key while it has one content only
        for batch in batches:
            keys, contents, docs = (batch.column(k).to_numpy() for k in range(3))
            if not len(keys):
                continue
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (contents[1:] != contents[:-1])
            fresh[0] = (keys[0], contents[0]) != (content_key, content)
            # the document of each content's first span
            at = np.flatnonzero(fresh)
            run_of = np.cumsum(fresh) - 1
            firsts = docs[at] if len(at) else docs[:0]
            lead = np.where(run_of >= 0, firsts[np.maximum(run_of, 0)] if len(at) else 0, first_doc if first_doc is not None else 0)
            repeat = ~fresh if own else docs > lead
            # keys with several contents; the first key of the batch may go on from the last
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            several = (np.add.reduceat(fresh.astype(np.int64), starts) > 1) | np.isin(keys[starts], salted)
            goes_on = content_key is not None and keys[0] == content_key
            if goes_on and (waiting is None or fresh[: starts[1] if len(starts) > 1 else len(keys)].any()):
                several[0] = True
            if waiting is not None:
                if goes_on and several[0]:
                    yield _told(waiting, 1, schema)
                if not goes_on or several[0]:
                    waiting = None
            lengths = np.diff(np.append(starts, len(keys)))
            open_ = np.repeat(several, lengths) & ~repeat
            picked = np.flatnonzero(repeat)
            if len(picked):
                yield _told(batch.take(pa.array(picked)), 0, schema)
            picked = np.flatnonzero(open_)
            if len(picked):
                yield _told(batch.take(pa.array(picked)), 1, schema)
            if several[-1]:
                waiting = None
            else:
                tail = batch.take(pa.array(np.flatnonzero(~repeat[starts[-1] :]) + starts[-1]))
                waiting = pa.concat_batches([waiting, tail]) if waiting is not None and len(starts) == 1 and goes_on else tail
            content_key, content, first_doc = keys[-1], contents[-1], int(lead[-1])

    return run


def _told(batch: pa.RecordBatch, kind: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), kind, np.int8))], schema=schema)


def _parter(elements: Elements, size: int, gram: int):
    """(doc_id, text, spans of start, n): the windows of the spans by their anchors of ``gram`` elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b, part, offs in K.chunks(data, offsets):
                values, first = elements(part, offs)
                asked = batch.column(2).slice(a, b - a)
                own = np.repeat(np.arange(b - a), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
                start, n = (asked.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
                fits = first[own] + start + n + size - 1 <= first[own + 1]  # of a repeated id another text may be meant
                own, start, n = own[fits], start[fits], n[fits]
                cut = np.append(0, np.cumsum(n + size - 1))
                row, at, count, key, content = spans(K.gather(values, first[own] + start, n + size - 1), cut, size, gram)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[a:b][own[row]]), pa.array((start[row] + at - cut[row]).astype(np.int32)), pa.array(count.astype(np.int32))], schema=_ROW)

    return run


def _cutter(elements: Elements, size: int):
    """(doc_id, text, spans of key, start, n): each span with its elements (uint8 or uint64, as bytes)."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("elements", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            ids, asked = batch.column(0).to_pylist(), batch.column(2)
            for a, b, part, offs in K.chunks(data, offsets):
                values, first = elements(part, offs)
                rows = []
                for i in range(a, b):
                    base, end = int(first[i - a]), int(first[i - a + 1])
                    for x in asked[i].as_py():
                        at = base + x["start"]
                        if at + x["n"] + size - 1 <= end:  # of a repeated id another text may be meant
                            rows.append((x["key"], ids[i], x["start"], x["n"], values[at : at + x["n"] + size - 1].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _frequent(sample: DataFrame, work: Workspace) -> dict[int, list[int]]:
    """Frequent keys of sampled spans with those of their contents that are frequent themselves; at most ``FREQUENT`` of each."""
    pairs = sample.groupBy("key", "content").agg(F.count("*").alias("n"))
    many = F.when(F.col("n") >= LEAST, F.struct("n", "content"))
    keys = work.save(pairs.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(many).alias("contents")), "sampled")
    bound = max((keys.agg(F.sum("n").alias("n")).first()["n"] or 0) / FREQUENT, LEAST)
    return {r["key"]: [c["content"] for c in r["contents"] if c["n"] > bound] for r in keys.where(F.col("n") > bound).collect()}


def _dealt(met: DataFrame, frequent: dict[int, list[int]]) -> DataFrame:
    """Spans by key; those of frequent keys by key and content, those of frequent contents by key and document."""
    if not frequent:
        return met.repartition("key")
    table = F.broadcast(met.sparkSession.createDataFrame(list(frequent.items()), "key long, contents array<long>"))
    by = F.when(F.array_contains("contents", F.col("content")), F.col("doc_id")).otherwise(F.col("content"))
    salt = F.when(F.col("contents").isNotNull(), F.pmod(F.xxhash64(by), F.lit(SALT))).otherwise(F.lit(0))
    return met.join(table, "key", "left").withColumn("salt", salt).repartition("key", "salt").select(*_ROW.names)


def repeated_windows(docs: DataFrame, work: Workspace, elements: Elements, size: int, gram: int, own: bool, resolve, most: int) -> DataFrame:
    """(doc_id, spans): for each document the runs of windows (start, n) that stand earlier too.

    ``own``: also earlier in the same document; else in a document with a smaller id only. ``resolve`` is a function
    for mapInArrow from (key, doc_id, start, n, elements), sorted by key, doc_id and start, with all spans of a key in one
    task, to (doc_id, start, n). ``most``: elements in the spans of a key; keys with more are parted.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def settled(dealt: DataFrame, name: str, salted: list[int] = ()) -> DataFrame:
        return work.save(dealt.sortWithinPartitions("key", "content", "doc_id", "start").mapInArrow(_settler(own, np.array(salted, np.int64)), f"{_ROW_SQL}, kind byte"), name)

    scan = _scanner(elements, size, gram)
    frequent = _frequent(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(scan, _ROW_SQL), work)
    told = settled(_dealt(rows.mapInArrow(scan, _ROW_SQL), frequent), "settled", list(frequent))
    repeats, asked = told.where("kind = 0").select("doc_id", "start", "n"), []
    for longer in ((gram + size) // 2, size):
        open_ = told.where("kind = 1")
        large = work.save(open_.groupBy("key").agg(F.sum(F.col("n") + F.lit(size - 1)).alias("held")).where(F.col("held") > most).select("key"), f"large-{longer}")
        if large.isEmpty():
            break
        asked.append(open_.join(large, "key", "left_anti"))
        parted = open_.join(large, "key", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
        told = settled(rows.join(parted, "doc_id").select("doc_id", "text", "asked").mapInArrow(_parter(elements, size, longer), _ROW_SQL).repartition("key"), f"parted-{longer}")
        repeats = repeats.union(told.where("kind = 0").select("doc_id", "start", "n"))
    for part in asked:
        told = told.unionByName(part)  # a join puts its key first
    asked = told.where("kind = 1").groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n")).alias("asked"))
    cut = rows.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_cutter(elements, size), "key long, doc_id long, start int, n int, elements binary")
    found = work.save(cut.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(resolve, "doc_id long, start int, n int"), "resolved")
    return repeats.union(found).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def covered(first: np.ndarray, found: pa.Array, size: int) -> np.ndarray:
    """Which elements of some texts lie in one of their repeated windows. ``first``: each text's first element (one more than texts)."""
    n = int(first[-1])
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    own = found.flatten()
    if not len(own):
        return np.zeros(n, bool)
    lengths = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start, count = (own.field(k).to_numpy().astype(np.int64) for k in (0, 1))
    start = np.minimum(first[row] + start, first[row + 1])
    return K.covered(n, start, np.minimum(start + count + size - 1, first[row + 1]))


def per_text(first: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    return np.diff(np.append(0, np.cumsum(flags))[first])
