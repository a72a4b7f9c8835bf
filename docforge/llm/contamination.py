"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import textkernel as K
from docforge.llm.workspace import Workspace

#: Separators: every ASCII character but digits and, after lower-casing, letters.
SEPARATORS = K.table(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)))
_NORMAL = bytes(32 if SEPARATORS[c] else int(K.LOWER[c]) for c in range(256))
#: Bytes of benchmark text in one automaton, which takes about 400 bytes of a worker for each. A larger benchmark is split into blocks of items, each with its own scan.
BLOCK_BYTES = 1_000_000
_built: dict[str, object] = {}


def normalised(text: bytes) -> bytes:
    """Words joined by single spaces."""
    return b" ".join(text.translate(_NORMAL).split())


def item_windows(items: list[tuple[str | None, str | None]], size: int) -> dict[str, tuple[int, dict[str | None, None]]]:
    """Pattern (with a space at either end) to its number of words and its items; an item without an id is None."""
    found: dict[str, tuple[int, dict[str | None, None]]] = {}
    for item, text in items:
        words = normalised((text or "").encode()).decode("latin-1").split(" ")
        if words == [""]:
            continue
        n = min(size, len(words))
        for i in range(len(words) - n + 1):
            found.setdefault(" " + " ".join(words[i : i + n]) + " ", (n, {}))[1][item] = None
    return found


def automaton(patterns: dict[str, tuple[int, dict[str | None, None]]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for pattern, value in patterns.items():
        out.add_word(pattern, value)
    out.make_automaton()
    return out


def scan(text: bytes, machine) -> tuple[list[tuple[int, int]], set[str | None]]:
    """Merged hit ranges in words, and the items found."""
    line = " " + normalised(text).decode("latin-1") + " "
    ends, sizes, items = [], [], set()
    for end, (n, owners) in machine.iter(line):
        ends.append(end)
        sizes.append(n)
        items.update(owners)
    if not ends:
        return [], items
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(gaps, ends)  # words up to here
    ranges: list[tuple[int, int]] = []
    for start, end in sorted(zip((last - sizes).tolist(), last.tolist())):
        if ranges and start <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
        else:
            ranges.append((start, end))
    return ranges, items


_PAIRS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ARROW = pa.schema([("place", pa.int64()), ("row_id", pa.int64()), ("n_words", pa.int64()), ("item_ids", pa.list_(pa.string())), ("ranges", _PAIRS), ("spans", _PAIRS)])
_SCHEMA = "place long, row_id long, n_words long, item_ids array<string>, ranges array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>"


def _scanner(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = automaton(shared.value) if shared.value else None
        machine = _built[key]
        for batch in batches:
            data, offsets = K.flat(batch.column(2))
            at = 0
            for a, b, part, offs in K.chunks(data, offsets):
                starts, ends, first = K.words(part, offs, SEPARATORS)
                raw = part.tobytes()
                points = np.append(0, np.cumsum((part & 0xC0) != 0x80))  # code points before each byte
                items, ranges, spans = [], [], []
                for i in range(b - a):
                    text = raw[offs[i] : offs[i + 1]]
                    hit, found = scan(text, machine) if machine is not None and len(text) else ([], set())
                    items.append(sorted(found - {None}))
                    ranges.append([{"start": s, "end": e} for s, e in hit])
                    # words back to code points of the original text
                    place = lambda byte, i=i: int(points[byte] - points[offs[i]])
                    spans.append([{"start": place(starts[first[i] + s]), "end": place(ends[first[i] + e - 1])} for s, e in hit])
                columns = [batch.column(0).slice(at, b - a), batch.column(1).slice(at, b - a), pa.array(np.diff(first)), *(pa.array(x, t) for x, t in ((items, _ARROW.field(3).type), (ranges, _PAIRS), (spans, _PAIRS)))]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)
                at += b - a

    return run


def _united(name: str):
    """Sorted spans of several blocks, overlapping ones made one."""
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.array_sort(F.flatten(F.collect_list(name))),
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: row_id, n_words, n_hit, item_ids (as strings, sorted), ranges (hit words), spans (their code points).

    Texts are lower-cased (A-Z), words are runs of digits, letters and non-ASCII characters. A window is
    ``size`` consecutive words of an item, or all words of a shorter one. Null or empty texts have no
    words and no hits; items without words match nothing; an empty benchmark gives rows without hits.
    Repeated items count once; repeated document rows each get their row. Other columns are ignored.

    The benchmark's size is measured first: up to ``block_bytes`` one automaton is broadcast; beyond it the
    items go to blocks by hash, the documents are scanned once for each, and the hits are united.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks > 1:  # the places of rows are written, as they may differ when they are worked out again
        docs = Workspace(spark, "contamination").save(docs.select(F.monotonically_increasing_id().alias("_place"), F.col(id_col), F.col(text_col)), "documents")
    rows = docs.select((F.col("_place") if blocks > 1 else F.monotonically_increasing_id()).alias("place"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    parts = []
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        patterns = item_windows([tuple(r) for r in block.toLocalIterator()], size)
        parts.append(rows.mapInArrow(_scanner(spark.sparkContext.broadcast(patterns), uuid.uuid4().hex), _SCHEMA))
    out = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.groupBy("place", "row_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), _united("ranges").alias("ranges"), _united("spans").alias("spans"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return out.select("row_id", "n_words", n_hit.alias("n_hit"), "item_ids", "ranges", "spans")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of ``decontaminate`` for documents and benchmark items."""
    found = decontaminate(docs, benchmark)
    return found.select(
        F.col("row_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a hit, whole and with all their columns; all rows of an id with a hit go. Rows without an id go by their text."""
    hits = lambda rows: decontaminate(rows, benchmark).where("n_hit > 0").select(F.col("row_id").alias("_hit")).distinct()
    seen = hits(docs)
    named = docs.where("doc_id is not null").join(seen, docs["doc_id"].cast("long") == seen["_hit"], "left_anti")
    mark = F.xxhash64("text")
    nameless = docs.where("doc_id is null")
    seen = hits(nameless.select(mark.alias("doc_id"), "text"))
    return named.union(nameless.join(seen, mark == seen["_hit"], "left_anti"))
