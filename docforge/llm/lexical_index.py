"""Ranked lexical search: document-sharded CSR postings with precomputed integer impacts.

A shard is a run of documents of bounded size. It holds its terms in sorted order, and for each the places of its
documents with the impact of the term there, all as flat arrays. A search goes term at a time: each posting list is
added to a dense accumulator of the shard's documents, the best are selected, and the shards' lists are merged.

    impact = (1e9 * tf) div (1000 * tf + 8 * m), m = 25 + (75 * n * N) div L
    score = sum over the terms of the question of floor(1000 * ln((2 * N + 2) / (2 * df + 1))) * impact
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm import textkernel as K
from docforge.llm.contamination import SEPARATORS
from docforge.llm.workspace import ROW_A_GROUP, Workspace, settings

#: Bytes of text in a shard; one longer text is a shard of its own.
SHARD_BYTES = 4_000_000
#: Bytes of text split into terms at once; a longer text is cut at separators.
PIECE_BYTES = 500_000
#: A worker is handed texts of about so many bytes at once, or the next shard, however many there are in its partition.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m"}
#: Questions searched at once, and bytes of their text; more go in blocks, each with its own pass over the index.
BLOCK_QUESTIONS, BLOCK_BYTES = 4_000, 4_000_000
_RAW = pa.schema([("ids", pa.binary()), ("with_id", pa.binary()), ("lengths", pa.binary()), ("terms", pa.large_binary()), ("ends", pa.binary()), ("starts", pa.binary()), ("docs", pa.large_binary()), ("counts", pa.large_binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
_RAW_DDL = "ids binary, with_id binary, lengths binary, terms binary, ends binary, starts binary, docs binary, counts binary, n_docs long, n_terms long"
_KEPT = ["ids", "with_id", "terms", "ends", "starts", "docs"]


def _term_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word."""
    first = K.word_hashes(data, starts, ends)
    return first, K.span_hash(K.prefix_hash(data.astype(np.uint64) * np.uint64(0x1000193) + np.uint64(77)), starts, ends)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``PIECE_BYTES``; longer rows come in parts that end with a separator."""
    for first, _, part, offs in K.chunks(data, offsets, PIECE_BYTES):
        at = 0
        while len(part) - at > PIECE_BYTES:
            end = at + PIECE_BYTES
            cuts = np.flatnonzero(SEPARATORS[part[at:end]])
            while not len(cuts) and end < len(part):  # a word longer than a piece
                at_next, end = end, end + PIECE_BYTES
                cuts = np.flatnonzero(SEPARATORS[part[at_next:end]])[:1] + (at_next - at)
            if not len(cuts):
                break
            end = at + int(cuts[-1]) + 1
            yield first, part[at:end], np.array([0, end - at])
            at = end
        yield first, part[at:], offs if not at else np.array([0, len(part) - at])


def _grouped(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by word and document, and which places in it begin a word and a document of a word."""
    order = np.argsort(a, kind="stable")  # documents stand in order already
    x, y = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = x[1:] != x[:-1]
    if not np.all(fresh[1:] | (y[1:] == y[:-1])):  # two words of one hash: sort by both
        order = np.lexsort((d, b, a))
        x, y = a[order], b[order]
        fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    d = d[order]
    posting = fresh.copy()
    posting[1:] |= d[1:] != d[:-1]
    return order, fresh, posting


def _counted(row: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of a piece, each once for a document: both hashes, document, count, size, and the words themselves."""
    starts, ends, first = K.words(data, offsets, SEPARATORS)
    a, b = _term_keys(data, starts, ends)
    d = np.repeat(np.arange(row, row + len(offsets) - 1, dtype=np.int32), np.diff(first))
    order, _, posting = _grouped(a, b, d)
    places = np.flatnonzero(posting)
    counts = np.diff(np.append(places, len(a)))
    kept = order[places]
    sizes = (ends - starts)[kept]
    return a[kept], b[kept], d[kept], counts, sizes, K.gather(data, starts[kept], sizes)


def _shard(ids: list[int | None], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """CSR arrays of some documents; ``parts`` are bytes and offsets of their texts, A-Z in lower case."""
    found, row = [], 0
    for data, offsets in parts:
        found += [_counted(row + first, piece, offs) for first, piece, offs in _pieces(data, offsets)]
        row += len(offsets) - 1
    a, b, d, c, n, data = (np.concatenate(x) for x in zip(*found))
    del found
    p = np.cumsum(n) - n
    order, fresh, posting = _grouped(a, b, d)
    d, c, p, n = d[order], c[order], p[order], n[order]
    places, heads = np.flatnonzero(posting), np.flatnonzero(fresh)
    counts = np.add.reduceat(c, places) if len(places) else c  # a long text has a count in each of its pieces
    starts = np.append(np.searchsorted(places, heads), len(places))
    words = K.gather(data, p[heads], n[heads])
    # terms in the order of their bytes, so that a question finds them by bisection
    ends = np.cumsum(n[heads])
    raw = words.tobytes()
    names = [raw[e - k : e] for e, k in zip(ends.tolist(), n[heads].tolist())]
    by_name = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
    sizes = np.diff(starts)[by_name]
    lengths = np.bincount(d, weights=c, minlength=row) if len(d) else np.zeros(row)
    columns = {
        "ids": np.array([0 if i is None else i for i in ids], np.int64), "with_id": np.array([i is not None for i in ids], np.uint8), "lengths": lengths.astype(np.int64),
        "ends": np.cumsum(n[heads][by_name]).astype(np.int64), "starts": np.append(0, np.cumsum(sizes)).astype(np.int64),
        "docs": K.gather(d[places], starts[:-1][by_name], sizes).astype(np.int32), "counts": K.gather(counts, starts[:-1][by_name], sizes).astype(np.int32),
    }
    values = {k: [v.tobytes()] for k, v in columns.items()} | {"terms": [b"".join(names[i] for i in by_name.tolist())], "n_docs": [int((lengths > 0).sum())], "n_terms": [int(lengths.sum())]}
    return pa.RecordBatch.from_pydict(values, schema=_RAW)


def _building(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b, part, offs in K.chunks(data, offsets, min(K.CHUNK, shard_bytes)):
                if held and held + len(part) > shard_bytes:
                    yield _shard(ids, parts)
                    ids, parts, held = [], [], 0
                ids += names[a:b]
                parts.append((K.LOWER[part], offs))
                held += len(part)
        if ids:
            yield _shard(ids, parts)

    return run


def _weighing(n_docs: int, n_terms: int):
    """Counts of terms to impacts, which are below 2 ** 31."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lengths, docs, counts in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("lengths", "docs", "counts"))):
                n = np.frombuffer(lengths.as_py(), np.int64)
                m = 25 + (75 * n * n_docs) // max(n_terms, 1)
                tf = np.frombuffer(counts.as_py(), np.int32).astype(np.int64)
                out.append(((1_000_000_000 * tf) // (1000 * tf + 8 * m[np.frombuffer(docs.as_py(), np.int32)])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in _KEPT), pa.array(out, pa.large_binary())], [*_KEPT, "impacts"])

    return run


class LexicalIndex:
    """A written index: one row per shard, and the counts N and L of the corpus."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, work: Workspace | None = None) -> LexicalIndex:
    """Index all documents; texts are read once, counts of terms are written, then impacts from the corpus counts.

    Terms are maximal runs of digits, letters and non-ASCII characters of the whole text, A-Z in lower case. Null and
    empty texts have no term, are not counted in N and never found. Repeated rows are documents of their own, rows
    without an id are counted and found too.
    """
    work = work or Workspace(docs.sparkSession, "lexical")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with settings(docs.sparkSession, BATCHES):
        raw = work.save(rows.mapInArrow(_building(shard_bytes), _RAW_DDL), "counts", ROW_A_GROUP)
    n_docs, n_terms = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    with settings(docs.sparkSession, BATCHES):
        shards = work.save(raw.select(*_KEPT, "lengths", "counts").mapInArrow(_weighing(n_docs, n_terms), "ids binary, with_id binary, terms binary, ends binary, starts binary, docs binary, impacts binary"), "impacts", ROW_A_GROUP)
    work.drop("counts")
    return LexicalIndex(shards, n_docs, n_terms)


class _Terms:
    """The sorted terms of a shard, found by bisection."""

    def __init__(self, terms: bytes, ends: bytes):
        self.raw, self.ends = terms, np.frombuffer(ends, np.int64)

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.ends[i - 1] if i else 0 : self.ends[i]]

    def find(self, term: bytes) -> int:
        lo, hi = 0, len(self.ends)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self[mid] < term else (lo, mid)
        return lo if lo < len(self.ends) and self[lo] == term else -1


def _counting(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = asked.value, Counter()
        for batch in batches:
            for terms, ends, starts in zip(*(c.to_pylist() for c in batch.columns)):
                held, at = _Terms(terms, ends), np.frombuffer(starts, np.int64)
                for term in wanted:
                    if (i := held.find(term)) >= 0:
                        found[term] += int(at[i + 1] - at[i])
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.binary()), "df": pa.array(list(found.values()), pa.int64())})

    return run


def best(scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0 (all, if fewer), ties by ascending id, rows without an id last."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        cut = scores[some][np.argpartition(scores[some], len(some) - k)[len(some) - k]]
        some = some[scores[some] >= cut]  # with all that tie at the cut
    return some[np.lexsort((ids[some], nameless[some], -scores[some]))][:k]


def _searching(questions, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, kept = questions.value, {}
        for batch in batches:
            for ids, with_id, terms, ends, starts, docs, impacts in zip(*(c.to_pylist() for c in batch.columns)):
                ids, nameless = np.frombuffer(ids, np.int64), np.frombuffer(with_id, np.uint8) == 0
                held, at = _Terms(terms, ends), np.frombuffer(starts, np.int64)
                docs, impacts = np.frombuffer(docs, np.int32), np.frombuffer(impacts, np.int32)
                places = {t: held.find(t) for t in {t for _, q in asked for t, _ in q}}
                scores = np.zeros(len(ids), np.int64)
                for number, weighted in asked:
                    hit = False
                    for term, weight in weighted:
                        if (i := places[term]) >= 0 and weight:
                            scores[docs[at[i] : at[i + 1]]] += weight * impacts[at[i] : at[i + 1]].astype(np.int64)
                            hit = True
                    if hit:
                        top = best(scores, ids, nameless, k)
                        old = kept.get(number)
                        merged = [np.concatenate(x) for x in zip(old, (scores[top], ids[top], nameless[top]))] if old else [scores[top], ids[top], nameless[top]]
                        order = np.lexsort((merged[1], merged[2], -merged[0]))[:k]
                        kept[number] = tuple(x[order] for x in merged)
                        scores[:] = 0
        columns = [np.concatenate(x) for x in zip(*kept.values())] if kept else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        numbers = np.repeat(np.array(list(kept), np.int64), [len(v[0]) for v in kept.values()]) if kept else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"number": pa.array(numbers), "doc_id": pa.array(columns[1], mask=columns[2]), "score": pa.array(columns[0])})

    return run


def terms_of(text: str | None) -> list[bytes]:
    """Terms of one question, with repeats."""
    data, offsets = K.flat(pa.array([text or ""]))
    data = K.LOWER[data]
    starts, ends, _ = K.words(data, offsets, SEPARATORS)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _blocks(questions: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for item, text in questions.toLocalIterator():
        block.append((item, terms_of(text)))
        size += len(text or "")
        if len(block) >= BLOCK_QUESTIONS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: LexicalIndex, questions: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each question: item_id, rank (from 1, unique), doc_id, score.

    Scores are exact integers; equal ones go by ascending doc_id, rows without an id last. Questions without terms,
    or whose terms no document has, give no rows. Each row of ``questions`` is a question, repeated or not. They are
    taken to the driver in blocks (``BLOCK_QUESTIONS``, ``BLOCK_BYTES``); the index is read once for the document
    frequencies and once for the scores of a block. Each task sends its k best of a question on; the k best of all
    are written before the next block, shard by shard.
    """
    spark, shards = questions.sparkSession, index.shards
    work, outs = None, []
    for block in _blocks(questions.select(item_col, text_col)):
        asked = sorted({t for _, terms in block for t in terms})
        counted = shards.select("terms", "ends", "starts").mapInArrow(_counting(spark.sparkContext.broadcast(asked)), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        with settings(spark, BATCHES):
            df = {bytes(r.term): r.df for r in counted.collect()}
        weight = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        weighted = [(number, [(t, times * weight[t]) for t, times in Counter(terms).items() if t in weight]) for number, (_, terms) in enumerate(block)]
        found = shards.select("ids", "with_id", "terms", "ends", "starts", "docs", "impacts").mapInArrow(_searching(spark.sparkContext.broadcast([w for w in weighted if w[1]]), k), "number long, doc_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
        work = work or Workspace(spark, "lexical")
        with settings(spark, BATCHES):
            ranked = work.save(ranked, f"best{len(outs)}")
        names = spark.createDataFrame([(number, item) for number, (item, _) in enumerate(block)], f"number long, item_id {questions.schema[item_col].dataType.simpleString()}")
        outs.append(ranked.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score"))
    if not outs:
        return spark.createDataFrame([], f"item_id {questions.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long")
    out = outs[0]
    for more in outs[1:]:
        out = out.unionByName(more)
    return out


def report(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Each question's 10 best documents."""
    return search(build(docs), questions)
