"""Exact nearest neighbours of a stated set of questions without all products.

Items are grouped by their nearest pivot within a batch. By the triangle inequality no item of a group is closer to a
question than the group's centre plus its radius allows, so a group is multiplied only with the questions whose k best
so far it can still improve. Products of what is left are matrix products; each task keeps k items of a question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.operators.retrieval import top_k

#: Questions that are broadcast at once; more go in blocks, each with a pass over the items.
BLOCK_QUESTIONS = 20_000
PIVOTS = 64
_SLACK = 1e-7
_RANK = {"int": "int", "bigint": "long", "string": "string"}


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as a matrix, each of length 1."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    rows = flat.reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _kept(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, keys = np.concatenate([best[0], scores]), np.concatenate([best[1], keys])
    if len(scores) > k:
        cut = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= cut)
        scores, keys = scores[at], keys[at]
    order = np.lexsort((keys, -scores))[:k]
    return scores[order], keys[order]


def _scanning(shared, k: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, questions, pivots = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = []
        low = np.full(len(numbers), -np.inf)
        made = total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, items = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            best = best or [(np.zeros(0), keys[:0])] * len(numbers)
            total += len(items) * len(numbers)
            home = np.argmax(items @ pivots.T, axis=1) if len(pivots) else np.zeros(len(items), np.int64)
            for group in np.unique(home):
                at = np.flatnonzero(home == group)
                centre = items[at].mean(axis=0)
                radius = np.sqrt(((items[at] - centre) ** 2).sum(axis=1).max())
                near = np.flatnonzero(2 * (questions @ centre + radius) - 1 + _SLACK >= low)
                if not len(near):
                    continue
                made += len(near) * len(at)
                scores = np.round(2 * (questions[near] @ items[at].T) - 1, digits)
                for i, own in zip(near.tolist(), scores):
                    close = own >= low[i]
                    if close.any():
                        best[i] = _kept(best[i], own[close], keys[at][close], k)
                        if len(best[i][0]) == k:
                            low[i] = best[i][0][-1]
        for i, (scores, keys) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_pydict({"query": pa.array([numbers[i]] * len(scores)), "key": pa.array(keys), "score": pa.array(scores), "made": pa.nulls(len(scores), pa.int64()), "total": pa.nulls(len(scores), pa.int64())})
        if total:
            yield pa.RecordBatch.from_pydict({"query": pa.nulls(1, pa.array(numbers).type), "key": pa.nulls(1, best[0][1].dtype.kind == "O" and pa.string() or pa.int64()), "score": pa.nulls(1, pa.float64()), "made": pa.array([made]), "total": pa.array([total])})

    return run


def candidates(items: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query_key: str, query_vector: str, pivots: int = PIVOTS, digits: int = 9) -> DataFrame:
    """(query, key, score, made, total): of each task the k best items of each question, and a row without a question that counts products made and all.

    The score is 1 less the squared distance of vectors of length 1, rounded to ``digits``. Vectors that are null, empty
    or of length 0 are left out; all others must have one dimension. Keys are integers or strings, repeated keys are
    items of their own. Questions go to the driver in blocks, pivots are the ``pivots`` items of smallest hash.
    """
    spark = items.sparkSession
    usable = lambda c: F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))
    rows = items.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(usable(query_vector)).select(F.col(query_key).alias("query"), F.col(query_vector).cast("array<double>").alias("v"))
    centres = rows.orderBy(F.xxhash64("v"), "v").limit(pivots).select("v").collect()
    centres = np.array([r.v for r in centres], np.float64)
    centres = centres / np.sqrt((centres * centres).sum(axis=1, keepdims=True)) if len(centres) else centres
    kind = _RANK.get(rows.schema["key"].dataType.simpleString(), "long")
    schema = f"query {asked.schema['query'].dataType.simpleString()}, key {kind}, score double, made long, total long"
    parts, block = [], []

    def scan(block: list) -> DataFrame:
        own = np.array([r.v for r in block], np.float64)
        shared = spark.sparkContext.broadcast(([r.query for r in block], own / np.sqrt((own * own).sum(axis=1, keepdims=True)), centres))
        return rows.mapInArrow(_scanning(shared, k, digits), schema)

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK_QUESTIONS:
            parts.append(scan(block))
            block = []
    if block:
        parts.append(scan(block))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nearest(found: DataFrame, k: int, query_key: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The k best of each question with their rank, of what ``candidates`` gave; ties go to the smaller key."""
    return top_k(found.where("query is not null").select(F.col("query").alias(query_key), F.col("key").alias(key), "score"), k, query_key, key)


def skipped(found: DataFrame) -> DataFrame:
    """One row: products of all pairs, and the share that was not made."""
    return found.where("query is null").agg(F.sum("total").alias("total"), (1 - F.sum("made") / F.sum("total")).alias("share"))
