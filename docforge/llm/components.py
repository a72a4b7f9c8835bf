"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.workspace import Workspace


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task as stars: each node with the smallest node that the task's edges lead to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in parent if root(x) != x]
    for k in range(0, len(nodes), 100_000):
        some = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["a", "b"])


def components(edges: DataFrame, work: Workspace, name: str, block: int = 1_000_000) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the smallest node it is connected with.

    Edges are made stars within tasks of about ``block`` edges first; then large-star and small-star steps run
    until nothing changes. Each step is written, so lineage stays short. Loops and repeated edges are ignored.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    got = work.save(edges, f"{name}-edges")
    # hash parts of bounded size; one part is enough for few edges
    parts = max(1, -(-got.count() // block))
    dealt = got.repartition(parts, "b") if parts > 1 else got.coalesce(1)
    stars = work.save(dealt.mapInArrow(_forest, "a long, b long").distinct(), f"{name}-step-1")
    step = 1
    while parts > 1:
        both = stars.union(stars.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a != b").distinct()
        step += 1
        fresh = work.save(small, f"{name}-step-{step}")
        mark = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        done = mark(fresh) == mark(stars)
        work.drop(f"{name}-step-{step - 1}")
        stars = fresh
        if done:
            break
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
