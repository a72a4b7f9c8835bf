"""Best-fit packing of token pieces by bin completion.

Only piece lengths matter, and they lie between 1 and the capacity. So the planner works on counts of
lengths (at most 4096 numbers, whatever the input), and each completed bin is repeated as long as its
lengths last. Where that takes more bins than the lower bound, a branch-and-bound over completions packs the
last bins anew, then twice as many, up to all of them. The plan, a list of runs of equal bins, is bounded by the number of lengths too. Pieces get
their places by their rank among pieces of their length, which is counted in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import pretrained_tokens as T
from docforge.llm import textkernel as K
from docforge.llm.workspace import Workspace

#: Nodes of the search for one bin's completions. Beyond it the best completion so far, at first best fit, is taken.
NODES = 400
#: Bins tried in the search over bins. Beyond it the best plan so far, at first that of completions taken once, stands.
BINS = 10_000


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of bins: Martello and Toth's L2, over all thresholds."""
    sizes, half = np.arange(len(counts)), capacity // 2
    total, number = np.cumsum(counts * sizes), np.cumsum(counts)
    k = np.arange(1, half + 1)
    large, middle = number[-1] - number[capacity - k], number[capacity - k] - number[half]
    room = capacity * middle - (total[capacity - k] - total[half])
    small = total[half] - total[k - 1]
    return int(max(-(-total[-1] // capacity), (large + middle + np.maximum(0, -(-(small - room) // capacity))).max(initial=0)))


def completion(counts: np.ndarray, present: np.ndarray, room: int, nodes: int = NODES) -> list[int]:
    """Lengths that fill ``room`` best, largest first, from ``counts``.

    Depth-first over fillings, the largest fitting length first, so the first leaf is the best-fit one and the
    incumbent. A filling is dominated when a length that still fits is left out; one that fits inside a single
    length wastes no less than that length alone. Fillings whose waste cannot drop below the incumbent's, even with
    all that is left of the smaller lengths, are pruned. Ties go to fewer, larger lengths: small ones are easier to place
    later. The search ends at no waste.
    """
    best: tuple[int, list[int]] = (room + 1, [])
    seen, mass = 0, np.append(0, np.cumsum(present * counts[present]))

    def down(room: int, most: int, chosen: list[int]) -> bool:
        nonlocal best, seen
        seen += 1
        at = int(np.searchsorted(present, min(room, most), "right")) - 1
        fits = False
        if room - int(mass[at + 1]) >= best[0]:
            return False
        while at >= 0:
            size = int(present[at])
            if room - int(mass[at + 1]) >= best[0]:
                return False
            if counts[size] > chosen.count(size):
                fits = True
                if down(room - size, size, [*chosen, size]):
                    return True
                if seen >= nodes:
                    return True
            at -= 1
        if not fits and (room, len(chosen)) < (best[0], len(best[1]) or 1 << 30):
            best = (room, chosen)
        return best[0] == 0

    down(room, room, [])
    return best[1]


def fillings(counts: np.ndarray, room: int, nodes: int = NODES) -> list[list[int]]:
    """Fillings of ``room`` that leave out nothing that fits, by waste and then by number of lengths."""
    present, out, seen = np.flatnonzero(counts), [], 0

    def down(room: int, most: int, chosen: list[int]) -> None:
        nonlocal seen
        seen += 1
        least = next((int(x) for x in present if counts[x] > chosen.count(x)), room + 1)
        if least > room:
            out.append((room, len(chosen), chosen))
        for size in present[: np.searchsorted(present, min(room, most), "right")][::-1].tolist():
            if seen >= nodes:
                return
            if counts[size] > chosen.count(size):
                down(room - size, size, [*chosen, size])

    down(room, room, [])
    return [x[2] for x in sorted(out)]


def search(counts: np.ndarray, capacity: int, most: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    """Bins for all of ``counts``, ``most`` of them at most, or None if there is no such plan or ``nodes`` bins were tried; and how many were.

    Depth-first: each bin takes the largest length left and one of its completions, the least waste first; a branch
    ends where the lower bound of what is left goes beyond ``most``.
    """
    counts, bins, seen = counts.copy(), [], 0

    def options() -> Iterator[list[int]]:
        largest = int(np.flatnonzero(counts)[-1])
        left = counts.copy()
        left[largest] -= 1
        room = capacity - largest
        first = completion(left, np.flatnonzero(left), room)
        yield [largest, *first]
        yield from ([largest, *x] for x in fillings(left, room) if x != first)

    stack = [options()]
    while stack:
        fill = next(stack[-1], None)
        if fill is None:
            stack.pop()
            if bins:
                np.add.at(counts, bins.pop(), 1)
            continue
        if seen >= nodes:
            break
        seen += 1
        np.subtract.at(counts, fill, 1)
        bins.append(fill)
        if len(bins) + waste_bound(counts, capacity) > most:
            np.add.at(counts, bins.pop(), 1)
        elif not counts.any():
            return bins, seen
        else:
            stack.append(options())
    return None, seen


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Runs of equal bins: the best completion of the largest length left, as often as its lengths last."""
    counts = counts.astype(np.int64).copy()
    out = []
    while counts.any():
        present = np.flatnonzero(counts)
        largest = int(present[-1])
        counts[largest] -= 1
        fill = [largest, *completion(counts, present[counts[present] > 0], capacity - largest)]
        counts[largest] += 1
        sizes, need = np.unique(fill, return_counts=True)
        repeat = int((counts[sizes] // need).min())
        counts[sizes] -= need * repeat
        out.append((fill, repeat))
    return out


def plan(counts: np.ndarray, capacity: int, nodes: int = BINS) -> list[tuple[list[int], int]]:
    """Runs of equal bins: (lengths, how many bins), using all of ``counts``."""
    counts = counts.astype(np.int64)
    runs, bound, tail = best_fit(counts, capacity), waste_bound(counts, capacity), 8
    while sum(r for _, r in runs) > bound and nodes > 0:
        head, rest, n = list(runs), np.zeros_like(counts), 0
        while head and n < tail:
            fill, repeat = head.pop()
            take = min(repeat, tail - n)
            np.add.at(rest, fill, take)
            n += take
            if take < repeat:
                head.append((fill, repeat - take))
        found, seen = search(rest, capacity, n - 1, -(-nodes // 4) if head else nodes)
        nodes -= seen
        if found is not None:
            runs = [*head, *((fill, 1) for fill in found)]
        elif not head:
            break
        else:
            tail *= 2
    return runs


def slots(runs: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the runs that take it: first rank, pieces for each bin, first bin, first place in it."""
    at: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for fill, repeat in runs:
        offset, k = 0, 0
        while k < len(fill):
            size = fill[k]
            n = fill.count(size)  # equal lengths stand together
            rows.setdefault(size, []).append((at.get(size, 0), n, first_bin, offset))
            at[size] = at.get(size, 0) + n * repeat
            offset, k = offset + n * size, k + n
        first_bin += repeat
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in rows.items()}


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary())])


def _cutter(vocabulary: str, kind: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = T.encoder(vocabulary, kind), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            at = 0
            for a, b, part, offs in K.chunks(data, offsets, T.CHUNK):
                ids, first = encoder.encode(part, offs)
                n = np.diff(first) + 1
                row, piece = K.runs_to_ranges(-(-n // capacity))
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                # with the end id after each row's ids
                full = np.full(len(ids) + b - a, end_id, "<u4")
                full[np.arange(len(ids)) + np.repeat(np.arange(b - a), n - 1)] = ids
                begin = (first[:-1] + np.arange(b - a))[row] + start
                raw, nth = memoryview(full).cast("B"), np.zeros(len(row), np.int64)
                own = [raw[4 * s : 4 * (s + m)] for s, m in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                sizes, counts = np.unique(length, return_counts=True)
                nth[order] = np.repeat(seen[sizes], counts) + K.runs_to_ranges(counts)[1]
                seen[sizes] += counts
                docs = batch.column(0).slice(at, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(nth), pa.array([bytes(x) for x in own] if keep_ids else [None] * len(row), pa.binary())],
                    schema=_PIECES,
                )
                at += b - a

    return run


def pack(docs: DataFrame, vocabulary: str, kind: str = "words", end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (uint32, when kept), sequence_id, offset.

    A text's ids and the end id are cut into pieces of ``capacity`` where longer; null and empty texts are one piece
    with the end id. Equal lengths are interchangeable, so ties are broken by task and order within it; every row
    of a repeated id is packed. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary"
    pieces = work.save(rows.mapInArrow(_cutter(vocabulary, kind, end_id, capacity, keep_ids), schema), "pieces")
    # how many pieces of a length each task has; the first of them follows those of earlier tasks
    own = work.save(pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    base = own.selectExpr("length", "task", "sum(n) over (partition by length order by task rows unbounded preceding) - n as base")
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(sizes)), np.int64)
        for size in np.unique(sizes):
            first, each, bin0, place = places.value[int(size)]
            rows = np.flatnonzero(sizes == size)
            k = np.searchsorted(first, ranks[rows], "right") - 1
            inside = ranks[rows] - first[k]
            out[0, rows] = bin0[k] + inside // each[k]
            out[1, rows] = place[k] + inside % each[k] * size
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    where = placed("length", "rank")
    return ranked.withColumn("at", where).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Pieces and their places without the ids themselves."""
    return pack(docs, vocabulary, keep_ids=False).drop("ids")
