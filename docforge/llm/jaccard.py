"""Exact n-gram Jaccard join: size-banded tiles, bitmap signatures, sorted-array intersection.

A node is a distinct set of word shingles (hashed to 64 bits); exact copies share a node. Two sets with
similarity t share one of their rarest (1 - t) n + 1 elements in any fixed order, so nodes meet in tiles,
one for each such element. Within a tile nodes stand by size and only meet nodes of their size band.
Bitmaps of parities (whether a place is met an odd number of times) bound the overlap from above; pairs that may still be
similar are intersected exactly.

Rounds keep large groups of near copies linear. First, in the tiles of each node's first few shared elements, nodes are
compared with their neighbours by size and with the node that most documents share. Then, twice, each node of a
tile is compared with the closest (by bitmap) of another group there. Each round joins what links, and a tile within
one group costs nothing any more. At last all pairs of *different* groups that share a tile are compared, so no link
between groups is missed. Shingles frequent in many tasks come last in the order, so passages shared by many documents
make no tiles unless documents consist of them. That order changes the work only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.llm import textkernel as K
from docforge.llm.components import components
from docforge.llm.workspace import Workspace

U = K.U
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)
#: Shared elements (a node's first ones) whose tiles the first round uses, and those that compare the closest.
FIRST, NEXT = 2, 8
#: Least bytes of the narrow bitmaps that stand in tiles; pairs that pass are held against the full ones.
NARROW = 64
#: Rows of a tile up to which it is compared together with other tiles, and pairs and bytes of bitmaps held at once for that.
SMALL, PAIRS, HELD = 64, 500_000, 1 << 24
#: Shingles moved to the end of the order at most (the most frequent ones); it bounds what is broadcast.
HEAVY = 100_000


def shingle_hashes(first: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk and where each row's begin; a row with fewer words has one of all its words."""
    counts = np.diff(first)
    full = np.zeros(max(len(h) - size + 1, 0), U)
    for k in range(size):
        full += h[k : k + len(full)] * _MULTIPLIERS[k]
    full = K.mix(full)
    out, bounds = [], [0]
    for row in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        part = h[first[row] : first[row + 1]]
        out.append((row, K.mix(np.array([(part * _MULTIPLIERS[: len(part)]).sum() + U(len(part))], U))))
    short = dict(out)
    pieces = []
    for row, n in enumerate(counts.tolist()):
        part = full[first[row] : first[row] + n - size + 1] if n >= size else short.get(row, np.zeros(0, U))
        pieces.append(part)
        bounds.append(bounds[-1] + len(part))
    return (np.concatenate(pieces) if pieces else np.zeros(0, U)), np.array(bounds)


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; A-Z are lower-cased."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, K.SPACES)
    hashes, bounds = shingle_hashes(first, K.word_hashes(data, starts, ends), size)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def node_of(elements: np.ndarray) -> int:
    """A 64-bit id of a set."""
    return int(K.mix(K.mix(elements ^ U(0x5851F42D4C957F2D)).sum(keepdims=True) + U(len(elements)))[0].astype(np.int64))


def bits_for(n: int) -> int:
    """Width of a bitmap: a power of two, at least four bits for each element, so nearly equal within a size band."""
    return max(64, 1 << int(4 * n - 1).bit_length())


def bitmap(elements: np.ndarray) -> bytes:
    """Parities: an element that two sets do not share turns one bit over, so maps differ in no more bits than sets do in elements."""
    width = bits_for(len(elements))
    met = np.bincount(((elements >> U(7)) & U(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((met & 1).astype(bool)).tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) at a smaller width: the parities of that width."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def narrow_bytes(n: int) -> int:
    """Bytes of a narrow bitmap: a power of two, at least four bits for five elements.

    Maps of unrelated sets differ in half their bits. Similar sets may differ in (1 - t) / (1 + t) of all their
    elements: for t = 0.75 in a third of the smaller one's n, so a map of fewer than 2 / 3 n bits parts nothing.
    """
    return max(NARROW, 1 << (-(-n // 10) - 1).bit_length())


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        data, offsets = K.flat(batch.column(1))
        ids = batch.column(0).to_pylist()
        for a, b, part, offs in K.chunks(data, offsets):
            yield from zip(ids[a:b], sets(part, offs, size))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


_SIGNS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bitmap", pa.binary())])


def _signer(size: int, least: int = 3):
    """kind 0: a document's set size and node, with the bitmap once for each node and task; kind 1: shingles of several nodes of the task and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rows, held, recent = [], [], 0
        counts: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U), np.zeros(0, np.int64))

        def counted() -> tuple[np.ndarray, np.ndarray]:
            values, at = np.unique(np.concatenate([counts[0], *held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts[1], np.ones(recent)]), len(values)).astype(np.int64)
            return values[n > 1], n[n > 1]  # what was met once may be lost: the order is a matter of speed

        for doc, s in _texts(batches, size):
            node = node_of(s) if len(s) else 0
            fresh = len(s) > 0 and node not in seen
            rows.append((0, doc, len(s), node, bitmap(s) if fresh else None))
            if fresh:
                seen.add(node)
                held.append(s)
                recent += len(s)
            if recent > 2_000_000:
                counts, held, recent = counted(), [], 0
            if len(rows) >= 5000:
                yield _out(rows, _SIGNS)
                rows = []
        values, n = counted()
        rows += [(1, None, c, v, None) for v, c in zip(values[n >= least].astype(np.int64).tolist(), n[n >= least].tolist())]
        for k in range(0, len(rows), 50_000):
            yield _out(rows[k : k + 50_000], _SIGNS)

    return run


_KEYS = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("rank", pa.int32())])


def _keyer(size: int, percent: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, parts, rows = heavy.value, set(), [], 0
        order = np.argsort(last)
        by = last[order]
        for _, s in _texts(batches, size):
            n = len(s)
            node = node_of(s) if n else 0
            if not n or node in seen:
                continue
            seen.add(node)
            v = s >> U(2)
            if len(by):
                at = np.searchsorted(by, s)
                at[at == len(by)] = 0
                v = np.where(by[at] == s, (U(1) << U(62)) + order[at].astype(U), v)
            prefix = n - -(-percent * n // 100) + 1
            v = np.sort(v)[:prefix].astype(np.int64)
            parts.append((v, n, node))
            rows += len(v)
            if rows > 200_000:
                yield _key_batch(parts)
                parts, rows = [], 0
        if parts:
            yield _key_batch(parts)

    return run


def _key_batch(parts: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
    lengths = [len(p[0]) for p in parts]
    n, node = (np.repeat(np.array([p[k] for p in parts], np.int64), lengths) for k in (1, 2))
    rank = K.runs_to_ranges(np.array(lengths))[1]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in parts])), pa.array(n.astype(np.int32)), pa.array(node), pa.array(rank.astype(np.int32))], schema=_KEYS)


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, n and node: those of keys with several nodes, each node once."""
    before: pa.RecordBatch | None = None  # the last row, not yet given out; and whether its key is shared
    before_shared = False
    for batch in batches:
        if before is not None:
            batch = pa.concat_batches([before, batch])
        key, node = (batch.column(k).to_numpy() for k in (0, 2))
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        at = np.flatnonzero(keep)
        k = key[at]
        same = k[1:] == k[:-1]
        shared = np.zeros(len(k), bool)
        shared[1:] |= same
        shared[:-1] |= same
        if before_shared and before is not None:
            shared[0] = True
        before, before_shared = batch.slice(int(at[-1]), 1), bool(shared[-1])
        done = at[:-1][shared[:-1]]
        if len(done):
            yield batch.take(pa.array(done))
    if before is not None and before_shared:
        yield before


def _neighbours(percent: int):
    """Of rows (key, n, node, copies) sorted by key, n and node: neighbours within a key, and each node with the key's most copied one.

    Both within a size band; at most two pairs for each row.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, hub = None, None  # the last row; the most copied row of its key so far
        for batch in batches:
            if before is not None:
                batch = pa.concat_batches([before, batch])
            key, n, node, copies = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lengths = np.diff(np.append(starts, len(key)))
            group = np.repeat(np.arange(len(starts)), lengths)
            order = np.lexsort((node, -copies, group))
            top_n, top_node, top_copies = n[order[starts]], node[order[starts]], copies[order[starts]]
            if hub is not None and hub[0] == key[0] and hub[3] > top_copies[0]:
                top_n[0], top_node[0] = hub[1], hub[2]
                top_copies[0] = hub[3]
            hub = (key[-1], top_n[-1], top_node[-1], top_copies[-1])
            near = lambda x, y: 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            pick = np.flatnonzero((key[1:] == key[:-1]) & near(n[1:], n[:-1]))
            star = np.flatnonzero(near(n, top_n[group]))
            x, y = np.concatenate([node[pick], node[star]]), np.concatenate([node[pick + 1], top_node[group[star]]])
            pairs = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)])[x != y], axis=0)
            before = batch.slice(len(key) - 1, 1)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run


def may_link(n_a: np.ndarray, n_b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap that the bitmaps' distance leaves possible reaches the similarity."""
    most = (n_a + n_b - apart) // 2
    return 100 * most >= percent * (n_a + n_b - most)


def _distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8)[None], np.frombuffer(b, np.uint8)[None]
    width = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [folded(np.frombuffer(m, np.uint8)[None], narrow_bytes(n)).tobytes() for n, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], ["node", "bitmap"])


def _bounded(percent: int):
    """Pairs (a, n_a, bitmap_a, b, n_b, bitmap_b) that may be similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([_distance(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist())], np.int64)
            n_a, n_b = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 4))
            keep = pa.array(may_link(n_a, n_b, apart, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(3).filter(keep)], schema=schema)

    return run


def distances(data: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of rows x and y differ, each pair at the smaller width; ``at``: where each row's map begins in ``data`` (one more than rows)."""
    length, out = np.diff(at), np.zeros(len(x), np.int64)
    width = np.minimum(length[x], length[y])
    for w in np.unique(width).tolist():
        pairs = np.flatnonzero(width == w)
        for k in range(0, len(pairs), max(1, HELD // w)):
            some = pairs[k : k + max(1, HELD // w)]
            rows, own = np.unique(np.concatenate([x[some], y[some]]), return_inverse=True)
            maps = np.empty((len(rows), w), np.uint8)
            for m in np.unique(length[rows]).tolist():
                wide = np.flatnonzero(length[rows] == m)
                maps[wide] = folded(data[at[rows[wide]][:, None] + np.arange(m)], w)
            maps = maps.view(U)
            out[some] = np.bitwise_count(maps[own[: len(some)]] ^ maps[own[len(some) :]]).sum(1)
    return out


def tile_pairs(n: np.ndarray, node: np.ndarray, group: np.ndarray, rank: np.ndarray, maps: list[bytes], percent: int, closest: bool = False, block: int = 128) -> np.ndarray:
    """Pairs of one tile, sorted by n, that are of different groups, within a size band and may be similar.

    ``rank``: the place of the tile's element in each node. In the tile of the first element that a pair shares, its
    overlap is at most what is left of either set from there on; a pair for which that is too little is left to that tile.
    ``closest``: only each node's nearest by bitmap, one pair for each row at most.
    """
    found = [np.zeros((0, 2), np.int64)]
    least, nearest = np.full(len(n), 1 << 40), np.full(len(n), -1)
    n, left_over = n.astype(np.int64), n.astype(np.int64) - rank
    data, at = np.frombuffer(b"".join(maps), np.uint8), np.append(0, np.cumsum([len(m) for m in maps]))
    low = np.searchsorted(n, -(-percent * n // 100))  # first row that is large enough for each
    for i in range(0, len(n), block):
        mine = slice(i, min(i + block, len(n)))
        for j in range(int(low[i]), mine.stop, block):
            other = slice(j, min(j + block, mine.stop))
            most = np.minimum(left_over[mine, None], left_over[None, other])
            ask = ((100 + percent) * most >= percent * (n[mine, None] + n[None, other])) & (group[mine, None] != group[None, other]) & (100 * n[None, other] >= percent * n[mine, None]) & (np.arange(mine.start, mine.stop)[:, None] > np.arange(other.start, other.stop)[None])
            x, y = np.nonzero(ask)
            if not len(x):
                continue
            x, y = x + mine.start, y + other.start
            apart = distances(data, at, x, y)
            ok = may_link(n[x], n[y], apart, percent)
            x, y, apart = x[ok], y[ok], apart[ok]
            if not closest:
                found.append(np.column_stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]))
                continue
            for p, q in ((x, y), (y, x)):
                order = np.lexsort((apart, p))
                p, q, d = p[order], q[order], apart[order]
                head = np.append(True, p[1:] != p[:-1]) if len(p) else np.zeros(0, bool)
                p, q, d = p[head], q[head], d[head]
                better = d < least[p]
                least[p[better]], nearest[p[better]] = d[better], q[better]
    if closest:
        p = np.flatnonzero(nearest >= 0)
        found.append(np.column_stack([np.minimum(node[p], node[nearest[p]]), np.maximum(node[p], node[nearest[p]])]))
    return np.concatenate(found)


def small_tiles(tile: np.ndarray, n: np.ndarray, node: np.ndarray, group: np.ndarray, rank: np.ndarray, data: np.ndarray, at: np.ndarray, percent: int, closest: bool = False) -> np.ndarray:
    """As ``tile_pairs``, of many tiles at once; rows are sorted by tile (from 0) and n."""
    n = n.astype(np.int64)
    left_over, wide = n - rank, int(n.max(initial=0)) + 1
    low = np.searchsorted(tile * wide + n, tile * wide + -(-percent * n // 100))
    many = np.cumsum(np.arange(len(n)) - low)
    found, begin = [np.zeros((0, 2), np.int64)], 0
    nearest: list[np.ndarray] = []  # row, distance, the other row
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + PAIRS, "right")))
        x, place = K.runs_to_ranges(np.arange(begin, end) - low[begin:end])
        x += begin
        y, begin = low[x] + place, end
        most = np.minimum(left_over[x], left_over[y])
        ask = (group[x] != group[y]) & ((100 + percent) * most >= percent * (n[x] + n[y]))
        x, y = x[ask], y[ask]
        apart = distances(data, at, x, y)
        ok = may_link(n[x], n[y], apart, percent)
        x, y, apart = x[ok], y[ok], apart[ok]
        if closest:
            nearest += [np.column_stack([x, apart, y]), np.column_stack([y, apart, x])]
        else:
            found.append(np.column_stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]))
    if nearest:
        p, d, q = np.concatenate(nearest).T
        order = np.lexsort((d, p))
        p, q = p[order], q[order]
        head = np.append(True, p[1:] != p[:-1]) if len(p) else np.zeros(0, bool)
        p, q = p[head], q[head]
        found.append(np.column_stack([np.minimum(node[p], node[q]), np.maximum(node[p], node[q])]))
    return np.concatenate(found)


def _across(percent: int, closest: bool):
    """Of rows (key, n, node, group, rank, bitmap) sorted by key and n: the tiles' pairs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        key, n, node, group, rank = (t.column(k).to_numpy() for k in range(5))
        data, at = K.flat(t.column(5))
        cuts = np.flatnonzero(np.append(True, np.append(key[1:] != key[:-1], True)))
        rows = np.diff(cuts)
        out = []
        for a, b in zip(cuts[:-1][rows > SMALL].tolist(), cuts[1:][rows > SMALL].tolist()):
            maps = [data[s:e].tobytes() for s, e in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist())]
            out.append(tile_pairs(n[a:b], node[a:b], group[a:b], rank[a:b], maps, percent, closest))
        own = np.flatnonzero(np.repeat(rows <= SMALL, rows))
        tile, length = np.repeat(np.arange(len(rows)), rows)[own], np.diff(at)[own]
        out.append(small_tiles(tile, n[own], node[own], group[own], rank[own], K.gather(data, at[own], length), np.append(0, np.cumsum(length)), percent, closest))
        got = np.unique(np.concatenate(out), axis=0)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            at = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if at or held and held[-1].column(0)[-1].as_py() != key[-1]:
                held.append(batch.slice(0, at))
                yield from pairs([h for h in held if len(h)])
                held = []
            held.append(batch.slice(at))
        if held:
            yield from pairs(held)

    return run


def _setter(size: int):
    schema = pa.schema([("node", pa.int64()), ("elements", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for _, s in _texts(batches, size):
            rows.append((node_of(s), s.tobytes()))
            if len(rows) >= 2000:
                yield _out(rows, schema)
                rows = []
        if rows:
            yield _out(rows, schema)

    return run


def _verifier(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    return run


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than ``size`` words has one shingle.
    Null and empty texts have no shingles, link with nothing and are their own component. Documents link when
    100 * intersection >= percent * union. Rows of a repeated id each come out; as one document they share a component.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signs = work.save(rows.mapInArrow(_signer(size), "kind byte, doc_id long, n long, node long, bitmap binary"), "signs")
    members = signs.where("kind = 0").select("doc_id", "n", "node")
    maps = signs.where("kind = 0 and bitmap is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("bitmap").alias("bitmap"))
    heavy = [r["node"] for r in signs.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "node").limit(HEAVY).collect()]
    shared = spark.sparkContext.broadcast(np.array(heavy[::-1], np.int64).astype(U))

    keys = rows.mapInArrow(_keyer(size, percent, shared), "key long, n int, node long, rank int")
    keys = keys.repartition("key").sortWithinPartitions("key", "n", "node", "rank").mapInArrow(_shared_keys, "key long, n int, node long, rank int")
    # an edited copy begins with elements of its own, which make no tile: places count shared ones only
    keys = work.save(keys.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("rank")) - 1), "keys")

    copies = members.groupBy("node").agg(F.count("*").alias("copies"))
    first = keys.where(F.col("place") < FIRST).join(copies, "node").select("key", "n", "node", "copies")
    near = first.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_neighbours(percent), "a long, b long").distinct()
    side = lambda s: maps.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"bitmap_{s}"))
    near = near.join(side("a"), "a").join(side("b"), "b").select("a", "n_a", "bitmap_a", "b", "n_b", "bitmap_b").mapInArrow(_bounded(percent), "a long, b long")
    tested = work.save(near, "near-0")
    groups = work.save(components(_verified(rows, members, tested, size, percent, work, "round-0"), work, "groups-0"), "groups-0")

    narrow = work.save(maps.select("node", "n", "bitmap").mapInArrow(_narrowed, "node long, bitmap binary"), "narrow")
    for turn, closest in enumerate((True, True, False), 1):
        rows_of = keys.where(F.col("place") < NEXT) if closest else keys
        placed = rows_of.join(groups, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("group"), "rank")
        several = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
        mixed = placed.join(several, "key").join(narrow, "node").select("key", "n", "node", "group", "rank", "bitmap")
        pairs = mixed.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_across(percent, closest), "a long, b long").distinct()
        pairs = pairs.join(tested, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b").select("a", "n_a", "bitmap_a", "b", "n_b", "bitmap_b")
        pairs = work.save(pairs.mapInArrow(_bounded(percent), "a long, b long"), f"near-{turn}")
        links = _verified(rows, members, pairs, size, percent, work, f"round-{turn}")
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
        groups, tested = work.save(components(stars, work, f"groups-{turn}"), f"groups-{turn}"), tested.union(pairs)
    work.drop("keys")

    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    # repeated ids: all nodes of an id hang together; documents without one do not
    twice = members.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    final = work.save(components(stars.union(twice), work, "classes"), "classes")
    placed = members.join(final, "node", "left").withColumn("group", F.coalesce("component", "node"))
    first = placed.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("low"))
    return placed.join(first, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def _verified(rows: DataFrame, members: DataFrame, pairs: DataFrame, size: int, percent: int, work: Workspace, name: str) -> DataFrame:
    """Those of the node pairs that link; the sets of the nodes in question are made from one document each."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = members.where("n > 0").join(asked, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    made = rows.join(chosen, "doc_id").select("doc_id", "text").mapInArrow(_setter(size), "node long, elements binary")
    found = work.save(made, f"{name}-sets")  # a repeated id may bring a set twice, which only repeats a pair
    a, b = (found.select(F.col("node").alias(s), F.col("elements").alias(f"elements_{s}")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "elements_a", "elements_b")
    links = work.save(both.mapInArrow(_verifier(percent), "a long, b long"), f"{name}-links")
    work.drop(f"{name}-sets")
    return links


def first_of_class(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Documents that are the smallest id of their component, with their own columns.

    A document without an id cannot be the smallest of a component: all of them are kept, copies too.
    """
    kept = jaccard_classes(docs, size, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(kept, docs["doc_id"].cast("long") == kept["_kept"], "left_semi")
    return named.union(docs.where(docs["doc_id"].cast("long").isNull()))
