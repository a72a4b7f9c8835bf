"""Vectorised kernels on Arrow text columns: words, hashes, windows.

Texts stay UTF-8 bytes. All separators of the operators here are ASCII, so splitting bytes equals
splitting code points. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text worked on at once; one longer text is still taken whole.
CHUNK = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def table(chars: bytes) -> np.ndarray:
    """A lookup of 256 booleans, true for the given bytes."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: The separators [\x20\x09-\x0D].
SPACES = table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Lower-cases A-Z, leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 300_000)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(m, base, U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes or 64-bit values; one longer than they are."""
    power, _ = _powers_to(len(values) + 1)
    acc = np.zeros(len(values) + 1, U)
    terms = values.astype(U)
    terms += U(1)
    terms *= power[: len(values)]
    np.cumsum(terms, out=acc[1:])
    return acc


def span_hash(acc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of what ``acc`` was made from."""
    _, inverse = _powers_to(len(acc))
    h = (acc[ends] - acc[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def equal_spans(acc: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the spans of ``size`` at ``a`` and ``b`` have the same hash."""
    _, inverse = _powers_to(len(acc))
    return (acc[a + size] - acc[a]) * inverse[a] == (acc[b + size] - acc[b]) * inverse[b]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without separators, and for each row its first word (one more than rows)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def runs_to_ranges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given lengths: each element's group and its place in it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return group, np.arange(len(group)) - first[group]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of all spans, one after the other."""
    group, place = runs_to_ranges(lengths)
    return values[starts[group] + place]


def windows(first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of ``size`` words within rows, and the row of each window."""
    counts = np.maximum(np.diff(first_word) - size + 1, 0)
    row, place = runs_to_ranges(counts)
    return first_word[:-1][row] + place, row


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any span."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
