"""External induced suffix sorting with common-prefix values.

The sorted S* suffixes (an S-type character after an L-type one) induce the order of all L-type suffixes, those
that of all S-type ones. An extracted suffix i pushes suffix i - 1, which begins with an own character, so the priority
queue is a queue for each character: pushes come in order, and characters are taken in order. The queues keep a
bounded part in memory and the rest on disk. Tuples carry the common prefix with the one before them: that of two
pushed suffixes is one more than the least value between the two that pushed them. Values stop at ``cap``.

S* suffixes are sorted recursively: their substrings get names by content, and the string of names is sorted in turn.
"""

from __future__ import annotations

import tempfile

import numpy as np

from docforge.llm import textkernel as K


class DiskQueue:
    """First in, first out; beyond ``memory`` entries whole chunks go to an unnamed file."""

    def __init__(self, memory: int):
        self.memory, self.held, self.count, self.file, self.runs = memory, [], 0, None, []

    def push(self, places: np.ndarray, shared: np.ndarray) -> None:
        self.held.append((places, shared))
        self.count += len(places)
        if self.count > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            places, shared = (np.concatenate(x) for x in zip(*self.held))
            self.file.seek(0, 2)
            self.runs.append((self.file.tell(), len(places)))
            self.file.write(places.astype(np.int64).tobytes())
            self.file.write(shared.astype(np.uint8).tobytes())
            self.held, self.count = [], 0

    def chunks(self):
        """What was pushed so far, in order, removed from the queue; a chunk at a time."""
        runs, self.runs = self.runs, []
        held, self.held, self.count = self.held, [], 0
        for at, n in runs:
            self.file.seek(at)
            yield np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(n), np.uint8)
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))

    def __bool__(self) -> bool:
        return bool(self.runs or self.held)


def types(text: np.ndarray) -> np.ndarray:
    """True for S-type places: the suffix is smaller than the next one. The end of the text is smaller than all."""
    step = np.sign(np.diff(text.astype(np.int64), append=-1))
    known = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(known[::-1])[::-1]
    return step[following] > 0


def _range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[start:end] for many non-empty ranges."""
    width = end - start
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.zeros(len(start), values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[start[at]], table[end[at] - (1 << k)])
    return out


class _Inducer:
    """One direction of induction: queues by character, and for each the least common prefix since its last push."""

    def __init__(self, text: np.ndarray, is_s: np.ndarray, want_s: bool, cap: int, memory: int):
        self.text, self.is_s, self.want_s, self.cap = text, is_s, want_s, cap
        alphabet = int(text.max(initial=0)) + 1
        self.queues = [DiskQueue(memory) for _ in range(alphabet)]
        self.least = np.zeros(alphabet, np.int64)

    def take(self, places: np.ndarray, shared: np.ndarray) -> None:
        """Suffixes in order; ``shared`` is what each has in common with the one taken before."""
        shared = shared.astype(np.int64)
        ok = np.flatnonzero(places > 0)
        ok = ok[self.is_s[places[ok] - 1] == self.want_s]
        before = places[ok] - 1
        chars = self.text[before]
        order = np.argsort(chars, kind="stable")
        at, chars, before = ok[order], chars[order], before[order]
        new = np.flatnonzero(np.append(True, chars[1:] != chars[:-1])) if len(at) else np.zeros(0, np.int64)
        start = np.zeros(len(at), np.int64)
        start[1:] = at[:-1] + 1
        start[new] = 0
        value = _range_min(shared, start, at + 1) if len(at) else shared[:0]
        value[new] = np.minimum(value[new], self.least[chars[new]])
        seen = np.unique(chars)
        ends = np.append(new[1:], len(at))
        self.least = np.minimum(self.least, shared.min(initial=self.cap))
        for c, a, b in zip(seen.tolist(), new.tolist(), ends.tolist()):
            self.queues[c].push(before[a:b], np.minimum(value[a:b] + 1, self.cap).astype(np.uint8))
            tail = shared[at[b - 1] + 1 :]
            self.least[c] = min(int(tail.min(initial=self.cap)), self.cap)


def _names(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the S* substrings (each up to the next S*), equal ones alike."""
    ends = np.append(stars[1:] + 1, len(text))
    symbol = text.astype(np.uint64) * np.uint64(2) + is_s.astype(np.uint64) + np.uint64(1)
    per, bits = 5, np.uint64(12)
    assert symbol.max(initial=0) < 4096
    names = np.zeros(len(stars), np.int64)
    open_, depth = np.arange(len(stars)), 0
    while len(open_):
        key = np.zeros(len(open_), np.uint64)
        for k in range(per):
            at = stars[open_] + depth + k
            inside = at < ends[open_]
            key = (key << bits) | np.where(inside, symbol[np.minimum(at, len(text) - 1)], np.uint64(0))
        # within equal names so far: sort by the next symbols, names become first places in the order
        order = np.lexsort((key, names[open_]))
        k, n = key[order], names[open_][order]
        fresh = np.append(True, (k[1:] != k[:-1]) | (n[1:] != n[:-1]))
        group_start = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        place = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        base = np.repeat(group_start, np.diff(np.append(group_start, len(n))))
        names[open_[order]] = n + place - base
        depth += per
        size = np.bincount(np.cumsum(fresh) - 1)
        again = np.repeat(size, size) > 1
        still = open_[order][again]
        open_ = still[stars[still] + depth < ends[still]]
    return names


def _ranks_of_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names. A name is its group's first place in the order; what is in a group with others is looked at again, twice as far each time."""
    rank, reach, n = names.copy(), 1, len(names)
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(open_):
        further = open_ + reach
        after = np.where(further < n, rank[np.minimum(further, n - 1)], -1)
        key = rank[open_] * (n + 1) + after + 1
        order = np.argsort(key)
        key, places = key[order], rank[open_[order]]
        fresh = np.append(True, key[1:] != key[:-1])
        group = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        run = np.cumsum(fresh) - 1
        open_ = open_[order]
        rank[open_] = places + np.flatnonzero(fresh)[run] - np.repeat(group, np.diff(np.append(group, len(places))))
        open_ = open_[np.bincount(run)[run] > 1]
        reach *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefixes(acc: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """What the suffixes at ``a`` and ``b`` have in common, up to ``cap``: a search by halves on hashes."""
    n, out = len(acc) - 1, np.zeros(len(a), np.int64)
    for step in (1 << k for k in range(cap.bit_length() - 1, -1, -1)):
        at = np.flatnonzero((np.maximum(a, b) + out + step <= n) & (out + step <= cap))
        x, y = a[at] + out[at], b[at] + out[at]
        out[at[K.equal_spans(acc, x, y, step)]] += step
    return out


def suffix_order(text: np.ndarray, cap: int, memory: int = 1 << 20):
    """Chunks (places, shared) of all suffixes of a text of small numbers in descending order.

    ``shared`` is what a suffix has in common with the one given before it, up to ``cap``. Only the text, its types
    and bounded parts of the queues are held.
    """
    n = len(text)
    if not n:
        return
    is_s = types(text)
    star = is_s.copy()
    star[0] = False
    star[1:] &= ~is_s[:-1]
    stars = np.flatnonzero(star)
    ordered = stars[_ranks_of_names(_names(text, is_s, stars))]
    acc = K.prefix_hash(text)
    star_shared = np.zeros(len(ordered), np.int64)
    star_shared[1:] = common_prefixes(acc, ordered[1:], ordered[:-1], cap)
    run_end = np.minimum.accumulate(np.where(np.append(text[1:] != text[:-1], True), np.arange(n), n)[::-1])[::-1] + 1
    run = lambda p: np.minimum(run_end[p] - p, cap)
    first = text[ordered]
    star_at = np.searchsorted(first, np.arange(int(text.max()) + 2))

    # L-type suffixes in ascending order; the last suffix is smaller than all that begin with its character
    down = _Inducer(text, is_s, False, cap, memory)
    sorted_l = [DiskQueue(memory) for _ in down.queues]
    if not is_s[n - 1]:
        down.queues[text[n - 1]].push(np.array([n - 1]), np.zeros(1, np.uint8))
        down.least[text[n - 1]] = 0
    for c, queue in enumerate(down.queues):
        last, head = None, True
        while queue:
            for places, shared in queue.chunks():
                shared = shared.copy()
                if head:
                    shared[0], head = 0, False
                elif last == n - 1:
                    shared[0] = min(int(shared[0]), 1)
                last = int(places[-1])
                sorted_l[c].push(places, shared)
                down.take(places, shared)
        a, b = star_at[c], star_at[c + 1]
        if b > a:
            shared = star_shared[a:b].copy()
            shared[0] = min(run(last), run(ordered[a])) if last is not None else 0
            down.take(ordered[a:b], shared)
    # S-type suffixes in descending order
    up = _Inducer(text, is_s, True, cap, memory)
    for c in range(len(up.queues) - 1, -1, -1):
        last, head, queue = None, True, up.queues[c]
        while queue:
            for places, shared in queue.chunks():
                shared = shared.copy()
                if head:
                    shared[0], head = 0, False
                last = int(places[-1])
                up.take(places, shared)
                yield places, shared
        parts = list(sorted_l[c].chunks())
        carried = None
        for places, shared in reversed(parts):
            places = places[::-1].copy()
            own = np.empty(len(shared), np.uint8)
            own[1:] = shared[:0:-1]
            own[0] = (min(run(last), run(places[0])) if last is not None else 0) if carried is None else carried
            carried = shared[0]
            last = int(places[-1])
            up.take(places, own)
            yield places, own
