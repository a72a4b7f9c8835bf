"""Exact, fast encoding with public tokenizer files.

The tokenizers library encodes about 1 MB/s and core. Its pre-tokenizers cut text at white space and
where a run of letters ends, so a text's ids are the ids of its pieces, one after the other. Pieces are found by vectorised
byte operations; the library encodes each distinct piece once per worker, and the ids of all pieces
are gathered from that cache. The result equals ``encode_batch`` on whole texts (tests compare them).
"""

from __future__ import annotations

import os

import numpy as np

from docforge.llm import textkernel as K

U = K.U
#: Bytes that may follow a space at a safe cut: visible ASCII, and lead bytes whose characters are never white space.
_AFTER = np.zeros(256, bool)
_AFTER[0x21:0x7F] = True
_AFTER[0xC3:0xE1] = True
_AFTER[0xE4:0xF5] = True
#: ASCII letters, and visible ASCII that is none: between the two both pre-tokenizers cut, whatever stands around.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK[0x21:0x7F] = ~_LETTER[0x21:0x7F]
#: Bytes of text encoded at once.
CHUNK = 1_000_000
#: Distinct pieces kept in a worker before the cache starts anew.
CACHE = 400_000


class PieceTable:
    """Open-addressing map from 64-bit hashes to row numbers, looked up by whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        mask = U((1 << self.bits) - 1)
        out, at, todo = np.full(len(h), -1, np.int64), h & mask, np.arange(len(h))
        while len(todo):
            rows = self.rows[at]
            hit = (rows >= 0) & (self.keys[at] == h[todo])
            out[todo[hit]] = rows[hit]
            on = (rows >= 0) & ~hit
            todo, at = todo[on], (at[on] + U(1)) & mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes that are not in the map; they get the next row numbers."""
        while (self.count + len(h)) * 2 > 1 << self.bits:
            keys, rows = self.keys[self.rows >= 0], self.rows[self.rows >= 0]
            self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int64)
            self._place(keys, rows)
        self._place(h, np.arange(self.count, self.count + len(h)))
        self.count += len(h)

    def _place(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = U((1 << self.bits) - 1)
        at = h & mask
        while len(h):
            free = self.rows[at] < 0
            self.rows[at[free]] = rows[free]  # of several for one slot the last stays
            self.keys[at[free]] = h[free]
            on = self.rows[at] != rows
            h, rows, at = h[on], rows[on], (at[on] + U(1)) & mask


class PieceEncoder:
    """kind "bytes": a byte-level vocabulary, spaces belong to the next piece; "words": white space is dropped."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.table = PieceTable()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, first piece of each row."""
        n = len(data)
        after = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
        if self.kind == "words":
            starts, ends, _ = K.words(data, offsets, K.SPACES)
            row = np.zeros(n + 1, bool)
            row[offsets] = True
            after = after[~row[after]]
            starts, ends = np.sort(np.concatenate([starts, after])), np.sort(np.concatenate([ends, after]))
            return starts, ends, np.searchsorted(starts, offsets)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            safe, white = _AFTER[data], K.SPACES[data] | (data == 0) | (data >= 0x1C) & (data <= 0x20)
            cut[: n - 1] |= (data[:-1] == 0x20) & safe[1:]
            line = np.flatnonzero(data[1:-1] == 0x0A) + 1
            solid = (data > 0x20) & (data < 0x7F) | (data >= 0xC3) & (data < 0xE1) | (data >= 0xE4)
            # a character before the line end may be of several bytes: only ASCII counts there
            line = line[(data[line - 1] > 0x20) & (data[line - 1] < 0x7F) & solid[line + 1] & ~white[line + 1]]
            cut[line] = cut[line + 1] = True
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        # a line end beside the edge of a row has its neighbour in another row
        near = np.flatnonzero(cut[:n] & (data == 0x0A)) if n else np.zeros(0, np.int64)
        bad = near[edge[near] | edge[near + 1]]
        cut[bad] = False
        cut[bad + 1] = False
        at = offsets[1:-1] - 1
        at = at[at >= 0]
        cut[at[data[at] == 0x20]] = False  # a space at the end of a row
        cut[after] = True
        cut |= edge
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n) if len(starts) else starts
        return starts, ends, np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where the ids of each row begin (one more than rows)."""
        starts, ends, first = self.pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.table.count > CACHE:
            self.clear()
        h = K.word_hashes(data, starts, ends)
        rows = self.table.find(h)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, at = np.unique(h[new], return_index=True)
            self._learn(data, starts[new[at]], ends[new[at]])
            self.table.add(fresh)
            rows[new] = self.table.find(h[new])
        lengths = self.lengths[rows]
        ids = K.gather(self.ids, self.starts[rows], lengths)
        return ids, np.append(0, np.cumsum(lengths))[first]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]
        lists: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if len(t.split()) == 1 and (self.kind == "words" or t[0] == " " and t.count(" ") == 1 and not t[1:].isspace() and t.split()[0] == t[1:])]
        join = " " if self.kind == "words" else ""
        for k in range(0, len(plain), 500):
            some = plain[k : k + 500]
            places = np.cumsum([0] + [len(texts[i]) + len(join) for i in some])
            made = self.tokenizer.encode_batch([join.join(texts[i] for i in some)], add_special_tokens=False)[0]
            ids = np.array(made.ids, np.uint32)
            begin = np.array([o[0] for o in made.offsets], np.int64)
            bounds = np.searchsorted(begin, places)
            for j, i in enumerate(some):
                lists[i] = ids[bounds[j] : bounds[j + 1]]
        other = [i for i, x in enumerate(lists) if x is None]
        for i, made in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
            lists[i] = np.array(made.ids, np.uint32)
        lengths = np.array([len(x) for x in lists], np.int64)
        values = np.concatenate(lists).astype(np.uint32)
        base = self.table.count
        self.ids = _grown(self.ids, self.used + len(values))
        self.ids[self.used : self.used + len(values)] = values
        self.starts, self.lengths = _grown(self.starts, base + len(lengths)), _grown(self.lengths, base + len(lengths))
        self.starts[base : base + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[base : base + len(lengths)] = lengths
        self.used += len(values)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file; kept while the worker lives."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]
