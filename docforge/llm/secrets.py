"""Secret scans: fixed patterns, and formats learned by grammar inference.

Labelled credentials of public formats go to a prefix tree with counts. States whose outgoing
frequencies are statistically compatible (Hoeffding bounds, also for the states that follow) are merged,
red-blue order, into a probabilistic automaton for each format. A candidate is any long run of
credential characters that has a digit and a letter. It becomes a span if some automaton generates it with
a likelihood per character that its own training strings reach, and if that likelihood is ``NEED`` nats above
the one of a background automaton, which is learned from plain runs: identifiers and words of the corpus.
In a run that is none as a whole (``NAME=credential``, a path), the automata start anew after each separator.
"""

from __future__ import annotations

import builtins
import hashlib
import math
import random
import re
import string
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm import textkernel as K

# The base patterns and the least sizes of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "format")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]{4,}){0,2}")

#: Runs with any number of dots, and where a credential may begin or end in one.
RUN = re.compile(rb"[A-Za-z0-9+/_=.-]{16,}")
SEPARATOR = re.compile(r"[=/_.+-]")

_UPPER, _LOWER, _DIGIT = string.ascii_uppercase, string.ascii_lowercase, string.digits
_ALNUM = string.ascii_letters + _DIGIT
_URL64 = _ALNUM + "-_"


def labelled_credentials(count: int = 400, seed: int = 7) -> dict[str, list[str]]:
    """Generated examples of publicly documented credential formats."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    formats = {
        "cloud_access_key": lambda: "AKIA" + some(_UPPER + _DIGIT, 16),
        "cloud_secret_key": lambda: some(_ALNUM + "+/", 40),
        "git_token": lambda: "gh" + rng.choice("pousr") + "_" + some(_ALNUM, 36),
        "chat_token": lambda: "xox" + rng.choice("bpa") + "-" + some(_DIGIT, 11) + "-" + some(_DIGIT, 11) + "-" + some(_ALNUM, 24),
        "maps_key": lambda: "AIza" + some(_URL64, 35),
        "payment_key": lambda: rng.choice(("sk", "pk", "rk")) + "_live_" + some(_ALNUM, 24),
        "web_token": lambda: "eyJ" + some(_URL64, 33) + ".eyJ" + some(_URL64, 47) + "." + some(_URL64, 43),
        "hex_digest": lambda: some(_DIGIT + "abcdef", rng.choice((32, 40, 64))),
    }
    return {name: [make() for _ in range(count)] for name, make in formats.items()}


#: Characters of a string that stand for themselves at its start; later ones stand for their class.
LITERAL = 4


def _symbol(c: str, i: int) -> str:
    if i < LITERAL and not c.isdigit() or c in "_-./+=":
        return c
    return "D" if c.isdigit() else "U" if c in _UPPER else "L" if c in _LOWER else "?"


def symbols(text: str) -> list[str]:
    """One symbol for each character; an end mark follows."""
    return [*(_symbol(c, i) for i, c in enumerate(text)), "$"]


class Automaton:
    """A probabilistic automaton: state -> symbol -> (next state, log probability)."""

    def __init__(self, arcs: dict[int, dict[str, tuple[int, float]]]):
        self.arcs = arcs
        self.least = -math.inf
        self.widths: dict[str, int] = {}  # characters of each class in its training strings
        self.shortest = self.longest = 0  # of its training strings

    def accepted_ends(self, text: str, start: int, ends: set[int], stop: int) -> list[int]:
        """Of ``ends`` those where what begins at ``start`` is accepted; none lies more than twice its longest training string away."""
        state, total, out = 0, 0.0, []
        for at in range(start, min(stop, start + 2 * self.longest) + 1):
            arcs = self.arcs.get(state, {})
            if at in ends and "$" in arcs and (total + arcs["$"][1]) / (at - start + 1) >= self.least:
                out.append(at)
            arc = arcs.get(_symbol(text[at], at - start)) if at < stop else None
            if arc is None:
                break
            state, total = arc[0], total + arc[1]
        return out

    def likelihood(self, text: str) -> float:
        """Mean log probability of its symbols; minus infinity where the automaton has no path."""
        state, total, marks = 0, 0.0, symbols(text)
        for s in marks:
            arc = self.arcs.get(state, {}).get(s)
            if arc is None:
                return -math.inf
            state, total = arc[0], total + arc[1]
        return total / len(marks)


def infer(examples: list[str], alpha: float = 0.05, margin: float = 0.1) -> Automaton:
    """State merging over the prefix tree of the examples, then likelihoods; ``least`` is the worst example's, less ``margin``."""
    children: list[dict[str, int]] = [{}]
    visits, arcs_n = [0], [{}]

    def node() -> int:
        children.append({})
        visits.append(0)
        arcs_n.append({})
        return len(children) - 1

    for text in examples:
        at = 0
        visits[0] += 1
        for s in symbols(text):
            if s not in children[at]:
                children[at][s] = node()
            arcs_n[at][s] = arcs_n[at].get(s, 0) + 1
            at = children[at][s]
            visits[at] += 1
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int) -> bool:
        bound = spread * (1 / math.sqrt(max(visits[a], 1)) + 1 / math.sqrt(max(visits[b], 1)))
        return any(abs(arcs_n[a].get(s, 0) / max(visits[a], 1) - arcs_n[b].get(s, 0) / max(visits[b], 1)) > bound for s in {*arcs_n[a], *arcs_n[b]})

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if bool(children[a]) != bool(children[b]) or differ(a, b):
                return False
            todo += [(children[a][s], children[b][s]) for s in children[a].keys() & children[b].keys()]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            visits[a] += visits[b]
            for s, n in arcs_n[b].items():
                arcs_n[a][s] = arcs_n[a].get(s, 0) + n
                if s in children[a]:
                    todo.append((children[a][s], children[b][s]))
                else:
                    children[a][s] = children[b][s]

    red = [0]
    while True:
        blue = next(((r, s, c) for r in red for s, c in sorted(children[r].items()) if c not in red), None)
        if blue is None:
            break
        r, s, c = blue
        match = next((q for q in red if q and compatible(q, c)), None)  # the root stays apart: it knows the prefix
        if match is None:
            red.append(c)
        else:
            children[r][s] = match
            fold(match, c)
    out = Automaton({q: {s: (children[q][s], math.log(n / sum(arcs_n[q].values()))) for s, n in arcs_n[q].items()} for q in red})
    out.least = min(map(out.likelihood, examples)) - margin
    seen = {(_symbol(c, i), c) for text in examples for i, c in enumerate(text)}
    out.widths = {k: sum(x == k for x, _ in seen) for k in "ULD"}
    out.shortest, out.longest = min(map(len, examples)), max(map(len, examples))
    return out


_models: dict[str, Automaton] = {}


def models() -> dict[str, Automaton]:
    """The automata of all formats; inference is deterministic. The driver makes them once and broadcasts them: their size is fixed."""
    if not _models:
        _models.update({name: infer(examples) for name, examples in labelled_credentials().items()})
    return _models


#: Nats by which a format must be likelier than plain text: the odds against a credential, about one run in a hundred thousand.
NEED = 12.0
#: The background learns from every distinct word that stands in the corpus so often at least; names are joined within groups of words by hash.
WORD_LEAST, WORD_GROUPS = 5, 256
#: Formats without a prefix of their own.
_OPEN = ("cloud_secret_key", "hex_digest")
_PLAIN = re.compile(r"[A-Za-z0-9_]{3,}")


def identifiers() -> list[str]:
    """Plain identifiers that any Python brings along: names of its modules and of what some of them define."""
    import argparse, ast, asyncio, collections, decimal, email.message, http.client, json, logging, os, socket, ssl, statistics, subprocess, tarfile, threading, unittest, urllib.request, xml.dom.minidom, zipfile  # noqa: E401

    found = {*sys.stdlib_module_names, *dir(builtins)}
    for m in (argparse, ast, asyncio, collections, decimal, email.message, http.client, json, logging, os, socket, ssl, statistics, subprocess, tarfile, threading, unittest, urllib.request, xml.dom.minidom, zipfile):
        for name, value in vars(m).items():
            found.add(name)
            if isinstance(value, type):
                found.update(vars(value))
    return sorted(n for n in found if _PLAIN.fullmatch(n))


class Background:
    """A probabilistic automaton of plain runs.

    Its states are the class of the last character (upper, lower, digit, other) and the last two letters of a word; an
    arc has the class of the next character and then the character. Counts of longer contexts are mixed with shorter ones,
    and with the chance that a character is said again, which filling text does and which rises once it did.
    """

    #: That a character comes again after another one, and after itself.
    AGAIN = (0.02, 0.5)

    def __init__(self, runs: list[str]):
        self.kinds: dict[str, Counter] = {}
        self.letters: dict[str, Counter] = {}
        for run in runs:
            for kind, to, contexts, c in self._steps(run):
                self.kinds.setdefault(kind, Counter())[to] += 1
                for x in contexts:
                    self.letters.setdefault(x, Counter())[c] += 1

    def rows(self) -> list[tuple[bool, str, str, int]]:
        """(of kinds, context, next, count): backgrounds of parts of the runs add up."""
        return [(of_kinds, x, c, n) for of_kinds, table in ((True, self.kinds), (False, self.letters)) for x, counts in table.items() for c, n in counts.items()]

    def add(self, rows) -> Background:
        for of_kinds, x, c, n in rows:
            (self.kinds if of_kinds else self.letters).setdefault(x, Counter())[c] += n
        return self

    @staticmethod
    def _steps(run: str) -> Iterator[tuple[str, str, tuple[str, ...], str]]:
        kind, word = "^", ""
        for c in run:
            to = "U" if c in _UPPER else "L" if c in _LOWER else "D" if c in _DIGIT else "O"
            # a capital behind a small letter begins a word, so do letters behind anything else
            word = word if to in "UL" and kind in "UL" and not (kind == "L" and to == "U") else ""
            last = word[-2:].rjust(2, "^") if to in "UL" else to * 2
            yield kind, to, ("2" + last, "1" + last[-1], "0" + ("a" if to in "UL" else to)), c.lower()
            word, kind = (word + c.lower() if to in "UL" else ""), to

    def log_probability(self, run: str) -> float:
        total, last, same = 0.0, "", False
        for kind, to, contexts, c in self._steps(run):
            seen = self.kinds.get(kind, Counter())
            total += math.log((seen[to] + 1) / (seen.total() + 4))
            p = 1 / (26 if to in "UL" else 10 if to == "D" else 6)
            for x in reversed(contexts):
                counts = self.letters.get(x, Counter())
                p = (counts[c] + 5 * p) / (counts.total() + 5)
            again = self.AGAIN[same]
            total += math.log((1 - again) * p + again * (c == last))
            last, same = c, c == last
        return total


def joined_runs(own: list[str], seed: int = 11) -> list[str]:
    """Words, and words joined as in names and paths, with a number now and then."""
    rng, joined = random.Random(seed), []
    for _ in range(len(own) // 2):
        parts = [rng.choice(own) for _ in range(rng.randint(2, 5))]
        joined.append(rng.choice(("", "_", "-", "/", ".")).join(p[:1].upper() + p[1:] for p in parts) + rng.choice(("", "", str(rng.randrange(10_000)))))
    return [*own, *joined]


def plain_runs(words: list[str]) -> list[str]:
    """What the background learns from without a corpus: identifiers, words, and what is joined of them."""
    return joined_runs([*identifiers(), *words])


_background: list[Background] = []


def background() -> Background:
    """The background in force; without a corpus it is that of identifiers alone."""
    if not _background:
        _background.append(Background(plain_runs([])))
    return _background[0]


def frequent_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): all frequent words of a corpus; all texts are counted, with partial counts in each task."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\b([A-Za-z]{3,20})\b"), F.lit(1))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= WORD_LEAST).select("word")


def corpus_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The frequent words of a small corpus as a list, to look at; scans do not use it."""
    return [r.word for r in frequent_words(docs, text_col).orderBy("word").toLocalIterator()]


def _group_counts(group: pa.Table) -> pa.Table:
    words = sorted(group.column("word").to_pylist())
    rows = Background(joined_runs(words, group.column("part")[0].as_py())).rows()
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.bool_(), pa.string(), pa.string(), pa.int64()))], ["of_kinds", "context", "next", "n"])


def corpus_background(docs: DataFrame, text_col: str = "text") -> Background:
    """The background of identifiers and all frequent words of a corpus.

    Words are counted and joined in Spark, in groups by hash, so the result does not hang on partitions; what goes to the
    driver are sums by context and next character, some 20,000 at most, since words have letters from A to Z only.
    """
    words = frequent_words(docs, text_col).withColumn("part", F.pmod(F.xxhash64("word"), F.lit(WORD_GROUPS)))
    counts = words.groupBy("part").applyInArrow(_group_counts, "of_kinds boolean, context string, next string, n long")
    return Background(plain_runs([])).add(map(tuple, counts.groupBy("of_kinds", "context", "next").agg(F.sum("n").alias("n")).collect()))


def ratio(name: str, text: str) -> float:
    """By how many nats a format explains a text better than the background; a class's characters are equally likely in a format."""
    machine, state, total = models()[name], 0, 0.0
    for s, c in zip(symbols(text), [*text, ""]):
        arc = machine.arcs.get(state, {}).get(s)
        if arc is None:
            return -math.inf
        state, total = arc[0], total + arc[1] - (math.log(machine.widths.get(s, 1)) if s in "ULD" else 0.0)
    return total - background().log_probability(text)


def _plausible(name: str, text: str) -> bool:
    """Whether a text has a digit and a letter and is likelier a credential than plain text."""
    return any(c in _DIGIT for c in text) and any(c in _ALNUM[:52] for c in text) and ratio(name, text) >= NEED


def format_of(text: str) -> str | None:
    """The likeliest format that accepts the text, if any does."""
    if not (any(c in _DIGIT for c in text) and any(c in _ALNUM[:52] for c in text)):
        return None
    best: tuple[float, str] | None = None
    for name, machine in models().items():
        score = machine.likelihood(text)
        if score >= machine.least and _plausible(name, text):
            best = max(best or (-math.inf, ""), (score, name))
    return best and best[1]


def glued_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Credentials inside a run that begin and end at its separators and meet none of the ``taken`` spans.

    Formats with a prefix come before the open ones, which need the length of a training string here; of one start
    the longest is taken, then the search goes on behind it.
    """
    cuts = [m.span() for m in SEPARATOR.finditer(text)]
    starts, ends, out = [0, *(e for _, e in cuts)], {*(s for s, _ in cuts), len(text)}, []
    for open_ in (False, True):
        machines = [(name, m) for name, m in models().items() if (name in _OPEN) == open_]
        done = 0
        for start in starts:
            held = [*taken, *out]
            if start < done or any(s <= start < e for s, e in held):
                continue
            stop = min((s for s, _ in held if s > start), default=len(text))
            found = [e for name, m in machines for e in m.accepted_ends(text, start, ends, stop) if e - start >= (m.shortest if open_ else 16) and _plausible(name, text[start:e])]
            if found:
                done = max(found)
                out.append((start, done))
    return out


def secret_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, sorted by start and kind; base spans, then formats that meet none of them."""
    out: list[tuple[int, int, str]] = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw.decode("utf-8", "replace")) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw.decode("utf-8", "replace")) if m.end() - m.start() >= LEAST["access"]]
    points = None if raw.isascii() else np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    chars = lambda at: at if points is None else int(points[at])
    out += [(chars(m.start()), chars(m.end()), "hex") for m in HEX.finditer(raw)]
    base = list(out)
    for run in RUN.finditer(raw):
        text = run[0].decode()
        if not any(c in _DIGIT for c in text):
            continue
        found = [m.span() for m in CANDIDATE.finditer(run[0]) if format_of(m[0].decode())]
        for s, e in [*found, *glued_spans(text, found)]:
            start, end = chars(run.start() + s), chars(run.start() + e)
            if not any(start < e and s < end for s, e, _ in base):
                out.append((start, end, "format"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


_ARROW = pa.schema([("row_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _models.update(shared.value[0])
        _background[:] = [shared.value[1]]
        for batch in batches:
            data, offsets = K.flat(batch.column(1))
            at = 0
            for a, b, part, offs in K.chunks(data, offsets):
                raw, rows = part.tobytes(), []
                for i in range(b - a):
                    spans = secret_spans(raw[offs[i] : offs[i + 1]])
                    base = [x for x in spans if x[2] != "format"]
                    rows.append((*(sum(x[2] == k for x in spans) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, b - a), *(pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types[1:]))], schema=_ARROW)
                at += b - a

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row_id, n_assign, n_access, n_hex, n_format, base_sha256, spans (``kind:start:end``, comma-joined).

    Spans are code points, end exclusive. Null and empty texts have none (an empty string, and its digest).
    Kinds may overlap each other; of one kind spans do not. Repeated rows each get their row. The texts are read twice:
    once for the words of the background, once for the scan.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    plain = corpus_background(docs, text_col)
    return rows.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast((models(), plain))), "row_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def report(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs).withColumnRenamed("row_id", "doc_id")
