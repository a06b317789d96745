"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference (ALERGIA): the labelled strings of a format become a prefix tree with counts; states whose outgoing and
ending frequencies agree within Hoeffding's bound, and whose successors do in turn, are merged. States of one depth are
tried first, where a format's strings stand side by side: so a state has the counts of all its strings before states of
different depths are compared, and fixed prefixes, separators and lengths remain as states of their own. The result is a
probabilistic automaton for each format. A symbol that a state has not seen has a small share of its own and goes where
most strings go.

All candidates are scored: every maximal run of 16 characters or more, of any length, over the alphabet of credentials
and over parts of it, of every text, wherever it stands. A candidate's score is its log-likelihood, ending included, under
the best automaton, less that under a background of character pairs counted over the whole corpus, for each character.
Of candidates above the margin that overlap, the one with the greatest gain is a span of kind "model"; those that touch a
span of the fixed patterns are left out.

Labels: credentials.labelled(), 200 values for each of 11 formats; that is all that is fitted on a sample.

Cases: null text counts as empty. Null and repeated ids pass through, a row for each input row. Extra columns are
ignored, whatever their names. Without labels there is no automaton and no added span. A worker holds a megabyte of text
as Python objects, or one text that is longer. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces
from .credentials import ALNUM, labelled

KINDS = ["assign", "access", "hex", "model"]
#: ASCII case only: a plain ignore-case flag would also take the long s and the Kelvin sign.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same as runs of one or more, then the length test
#: What credentials are made of. A candidate is a maximal run over all of it, or over a part.
SYMBOLS = ALNUM + "+/_=.-"
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
PARTS = [re.compile(x) for x in (r"[A-Za-z0-9_-]{16,}", r"[A-Za-z0-9+/]{16,}", r"[A-Za-z0-9_.-]{16,}", r"[A-Za-z0-9]{16,}")]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the fixed patterns. Two cheap tests that cannot miss stand before the patterns."""
    found = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Automaton:
    """Transitions, and by state the counts of symbols and, last, of endings. Merged states are found by find()."""

    def __init__(self) -> None:
        self.go: list[dict[int, int]] = []
        self.uses: list[np.ndarray] = []
        self.total: list[int] = []
        self.depth: list[int] = []
        self.home: list[int] = []
        self.apart: set[tuple[int, int]] = set()  # pairs found not to agree since the last merge
        self.new(0)

    def new(self, depth: int) -> int:
        self.go.append({})
        self.uses.append(np.zeros(len(SYMBOLS) + 1, np.int32))
        self.total.append(0)
        self.depth.append(depth)
        self.home.append(len(self.home))
        return len(self.go) - 1

    def find(self, q: int) -> int:
        while self.home[q] != q:
            self.home[q] = self.home[self.home[q]]
            q = self.home[q]
        return q

    def add(self, s: str) -> None:
        q = 0
        for c in s:
            k = SYMBOLS.index(c)
            self.total[q] += 1
            self.uses[q][k] += 1
            if k not in self.go[q]:
                self.go[q][k] = self.new(self.depth[q] + 1)
            q = self.go[q][k]
        self.total[q] += 1
        self.uses[q][-1] += 1

    def agree(self, a: int, b: int, alpha: float) -> bool:
        """Frequencies of both, and of what follows by the same symbols, are within the bound."""
        todo, came = [(a, b)], {(a, b): None}
        width = math.sqrt(0.5 * math.log(2 / alpha))
        while todo:
            at = p, q = todo.pop()
            n, m = self.total[p], self.total[q]
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if at in self.apart or bound < 1 and np.abs(self.uses[p] / n - self.uses[q] / m).max() > bound:
                while at is not None:  # neither do those from which this pair was come to
                    self.apart.add(at)
                    at = came[at]
                return False
            for c in self.go[p].keys() & self.go[q].keys():
                new = self.find(self.go[p][c]), self.find(self.go[q][c])
                if new[0] != new[1] and new not in came:
                    came[new] = at
                    todo.append(new)
        return True

    def fold(self, a: int, b: int) -> None:
        """Merge b into a, and what follows both by the same symbol."""
        self.apart.clear()
        todo = [(a, b)]
        while todo:
            p, q = (self.find(x) for x in todo.pop())
            if p == q:
                continue
            self.home[q] = p
            self.total[p] += self.total[q]
            self.uses[p] = self.uses[p] + self.uses[q]
            for c, t in self.go[q].items():
                if c in self.go[p]:
                    todo.append((self.go[p][c], t))
                else:
                    self.go[p][c] = t

    def merge_states(self, alpha: float) -> Automaton:
        """Merge within each depth, then across depths; the same automaton, with fewer states."""
        level = [0]
        while level:
            here: list[int] = []
            for q in sorted({self.find(x) for x in level}, key=lambda q: (-self.total[q], q)):
                if self.find(q) != q:
                    continue
                twin = next((r for r in here if self.agree(r, q, alpha)), None)
                if twin is None:
                    here.append(q)
                else:
                    self.fold(twin, q)
            level = sorted({self.find(t) for q in here for t in self.go[q].values()})
        red = [0]
        while True:
            reds = set(red)
            blue = sorted({self.find(t) for r in red for t in self.go[r].values()} - reds, key=lambda q: (self.depth[q], q))
            if not blue:
                return self
            b = blue[0]
            twin = next((r for r in red if self.agree(r, b, alpha)), None)
            if twin is None:
                red.append(b)
            else:
                self.fold(twin, b)
                red = sorted({self.find(r) for r in red})

    def states(self) -> list[int]:
        """Those that can be reached, from the start on."""
        out, todo = [self.find(0)], [self.find(0)]
        while todo:
            for t in sorted(self.find(t) for t in self.go[todo.pop()].values()):
                if t not in out:
                    out.append(t)
                    todo.append(t)
        return out

    def tables(self, rare: float = 0.5) -> list[tuple[dict[str, tuple[float, int]], float, int, float]]:
        """By state: symbol to (log-probability, next state); the same for any other symbol; log-probability of the end. The `rare` share of one arrival is spread over all symbols and the end."""
        order = self.states()
        place = {q: k for k, q in enumerate(order)}
        out = []
        for q in order:
            n, each = self.total[q] + rare, rare / (len(SYMBOLS) + 1)
            uses = self.uses[q]
            row = {SYMBOLS[c]: (math.log((uses[c] + each) / n), place[self.find(t)]) for c, t in self.go[q].items()}
            likely = max(self.go[q], key=lambda c: (uses[c], c), default=None)
            out.append((row, math.log(each / n), place[q] if likely is None else row[SYMBOLS[likely]][1], math.log((uses[-1] + each) / n)))
        return out


@dataclass(frozen=True)
class Grammar:
    alpha: float = 0.01
    #: nats for each character by which the best automaton must beat the background
    margin: float = 0.9


@lru_cache(maxsize=4)
def infer(labels: tuple[tuple[str, str], ...], g: Grammar = Grammar()) -> dict[str, list]:
    """The automaton's tables of each format. labels: (format, value), values over SYMBOLS."""
    formats: dict[str, Automaton] = {}
    for name, value in sorted(labels):
        formats.setdefault(name, Automaton()).add(value)
    return {name: tree.merge_states(g.alpha).tables() for name, tree in formats.items()}


PLACES = np.full(256, -1, np.int64)
PLACES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))


def pair_counts(raw: bytes) -> np.ndarray:
    """How often each symbol follows each in a text, but for words of 16 or more letters, digits, "_" and "-" that hold both letters and digits, as keys do."""
    k = len(SYMBOLS)
    at = np.r_[-1, PLACES[np.frombuffer(raw, np.uint8)], -1]
    edge = np.diff(((at >= 0) & ((at < 62) | (at == SYMBOLS.index("_")) | (at == SYMBOLS.index("-")))).astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if not len(start):
        return np.zeros(k * k, np.int64)
    letters = np.r_[0, np.cumsum((at >= 0) & (at < 52))]
    digits = np.r_[0, np.cumsum((at >= 52) & (at < 62))]
    odd = (end - start >= 16) & (letters[end] > letters[start]) & (digits[end] > digits[start])
    for s, e in zip(start[odd], end[odd], strict=True):
        at[s:e] = -1
    a, b = at[:-1], at[1:]
    return np.bincount((a * k + b)[(a >= 0) & (b >= 0)], minlength=k * k)


def background(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probability of each symbol after each, from all texts of the corpus. One row for each pair reaches the driver, 4,624 at most."""
    k = len(SYMBOLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(k * k, np.int64)
        for batch in pieces(batches):
            n += pair_counts(b"\n".join(x.as_py() or b"" for x in batch.column(0)))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["pair", "n"])

    pairs = in_arrow(df.select(F.col(f"`{text_col}`").cast("binary").alias("t")), count, "pair long, n long")
    n = np.zeros(k * k)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        n[r.pair] = r.n
    n = n.reshape(k, k) + 0.05
    return np.log(n / n.sum(axis=1, keepdims=True))


def likelihood(token: str, rows: list) -> float:
    q, s = 0, 0.0
    for c in token:
        known, other, on, _ = rows[q]
        p, q = known.get(c) or (other, on)
        s += p
    return s + rows[q][3]


def score(token: str, grammars: dict[str, list], back: np.ndarray) -> float:
    """Nats for each character by which the best automaton beats the background."""
    at = PLACES[np.frombuffer(token.encode(), np.uint8)]
    ground = math.log(1 / len(SYMBOLS)) + float(back[at[:-1], at[1:]].sum())
    return (max(likelihood(token, rows) for rows in grammars.values()) - ground) / len(token)


def find(text: str, grammars: dict[str, list], back: np.ndarray, margin: float) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of all spans."""
    spans = base_spans(text)
    if not grammars:
        return spans
    held = list(spans)
    for run in RUN.finditer(text):
        places = {run.span()} | {m.span() for p in PARTS for m in p.finditer(text, *run.span())}
        gains = []
        for a, b in places:
            if all(e <= a or s >= b for s, _, e in spans) and (x := score(text[a:b], grammars, back)) > margin:
                gains.append((-x * (b - a), a, b))
        for _, a, b in sorted(gains):
            if all(e <= a or s >= b for s, k, e in held if k == 3):
                held.append((a, 3, b))
    return sorted(held)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", g: Grammar = Grammar(), labels: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: the id, the base counts, all spans as text, and the base spans as text."""
    grammars = infer(tuple(labelled() if labels is None else labels), g)
    back = background(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast((grammars, back))  # some hundred states, and 4,624 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars, back = shared.value
        for batch in pieces(batches):
            found = [find(x.as_py() or "", grammars, back, g.margin) for x in batch.column(1)]
            count = lambda k: pa.array([sum(s[1] == k for s in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), count(0), count(1), count(2), count(3), pa.array([joined([s for s in f if s[1] < 3]) for f in found], pa.string()), pa.array([joined(f) for f in found], pa.string())], names=[id_col, "n_assign", "n_access", "n_hex", "n_model", "base_spans", "spans"])

    slim = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    return in_arrow(slim, run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_model long, base_spans string, spans string")
