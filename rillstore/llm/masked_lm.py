"""LM scoring: masked pseudo-likelihood of a bidirectional window network, trained in numpy.

Every token of a text is predicted from the window tokens on both sides of it, and the sum of the log-probabilities is
the text's score. The network: position-weighted sum of the neighbours' embeddings, a tanh layer, and a two-step softmax
over a grid of side x side word ids (row first, then the column within the row, for which the row gates the layer).

Word ids come from counts over the whole corpus: the most frequent words have one each, all others share a row of buckets
by hash. The grid grows with the corpus: its side is a root of the number of tokens. What the network gives a bucket is
shared out among its words by their spelling: a character model (classes of bytes after the two before, from the counts
of all words without an id) gives the probability of a word among those, and a bucket is taken to hold an equal share of
that. So a score is a log-probability of strings, and a word that looks like none of the corpus costs what its letters do.

Training covers the whole corpus too. In each round every partition masks a share of its positions (by a hash of text,
place in the text and round; no place twice), trains a copy of the parameters on them, and the copies are averaged,
weighted by positions, in a tree: partial sums in a fixed number of slots on the executors, in the order of partitions,
then those on the driver (slots x the model's size).

Scores depend on the dealing of rows to partitions through training; for the same files and settings they are the same.

Cases: null and empty texts have no tokens and score 0 (mean null). Null and repeated ids pass through, a row for each
input row. Extra columns are ignored, whatever their names. An empty table gives an empty one. A worker holds 400 kB of
text, or one text that is longer, as Python objects; positions are scored 2,048 at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_arrow, most_frequent, pieces, table


@dataclass(frozen=True)
class Network:
    side: int = 16
    dim: int = 24
    window: int = 3
    rounds: int = 2
    #: share of the positions that a round masks and trains on
    mask: float = 0.1
    rate: float = 0.15
    batch: int = 2048
    slots: int = 8
    seed: int = 7

    @property
    def size(self) -> int:
        return self.side * self.side

    def sized(self, tokens: int) -> Network:
        """With the side that suits so many tokens: 68 for 15 million, 121 for 860 million, 510 for 20 trillion."""
        return replace(self, side=max(16, round(6.4 * tokens ** (1 / 7))))

    def shapes(self) -> dict[str, tuple[int, ...]]:
        s, d = self.side, self.dim
        return {"E": (self.size + 1, d), "P": (2 * self.window, d), "c": (d,), "A": (d, s), "a": (s,), "U": (s, d), "G": (s, d), "B": (d, s), "b": (s, s)}

    def start(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Small random weights; biases from the corpus counts of the ids."""
        rng = np.random.default_rng(self.seed)
        p = {k: (rng.standard_normal(v) * 0.1).astype(np.float32) for k, v in self.shapes().items()}
        p["U"] += 1
        p["P"] += 1 / np.float32(np.sqrt(2 * self.window))
        p["E"][-1] = 0
        grid = counts.reshape(self.side, self.side) + 0.5
        p["a"] = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
        p["b"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
        p["c"][:] = 0
        return p

    def pack(self, p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in self.shapes()])

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, v in self.shapes().items():
            n = int(np.prod(v))
            out[k] = flat[at : at + n].reshape(v).astype(np.float32)
            at += n
        return out

    @property
    def offsets(self) -> list[int]:
        return [o for o in range(-self.window, self.window + 1) if o]


#: Classes of bytes of the character model: the end, letters, digits, some signs, leading and following UTF-8 bytes.
CLASSES = 64


def byte_classes() -> np.ndarray:
    out = np.full(256, 53, np.int64)
    out[0x61:0x7B] = np.arange(1, 27)
    out[0x30:0x3A] = np.arange(27, 37)
    out[np.frombuffer(b"-_./:'\",()=+*#@&", np.uint8)] = np.arange(37, 53)
    out[0x80:0xC0] = 57 + np.arange(64) // 10
    out[0xC0:] = 56
    out[0xC2:0xC4] = [54, 55]
    return out


BYTE_CLASSES = byte_classes()


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words, each with its end: the cell of each byte's class after the two before, the byte (0 at an end), and where words start."""
    flat = np.frombuffer(b"\0\0" + b"\0\0".join(words) + b"\0", np.uint8)
    n = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(n + 2) - n
    of = BYTE_CLASSES[flat]
    ends = np.concatenate([[0, 1], starts + n, starts[1:] - 1])
    of[ends] = 0
    cells = of[:-2] * CLASSES * CLASSES + of[1:-1] * CLASSES + of[2:]
    keep = np.ones(len(cells), bool)
    keep[starts[1:] - 3] = False  # the second of two ends is no symbol of a word
    return cells[keep], np.where(of[2:] > 0, flat[2:], 0)[keep], np.cumsum(n + 1) - (n + 1)


class Spelling:
    """Log-probability of a word among those without an id, from counts of cells and of bytes."""

    def __init__(self, cells: np.ndarray, byte: np.ndarray, strength: float = 8.0) -> None:
        three = cells.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        two = three.sum(axis=0)
        one = two.sum(axis=0)
        p = (one + 0.5) / (one + 0.5).sum()
        p = (two + strength * p) / (two.sum(axis=1, keepdims=True) + strength)
        p = (three + strength * p) / (three.sum(axis=2, keepdims=True) + strength)
        self.cells = np.log(p).astype(np.float32).ravel()
        n = byte + 0.5
        n[0] = 1.0  # an end is alone in its class
        whole = np.bincount(np.r_[0, BYTE_CLASSES[1:]], n, minlength=CLASSES)
        self.byte = np.log(n / whole[np.r_[0, BYTE_CLASSES[1:]]]).astype(np.float32)
        self.less = 0.0

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        cells, byte, starts = spell(words)
        return np.add.reduceat(self.cells[cells].astype(np.float64) + self.byte[byte], starts) - self.less

    def without(self, words: list[bytes]) -> Spelling:
        """Words with an id are none of these: their share goes to the others."""
        share = float(np.exp(self.log_prob(words)).sum())
        self.less = float(np.log1p(-min(share, 0.999)))
        return self


@dataclass
class Words:
    """Ids of the frequent words, the count of each id, and the spelling of all others."""

    ids: dict[bytes, int]
    counts: np.ndarray
    spelling: Spelling
    net: Network


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over the whole table, ASCII letters lowered."""
    low = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.select(F.explode(F.split(low, r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, text_col: str, net: Network, sized: bool = True) -> Words:
    """What reaches the driver is bounded by the grid and by the cells of the character model."""
    spark = df.sparkSession
    words = table(word_counts(df, text_col), "lm-words")
    tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    net = net.sized(tokens) if sized else net
    rows = most_frequent(words, "word", net.size - net.side)
    ids = {w.encode(): net.side + k for k, (w, _) in enumerate(rows)}
    n = np.zeros(net.size)
    n[net.side : net.side + len(rows)] = [k for _, k in rows]
    for r in words.groupBy((F.crc32(F.col("word").cast("binary")) % net.side).alias("b")).agg(F.sum("n").alias("n")).collect():
        n[r.b] = r.n
    for w, k in rows:
        n[zlib.crc32(w.encode()) % net.side] -= k
    known = spark.sparkContext.broadcast(frozenset(ids))  # at most net.size words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(CLASSES**3 + 256)
        for batch in pieces(batches):
            some = [(w, k) for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in known.value]
            if some:
                raws, k = [w for w, _ in some], np.array([k for _, k in some], np.float64)
                cells, byte, _ = spell(raws)
                each = np.repeat(k, [len(w) + 1 for w in raws])
                got[:-256] += np.bincount(cells, each, minlength=CLASSES**3)
                got[-256:] += np.bincount(byte, each, minlength=256)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at].astype(np.int64))], names=["cell", "n"])

    cells = np.zeros(CLASSES**3 + 256)
    for r in in_arrow(words.select(F.col("word").cast("binary"), "n"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r.cell] = r.n
    drop(words)
    return Words(ids, n, Spelling(cells[:-256], cells[-256:]).without(list(ids)), net)


def token_ids(raw: bytes, ids: dict[bytes, int], side: int) -> tuple[list[int], list[bytes]]:
    """Ids of a text's words, and those of them that have none of their own."""
    out, rare = [], []
    for w in raw.lower().split():
        if (i := ids.get(w)) is None:
            i = zlib.crc32(w) % side
            rare.append(w)
        out.append(i)
    return out, rare


def lay_out(docs: list[list[int]], net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids with a margin of padding around each text; positions of tokens; the text each belongs to; its place in it."""
    pad = [net.size] * net.window
    flat: list[int] = list(pad)
    for d in docs:
        flat += d
        flat += pad
    x = np.array(flat, np.int32)
    n = np.array([len(d) for d in docs], np.int64)
    of = np.repeat(np.arange(len(docs)), n)
    return x, np.flatnonzero(x != net.size), of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def forward(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, net: Network):
    h0 = np.tile(p["c"], (len(at), 1))
    near = [x[at + o] for o in net.offsets]
    emb = [p["E"][i] for i in near]
    for k, e in enumerate(emb):
        h0 += e * p["P"][k]
    h = np.tanh(h0)
    row, col = np.divmod(x[at], net.side)
    u = h @ p["A"] + p["a"]
    u -= u.max(1, keepdims=True)
    eu = np.exp(u)
    su = eu.sum(1)
    g = h * p["U"][row] + p["G"][row]
    v = g @ p["B"] + p["b"][row]
    v -= v.max(1, keepdims=True)
    ev = np.exp(v)
    sv = ev.sum(1)
    r = np.arange(len(at))
    logp = u[r, row] - np.log(su) + v[r, col] - np.log(sv)
    return logp, (near, emb, h, row, col, eu / su[:, None], g, ev / sv[:, None])


def log_prob(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, net: Network) -> np.ndarray:
    """The first of what forward() gives, without the rest; in place, and without the shift that only an overflow needs."""
    h = p["E"][x[at + net.offsets[0]]] * p["P"][0]
    for k, o in enumerate(net.offsets[1:], 1):
        h += p["E"][x[at + o]] * p["P"][k]
    h += p["c"]
    np.tanh(h, out=h)
    row, col = np.divmod(x[at], net.side)
    r = np.arange(len(at))
    u = h @ p["A"]
    u += p["a"]
    out = u[r, row].astype(np.float64)
    h *= p["U"][row]
    h += p["G"][row]
    v = h @ p["B"]
    v += p["b"][row]
    out += v[r, col]
    with np.errstate(over="ignore"):
        for z in (u, v):
            np.exp(z, out=z)
            out -= np.log(z.sum(axis=1))
    return out if np.isfinite(out).all() else forward(p, x, at, net)[0].astype(np.float64)


def one_thread() -> None:
    """The products here are small: further threads of the matrix library would only wait for each other, and burn a core each."""
    with contextlib.suppress(OSError), open("/proc/self/maps") as f:
        for path in {line.split()[-1] for line in f if "openblas" in line}:
            library = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(library, name):
                    getattr(library, name)(1)


def train_step(p: dict[str, np.ndarray], acc: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, net: Network) -> float:
    """One adagrad step on the masked positions; their mean log-probability before it."""
    logp, (near, emb, h, row, col, pu, g, pv) = forward(p, x, at, net)
    m, r = np.float32(len(at)), np.arange(len(at))
    du, dv = pu, pv
    du[r, row] -= 1
    dv[r, col] -= 1
    du /= m
    dv /= m
    dg = dv @ p["B"].T
    dh = du @ p["A"].T + dg * p["U"][row]
    dh0 = dh * (1 - h * h)
    grads = {"A": h.T @ du, "a": du.sum(0), "B": g.T @ dv, "c": dh0.sum(0), "P": np.stack([(dh0 * e).sum(0) for e in emb])}
    hot = np.zeros((len(at), net.side), np.float32)
    hot[r, row] = 1
    grads["G"], grads["U"], grads["b"] = hot.T @ dg, hot.T @ (dg * h), hot.T @ dv
    for k, d in grads.items():
        acc[k] += d * d
        p[k] -= net.rate * d / np.sqrt(acc[k])
    every = np.concatenate(near)
    parts = np.concatenate([dh0 * p["P"][k] for k in range(len(near))])
    order = np.argsort(every, kind="stable")
    every = every[order]
    cut = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    d = np.add.reduceat(parts[order], cut, axis=0)
    i = every[cut]
    acc["E"][i] += d * d
    p["E"][i] -= net.rate * d / np.sqrt(acc["E"][i])
    p["E"][-1] = 0
    return float(logp.mean())


def _groups(batches: Iterator[pa.RecordBatch], most: int = 400_000) -> Iterator[tuple[list, list[bytes]]]:
    keys, raws, size = [], [], 0
    for batch in pieces(batches, most):
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            raws.append(t.as_py() or b"")
            keys.append(i)
            size += len(raws[-1])
            if size > most:
                yield keys, raws
                keys, raws, size = [], [], 0
    if raws:
        yield keys, raws


def fit(df: DataFrame, text_col: str = "text", net: Network = Network(), sized: bool = True) -> tuple[Words, np.ndarray]:
    """The words, and the packed parameters after all rounds. sized: the side follows the corpus, else it is net's."""
    spark = df.sparkSession
    words = vocabulary(df, text_col, net, sized)
    net = words.net
    shared = spark.sparkContext.broadcast(words.ids)  # at most net.size words
    flat = net.pack(net.start(words.counts))
    slim = df.select(F.lit(0).alias("k"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    for turn in range(net.rounds):
        now = spark.sparkContext.broadcast(flat)

        def local(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            one_thread()
            p = net.unpack(now.value)
            acc = {k: np.full(v.shape, 0.05 / net.batch, np.float32) for k, v in p.items()}
            seen, ids, part = 0, shared.value, TaskContext.get().partitionId()
            low = turn * net.mask % 1.0
            for _, raws in _groups(batches):
                x, at, of, place = lay_out([token_ids(r, ids, net.side)[0] for r in raws], net)
                if not len(at):
                    continue
                salt = np.array([zlib.crc32(r) for r in raws], np.uint64)
                mix = (salt[of] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                mix ^= mix >> np.uint64(31)
                mix *= np.uint64(0x94D049BB133111EB)
                share = (mix >> np.uint64(40)).astype(np.float64) / (1 << 24)
                mine = np.flatnonzero((share >= low) & (share < low + net.mask))
                at = at[mine[np.argsort(mix[mine], kind="stable")]]
                for lo in range(0, len(at), net.batch):
                    train_step(p, acc, x, at[lo : lo + net.batch], net)
                seen += len(at)
            if seen:
                yield pa.RecordBatch.from_pydict({"slot": pa.array([part % net.slots], pa.int32()), "part": pa.array([part], pa.int32()), "n": pa.array([float(seen)]), "w": pa.array([(net.pack(p).astype(np.float64) * seen).astype(np.float32).tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of rows sorted by (slot, part): the same sums whatever order they came in."""
            held: dict[int, tuple[float, np.ndarray]] = {}
            for batch in pieces(batches):
                for s, _, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    m, v = held.get(s, (0.0, 0.0))
                    held[s] = (m + n, v + np.frombuffer(w, np.float32).astype(np.float64))
            for s, (n, v) in held.items():
                yield pa.RecordBatch.from_pydict({"slot": pa.array([s], pa.int32()), "part": pa.array([0], pa.int32()), "n": pa.array([n]), "w": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

        schema = "slot int, part int, n double, w binary"
        dealt = in_arrow(slim, local, schema).repartition(net.slots, "slot").sortWithinPartitions("slot", "part")
        sums = sorted(in_arrow(dealt, add, schema).collect(), key=lambda r: r.slot)
        if not sums:
            break
        total = sum(r.n for r in sums)
        flat = (sum(np.frombuffer(r.w, np.float32).astype(np.float64) for r in sums) / total).astype(np.float32)
        now.unpersist()
    return words, flat


def log_probs(raws: list[bytes], words: Words, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, how many tokens it has and the sum of their log-probabilities."""
    net = words.net
    got = [token_ids(r, words.ids, net.side) for r in raws]
    x, at, of, _ = lay_out([i for i, _ in got], net)
    sums = np.zeros(len(raws))
    for lo in range(0, len(at), 2048):
        sums += np.bincount(of[lo : lo + 2048], log_prob(p, x, at[lo : lo + 2048], net), minlength=len(raws))
    # the word within its bucket
    rare = [w for _, r in got for w in r]
    if rare:
        within = words.spelling.log_prob(rare) + np.log(net.side)
        sums += np.bincount(np.repeat(np.arange(len(raws)), [len(r) for _, r in got]), within, minlength=len(raws))
    return np.bincount(of, minlength=len(raws)).astype(np.int64), sums


def score(df: DataFrame, model: tuple[Words, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_tokens, log_prob (the sum over all tokens), mean_log_prob."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of the grid's size
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        words, flat = shared.value
        p = words.net.unpack(flat)
        for keys, raws in _groups(batches):
            n, sums = log_probs(raws, words, p)
            mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], kind), pa.array(n), pa.array(sums), mean], names=[id_col, "n_tokens", "log_prob", "mean_log_prob"])

    slim = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    kind = to_arrow_type(slim.schema[0].dataType)
    return in_arrow(slim, run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_tokens long, log_prob double, mean_log_prob double")


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Network = Network()) -> DataFrame:
    return score(df, fit(df, text_col, net), id_col, text_col)
