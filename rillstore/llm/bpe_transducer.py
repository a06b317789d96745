"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's most frequent words are merged once and compiled, with their ids as output, into a minimal acyclic
automaton: equal suffixes share states, each transition carries how many words lie before it, and the sum along a word's
path is its number, under which its ids stand. The automaton is one flat file of sorted arrays; each worker maps that
file into memory and walks it for all new words of a batch at once. Words that it does not hold are merged exactly, rank
by rank. The ids equal those of the tokenizers library for the same vocabulary file.

Pre-tokenizing is done over arrays of code points by class (letter, number, white space, other). The classes are read off
the library's own pre-tokenizer once, so that they are those of its Unicode version.

Cases: null text counts as empty (no ids). Null and repeated ids pass through, a row for each input row. Extra columns
are ignored. An empty table gives an empty one. Very long texts are worked on whole; very long words merge by a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_arrow, most_frequent, pieces, table

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
NEVER = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Merger:
    """Vocabulary and merges of a tokenizer file; exact merging of one word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.rank: dict[int, int] = {}  # pair -> rank and new id in one number
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = r << 20 | vocab[a + b]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in vocab.items():
            self.token[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s

    def merge(self, word: bytes) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        first, rank = self.first, self.rank
        ids = [first[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        pairs = [rank.get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs and (best := min(pairs)) != NEVER:
            k = pairs.index(best)
            ids[k : k + 2] = [best & 0xFFFFF]
            del pairs[k]
            if k:
                pairs[k - 1] = rank.get(ids[k - 1] << 20 | ids[k], NEVER)
            if k < len(pairs):
                pairs[k] = rank.get(ids[k] << 20 | ids[k + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        left, right, heap = list(range(-1, n - 1)), [*range(1, n), -1], []
        for k in range(n - 1):
            if (r := rank.get(ids[k] << 20 | ids[k + 1])) is not None:
                heap.append((r, k, ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = r & 0xFFFFF, -1
            right[k] = right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for p, q in ((left[k], k), (k, right[k])):
                if p >= 0 and q >= 0 and (r := rank.get(ids[p] << 20 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]


def character_classes(path: str) -> np.ndarray:
    """The class of each code point, as the file's pre-tokenizer has it."""
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    table = np.zeros(0x110000, np.uint8)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # only these can be of a class: any letter, number or white space of this Python's or of regex's Unicode version
    able = sorted({ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", "".join(every))} | {ord(c) for c in every if unicodedata.category(c)[0] in "LNZ" or c.isspace()})
    for lo in range(0, len(able), 1024):
        codes = able[lo : lo + 1024]
        # "a", the character, "1", twice: a letter joins the a, a number the 1, white space splits "!" from what follows
        cuts = np.zeros(len(codes) * 8 + 1, bool)
        cuts[[a for _, (a, _) in pre.pre_tokenize_str("".join(f"a{chr(c)}1!{chr(c)}{chr(c)}!\n" for c in codes))]] = True
        at = np.arange(len(codes)) * 8
        joins_a, joins_1, joins_mark = ~cuts[at + 1], ~cuts[at + 2], ~cuts[at + 4]
        table[codes] = np.where(joins_a, LETTER, np.where(joins_1, NUMBER, np.where(joins_mark, OTHER, BLANK)))
    table[32] = BLANK  # joins whatever follows
    return table


def word_starts(codes: np.ndarray, first: np.ndarray, whole: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start positions of words in concatenated segments. first: where segments start; whole: which of them are one word."""
    n = len(codes)
    cls = classes[codes]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    start = head.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    runs = np.flatnonzero(start)  # with n at the end
    single = np.zeros(n + 1, bool)
    single[runs[:-1][np.diff(runs) == 1]] = True
    # a run of white space before a word gives up its last character, and a plain space joins the word
    last = runs[1:-1] - 1
    last = last[(cls[last] == BLANK) & ~head[last + 1]]
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    # an apostrophe that starts a word takes s, t, m, d, re, ve or ll from the letters behind it
    p = np.flatnonzero((codes == 39) & single[:n] & start[:n])
    p = p[(p + 1 < n)]
    p = p[~head[p + 1]]
    if len(p):
        c1 = codes[p + 1]
        one = np.isin(c1, [115, 116, 109, 100])
        ok2 = (p + 2 < n) & ~head[np.minimum(p + 2, n)]
        c2 = codes[np.minimum(p + 2, n - 1)]
        two = ok2 & (((c1 == 114) | (c1 == 118)) & (c2 == 101) | (c1 == 108) & (c2 == 108))
        q = p[one | two]
        start[q + 1] = False
        start[q + 1 + np.where(one, 1, 2)[one | two]] = True
    if whole.any():
        ends = np.r_[first[1:], n]
        for a, b in zip(first[whole], ends[whole], strict=True):
            start[a + 1 : b] = False
    return np.flatnonzero(start[:n])


def split_words(texts: list[str], classes: np.ndarray, special: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, as bytes, and how many each text has."""
    segs: list[str] = []
    whole: list[bool] = []
    of: list[int] = []
    for k, t in enumerate(texts):
        parts = [(t, False)]
        for s in special:
            if s in t:
                parts = [x for p, w in parts for x in ([(p, w)] if w else [y for i, q in enumerate(p.split(s)) for y in ([(s, True)] if i else []) + [(q, False)]])]
        for p, w in parts:
            if p:
                segs.append(p)
                whole.append(w)
                of.append(k)
    counts = np.zeros(len(texts), np.int64)
    if not segs:
        return [], counts
    text = "".join(segs)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.cumsum([0, *map(len, segs[:-1])])
    starts = word_starts(codes, first, np.array(whole), classes)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    place = np.cumsum(width) - width
    at = place[starts].tolist()
    raw = text.encode()
    np.add.at(counts, np.array(of)[np.searchsorted(first, starts, "right") - 1], 1)
    return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)], counts


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The minimal acyclic transducer of words with id lists, as one flat file.

    Words are added in order; a finished branch is replaced by an equal state if there is one (same ending, same
    transitions). Then transitions get the number of words before them in their state.
    """
    entries = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        sig = (node[0], tuple(node[1]))
        if sig not in known:
            known[sig] = len(states)
            states.append(sig)
        return known[sig]

    path: list[list] = [[False, []]]
    last = b""
    for word, _ in entries:
        same = len(os.path.commonprefix([word, last]))
        while len(path) - 1 > same:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(done)))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(done)))
    root = freeze(path[0])
    size = [0] * len(states)  # words from each state; targets come before their sources
    for q, (final, moves) in enumerate(states):
        size[q] = final + sum(size[t] for _, t in moves)
    key, target, before = [], [], []
    for q, (final, moves) in enumerate(states):
        n = int(final)
        for c, t in moves:
            key.append(q << 8 | c)
            target.append(t)
            before.append(n)
            n += size[t]
    lengths = [len(ids) for _, ids in entries]
    flat = [i for _, ids in entries for i in ids]
    arrays = [np.array(key, np.int64), np.array(target, np.int64), np.array(before, np.int64), np.array([f for f, _ in states], np.int64), np.cumsum([0, *lengths]).astype(np.int64), np.array(flat, np.int64)]
    return np.array([root, *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The file of compile_lexicon(), mapped into memory."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile() as f:  # without a name: nothing stays behind
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        whole = np.frombuffer(self.map, np.int64)
        self.root, at, got = int(whole[0]), 7, []
        for n in whole[1:7].tolist():
            got.append(whole[at : at + n])
            at += n
        self.key, self.target, self.before, self.final, self.offset, self.ids = got

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, or -1: one walk for all words, byte by byte."""
        n = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(n) - n
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.arange(len(words)) if len(self.key) else np.zeros(0, np.int64)
        if not len(self.key):
            return np.full(len(words), -1, np.int64)
        for k in range(int(n.max(initial=0))):
            alive = alive[n[alive] > k]
            if not len(alive):
                break
            want = state[alive] << 8 | flat[start[alive] + k]
            e = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[e] == want
            state[alive[~hit]] = -1
            alive, e = alive[hit], e[hit]
            number[alive] += self.before[e]
            state[alive] = self.target[e]
        return np.where((state >= 0) & (self.final[state] > 0), number, -1)


class Encoder:
    """Words to ids: a bounded memory of recent words before the lexicon, the exact merger behind it."""

    def __init__(self, merger: Merger, lexicon: Lexicon, classes: np.ndarray, most: int = 300_000) -> None:
        self.merger, self.lexicon, self.classes, self.most = merger, lexicon, classes, most
        self.special = [s.decode() for s in merger.special]
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.lens = np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        number = self.lexicon.numbers(words)
        lists = []
        off, ids = self.lexicon.offset, self.lexicon.ids
        for w, k in zip(words, number.tolist(), strict=True):
            lists.append(self.merger.merge(w) if k < 0 else ids[off[k] : off[k + 1]].tolist())
        self.lens = np.concatenate([self.lens, np.array([len(x) for x in lists], np.int64)])
        self.flat = np.concatenate([self.flat, np.array([i for x in lists for i in x], np.uint32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words, counts = split_words(texts, self.classes, self.special)
        if len(self.index) > self.most:
            self.forget()
        index, known = self.index, len(self.index)
        at = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        if len(index) > known:
            self._learn(list(index)[known:])
        starts = np.cumsum(self.lens) - self.lens
        n = self.lens[at]
        total = np.cumsum(n)
        flat = self.flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts[at] - (total - n), n)]
        ends = np.r_[0, total][np.cumsum(counts)]
        return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def decode(ids: np.ndarray, token: list[bytes]) -> str:
    return b"".join(map(token.__getitem__, ids.tolist())).decode("utf-8", "replace")


def frequent_words(df: DataFrame, text_col: str, most: int) -> list[bytes]:
    """The most frequent letter words of the whole table, with the space before them. most bounds what comes to the driver."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r" ?\p{L}+"), F.lit(0))).alias("w")).where(F.length("w") <= 40)
    counts = table(words.groupBy("w").agg(F.count("*").alias("n")), "bpe-words")
    got = [w.encode() for w, _ in most_frequent(counts, "w", most)]
    drop(counts)
    return got


@lru_cache(maxsize=4)
def _merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(maxsize=4)
def _classes(path: str) -> np.ndarray:
    return character_classes(path)


@lru_cache(maxsize=1)
def _lexicon(data: bytes) -> Lexicon:
    return Lexicon(data)


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 60_000, with_ids: bool = False) -> DataFrame:
    """One row per input row: the id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (array<int>) and decoded.

    vocabulary: path of a byte-level BPE file of the tokenizers library, the same on driver and executors.
    """
    merger = _merger(vocabulary)
    words = frequent_words(df, text_col, lexicon_words)
    data = compile_lexicon((w, merger.merge(w)) for w in words)
    shared = df.sparkSession.sparkContext.broadcast((data, np.packbits(np.unpackbits(_classes(vocabulary)[:, None], axis=1)[:, 6:]).tobytes()))  # lexicon_words bounds the first, 272 kB the second

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value[1]
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, 2)
        m = _merger(vocabulary)
        enc = Encoder(m, _lexicon(shared.value[0]), bits[:, 0] * 2 + bits[:, 1])
        for batch in pieces(batches):
            rows = []
            for ids in enc.encode([x.as_py() or "" for x in batch.column(1)]):
                text = decode(ids, m.token)
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *((ids.astype(np.int32), text) if with_ids else ())))
            cols = list(zip(*rows, strict=True)) or [[]] * (5 if with_ids else 3)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=names[: 1 + len(cols)])

    slim = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return in_arrow(slim, run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
