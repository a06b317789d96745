"""Suffix-array dedup: remove bytes covered by a string of `width` bytes that also starts earlier, by external induced sorting.

1. Owners. In every window of `width` bytes the least hash of a k-gram (leftmost if equal) is the window's owner; equal
   windows have equal owners at equal offsets. Consecutive windows of one owner are a region. A region is a narrow row
   (owner's hash, region's hash, document, start, windows); regions repeated in a task's chunk are settled there. Regions
   count as equal if both hashes are, which are of different families (a polynomial of the k-gram, XXH3 of the region's
   bytes); bytes are not compared again.
2. One shuffle by owner, sorted. Of equal regions the first stays as representative and all windows of the others are
   repeats. Only owners with two or more different regions leave something to compare: their representatives.
3. Shards. Representatives' texts are dealt by owner, so that equal windows meet, and each shard's texts are written to a
   file and suffix-sorted by external induced sorting (induced.py): tuples of position and common prefix go through
   priority queues on disk, and the string of S* names is sorted by recursion. What a task holds is set by `bound` tuples,
   not by the shard, so that an owner with very many regions costs its task time and local disk but no more memory.
4. In the suffix order, a run of common prefixes >= width is a set of equal windows: all but the first by (document,
   position) are repeats. Repeats become byte intervals, and one join by document cuts them out.

Cases: null text counts as empty. A null id sorts first. Rows that repeat both id and text are one document and share
its result; of two texts under one id, the one with the smaller XXH64 is earlier. Extra columns are ignored. An empty
table gives an empty one. Whole texts are used, of any length that an Arrow batch holds (2 GB).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces, table
from .induced import Rows, repeats

WIDTH = 100
GRAM = 32
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE_BITS = np.uint64(31)


# ---- owners and regions


class Regions:
    """Regions of concatenated texts, by polynomial hashes modulo 2 ** 64."""

    def __init__(self, width: int = WIDTH, gram: int = GRAM) -> None:
        self.width, self.gram = width, gram
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                x = np.full(n + 1, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(32))
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def find(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """document, start, windows, owner's hash, region's hash of each region."""
        none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        lens = np.array([len(r) for r in raws], np.int64)
        b = np.frombuffer(b"".join(raws), np.uint8)
        n = len(b)
        if n < self.width:
            return none
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        k, w = self.gram, self.width - self.gram + 1
        h = self._mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        low = (h & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1))) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= w:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < w:
            low = np.minimum(low[: -(w - step)], low[w - step :])
        owner = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)  # of each window start
        ends = np.cumsum(lens)
        begins = ends - lens
        doc = np.repeat(np.arange(len(raws)), lens)[: len(owner)]
        at = np.arange(len(owner))
        valid = at + self.width <= ends[doc]
        new = valid.copy()
        new[1:] &= (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
        s = np.flatnonzero(new)
        if not len(s):
            return none
        # a region ends before the next one, or at its document's last window
        count = np.minimum(np.r_[s[1:], n], ends[doc[s]] - self.width + 1) - s
        e = s + count + self.width - 1
        whole, digest = memoryview(b), xxhash.xxh3_64_intdigest
        region = np.array([digest(whole[a:z]) for a, z in zip(s.tolist(), e.tolist(), strict=True)], np.uint64)
        return doc[s], s - begins[doc[s]], count, h[owner[s]], region


ROW = "kind byte, owner long, region long, id long, key long, start int, windows int"
ARROW_ROW = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
NAMES = [x.split()[0] for x in ROW.split(", ")]
CANDIDATE, REPEAT = 0, 1


def _batch(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ARROW_ROW, strict=True)], names=NAMES)


def _make_regions(width: int, chunk: int = 1_000_000) -> Callable:
    """Regions of `chunk` bytes at a time. A longer text is taken in parts that overlap by a window less one byte: a region
    that a part's end cuts is two regions of one owner, which meet all others of that owner as any do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Regions(width)

        def out(raws: list[bytes], of: list[tuple[int, int, int]]) -> pa.RecordBatch:
            doc, start, count, owner, region = made.find(raws)
            i, k, begin = np.array(of, np.int64)[doc].T
            start = start + begin
            order = np.lexsort((start, k, i, region, owner))
            o, r = owner[order], region[order]
            later = np.r_[False, (o[1:] == o[:-1]) & (r[1:] == r[:-1])] if len(o) else np.zeros(0, bool)
            own = later.copy()  # the same place again, of a row that repeats id and text
            for x in (i, k, start):
                own[1:] &= x[order][1:] == x[order][:-1]
            order, o, r, later = order[~own], o[~own], r[~own], later[~own]
            # a repeat within the chunk is settled: any earlier occurrence will do. It is dealt by its document
            spread = np.where(later, (i[order] * 0x9E3779B1 ^ k[order]), o.view(np.int64))
            return _batch(later.astype(np.int8), spread, r.view(np.int64), i[order], k[order], start[order].astype(np.int32), count[order].astype(np.int32))

        raws, of, size = [], [], 0
        for batch in pieces(batches):
            for t, i, k in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = t.as_py() or b""
                for at in range(0, max(1, len(raw) - width + 1), chunk):
                    raws.append(raw[at : at + chunk + width - 1])
                    of.append((i, k, at))
                    size += len(raws[-1])
                    if size > chunk:
                        yield out(raws, of)
                        raws, of, size = [], [], 0
        if raws:
            yield out(raws, of)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, owner, region, id, key, start): repeats go through; of equal regions the first is a candidate if its owner has another region."""
    last = None  # owner, region of the last row; the owner's first region, until it is known to have another
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        kind, owner, region = c[0], c[1], c[2]
        cand = kind == CANDIDATE
        prev_o, prev_r, prev_k = np.roll(owner, 1), np.roll(region, 1), np.roll(kind, 1)
        prev_o[0], prev_r[0], prev_k[0] = last[:3] if last else (0, 0, 9)
        same_owner = cand & (prev_k == CANDIDATE) & (owner == prev_o)
        same = same_owner & (region == prev_r)
        own = same.copy()  # the same place again
        for j, x in enumerate(c[3:6]):
            own &= x == np.r_[last[3 + j] if last else 0, x[:-1]]
        repeat = ~cand | same & ~own
        if repeat.any():
            x = [v[repeat] for v in c]
            yield _batch(np.full(len(x[0]), REPEAT, np.int8), *x[1:])
        rep = np.flatnonzero(cand & ~same)
        if len(rep):
            first = ~same_owner[rep]  # the first region of its owner
            if not first[0] and held is not None:
                yield _batch(*held)
                held = None
            group = np.cumsum(first)
            size = np.bincount(group)[group]
            open_end = group == group[-1]
            emit = (size > 1) | (group == 0)
            # the last owner may go on in the next batch
            single_last = open_end & (size == 1) & (group > 0)
            if emit.any():
                yield _batch(*(v[rep[emit]] for v in c))
            if group[-1] > 0:
                held = [v[rep[single_last]] for v in c] if single_last.any() else None
        elif cand.any() and not same_owner[np.flatnonzero(cand)[-1]]:
            held = None
        last = (owner[-1], region[-1], kind[-1], *(x[-1] for x in c[3:6]))


# ---- shards


class Shard:
    """The regions of a shard, in files: the text, a separator after each, and by region its place in the text, id, key and start."""

    def __init__(self, folder: str) -> None:
        self.folder, self.file, self.n, self.last = folder, tempfile.TemporaryFile(dir=folder), 0, None
        self.places = Rows(folder)

    def add(self, batch: pa.RecordBatch) -> None:
        """Rows sorted by (id, key, start); rows that repeat all three come once."""
        ids, keys, starts = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
        for raw, place in zip(batch.column(0), zip(ids.tolist(), keys.tolist(), starts.tolist(), strict=True), strict=True):
            if place == self.last:
                continue
            self.last = place
            b = np.frombuffer(raw.as_py(), np.uint8)
            sym = np.zeros(len(b) + 1, np.uint16)
            sym[:-1] = b
            sym[:-1] += 1
            self.file.write(sym.tobytes())
            self.places.add(np.array([self.n, *place]))
            self.n += len(sym)

    def repeats(self, width: int, bound: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks of (id, key, start, windows) of runs of windows that also start earlier."""
        if not self.n:
            return
        self.file.flush()
        t = np.memmap(self.file, np.uint16, "r", shape=(self.n,))
        begins, ids, keys, starts = self.places.mapped().reshape(-1, 4).T
        mark = repeats(t, self.folder, width, bound)
        for lo in range(0, self.n, bound):
            at = np.flatnonzero(mark[lo : lo + bound]) + lo  # never a separator, so a run stays in its region
            if len(at):
                head = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                of = np.searchsorted(begins, at[head], "right") - 1
                yield ids[of], keys[of], starts[of] + at[head] - begins[of], np.diff(np.r_[head, len(at)])


def _solve(width: int, bound: int) -> Callable:
    """All regions of a shard, sorted by (id, key, start), so that earlier in the joined text is earlier in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="rill-suffix-") as folder:
            shard = Shard(folder)
            for batch in pieces(batches):
                shard.add(batch)
            for ids, keys, starts, windows in shard.repeats(width, bound):
                zero = np.zeros(len(ids), np.int64)
                yield _batch(np.full(len(ids), REPEAT, np.int8), zero, zero, ids, keys, starts, windows)

    return run


def _cut(id_type: pa.DataType, id_col: str, width: int, with_kept: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, texts = [], []
            for raw, runs in zip(batch.column(1), batch.column(2), strict=True):
                b, removed, spans = raw.as_py() or b"", 0, 0
                kept, at = [], 0
                for s, n in sorted((x["start"], x["windows"]) for x in runs.as_py() or []):
                    e = s + n + width - 1
                    if s > at or not spans:
                        spans += 1
                        kept.append(b[at:s])
                        removed += e - s
                        at = e
                    elif e > at:
                        removed += e - at
                        at = e
                kept.append(b[at:])
                left = b"".join(kept)
                rows.append((len(b), removed, spans, hashlib.sha256(left).hexdigest()))
                if with_kept:
                    texts.append(left)
            n, r, s, h = zip(*rows, strict=True)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.binary())] * with_kept, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept)

    return run


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shard_bytes: int = 3_000_000, with_kept: bool = False, bound: int = 1 << 18) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256; with_kept adds kept (bytes). id_col must be an integer column.

    bound: how many suffix tuples a task holds in memory, whatever its shard's size.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    least = -(1 << 63)
    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(id_col).alias("__own"))
    made = in_arrow(rows.select("raw", "id", "key"), _make_regions(width), ROW)
    dealt = made.repartition("owner").sortWithinPartitions("kind", "owner", "region", "id", "key", "start")
    settled = table(in_arrow(dealt, _settle, ROW), "suffix-settled")
    todo = settled.where(F.col("kind") == CANDIDATE)
    n, windows = todo.agg(F.count("*"), F.coalesce(F.sum("windows"), F.lit(0))).first()
    found = settled.where(F.col("kind") == REPEAT)
    solved = None
    if n:
        shards = max(1, -(-(windows + n * width) // shard_bytes))
        near = todo.select("owner", "start", "windows", F.col("id").alias("__i"), F.col("key").alias("__k"))
        cut = F.substring(F.col("raw"), F.col("start") + 1, F.col("windows") + width - 1)
        once = rows.select("raw", "id", "key").join(near, (F.col("id") == F.col("__i")) & (F.col("key") == F.col("__k"))).select(cut.alias("text"), "id", "key", "start", "owner")
        once = once.repartition(int(shards), "owner").sortWithinPartitions("id", "key", "start").select("text", "id", "key", "start")
        solved = table(in_arrow(once, _solve(width, bound), ROW), "suffix-solved")
        found = found.unionByName(solved)
    runs = found.groupBy(F.col("id").alias("__i"), F.col("key").alias("__k")).agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    whole = rows.join(runs, (F.col("id") == F.col("__i")) & (F.col("key") == F.col("__k")), "left").select("__own", "raw", "runs")
    kind = df.select(id_col).schema[0].dataType
    return in_arrow(whole, _cut(to_arrow_type(kind), id_col, width, with_kept), f"`{id_col}` {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
