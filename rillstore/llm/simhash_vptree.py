"""SimHash near-dedup with vantage-point trees.

Fingerprints are points of a metric space, Hamming distance. Two levels of vantage points cut it up:

1. Shards. A set of bits S gives a sub-metric d_S <= d. With radius + 1 disjoint sets, a pair within the radius has
   d_S = 0 for one of them at least. In each sub-metric, fixed vantage points halve the space again and again: a shard is
   a leaf of that tree, the fingerprints on the same side of every vantage point. As points at distance 0 are on the same
   side of all, no shard overlaps a boundary, and no pair is lost. There are as many halvings as bring shards to about
   `shard` points. A shard that is too large even so (near copies crowd) is cut by the values themselves, which a pair
   shares there, and then over the remaining bits by the same rule, until none is: after six cuts at most 2 ** 12 points
   can differ.
2. A vantage-point tree in each shard, with the full distance: distances to a vantage point, a median radius, an inner
   and an outer half; a branch is left out when the triangle bound |d(x, v) - d(y, v)| <= d(x, y) excludes it, and what
   lies within the radius of the boundary is queried against the other half. Pairs found are exact.

A plain tree over all fingerprints would visit both halves for most points: distances of unrelated fingerprints crowd
around 32. In sub-metrics the bound excludes all but one side, which is why the shards come first; README has counts.

Equal fingerprints are one class from the start. In a shard, pairs become a forest (at most one link per fingerprint),
so a large group of near copies never becomes a list of all its pairs. Links of all shards meet in components(), in
tables on the shared folder.

Cases: null text counts as empty, and has the fingerprint 0 like any text without words. Null and repeated ids pass
through, a row for each input row; a component's id is its smallest id that is not null. keep_one() decides row by row:
of a component the rows that have its id stay, or, where no row has an id, those of the smallest text hash; of these,
rows that repeat one another in id and text all stay or go together. Very long texts are hashed in parts. Extra columns
are ignored, and returned as they are by keep_one(), whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, gathered, in_arrow, pieces, table

BITS = 64


def shingle_hashes(raw: bytes, shingle: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, in parts; a text of fewer words is one shingle, one without words has none."""
    words = raw.lower().split()  # bytes: ASCII letters and ASCII white space only
    text, h = b" ".join(words), xxhash.xxh64_intdigest
    if not words:
        return
    if len(words) <= shingle:
        yield np.array([h(text, seed)], np.uint64)
        return
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    m = len(words) - shingle + 1
    for lo in range(0, m, 65536):
        hi = min(m, lo + 65536)
        yield np.array([h(text[a : b - 1], seed) for a, b in zip(starts[lo:hi], starts[lo + shingle : hi + shingle], strict=True)], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """A bit is 1 if over half the hashes have it; 0 of none."""
    m, ones = 0, np.zeros(BITS, np.int64)
    for got in parts:
        m += len(got)
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > m, bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if over half the XXH64 of the shingles have it."""
    return majority(shingle_hashes(raw, shingle, seed))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(__id, __fp) for each row; __fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["__id", "__fp"])

    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__raw"))
    return in_arrow(slim, run, f"__id {slim.schema[0].dataType.simpleString()}, __fp long")


class Forest:
    """Labels of points 0..n-1 under links added in blocks."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        if not (new := a != b).any():
            return
        a, b = a[new], b[new]
        root = np.arange(len(self.label))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
        self.label = root[self.label]


LEAF = 64


def _brute(x: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> int:
    """Link pairs of a and b one by one; how many were compared."""
    for lo in range(0, len(a), 512):
        part = a[lo : lo + 512]
        for to in range(0, len(b), 4096):
            other = b[to : to + 4096]
            i, j = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[other][None, :]) <= radius)
            if len(i):
                forest.link(part[i], other[j])
    return len(a) * len(b)


def vantage_join(x: np.ndarray, radius: int, forest: Forest) -> tuple[int, int]:
    """Link all pairs of x within the radius: a tree over x joined with itself. Nodes visited, and pairs compared in leaves."""
    todo, nodes, compared = [(np.arange(len(x)), None)], 0, 0
    while todo:
        a, b = todo.pop()
        if b is None:
            nodes += 1
            if len(a) <= LEAF:
                compared += _brute(x, a, a, radius, forest)
                continue
            d = np.bitwise_count(x[a] ^ x[a[len(a) // 2]]).astype(np.int16)
            mu = int(np.median(d))
            near = d <= mu
            if near.all():
                near = d < mu
            if near.all() or not near.any():
                compared += _brute(x, a, a, radius, forest)
                continue
            edge = d[near].max()
            todo += [(a[near], None), (a[~near], None), (a[near & (d >= edge + 1 - radius)], a[~near & (d <= edge + radius)])]
        elif len(a) and len(b):
            nodes += 1
            if len(a) * len(b) <= LEAF * LEAF * 4:
                compared += _brute(x, a, b, radius, forest)
                continue
            v = x[a[len(a) // 2]]
            da, db = np.bitwise_count(x[a] ^ v).astype(np.int16), np.bitwise_count(x[b] ^ v).astype(np.int16)
            mu = int(np.median(da))
            near = da <= mu
            halves = [(a[near], b[db <= mu + radius]), (a[~near], b[db > mu - radius])]
            if sum(len(p) * len(q) for p, q in halves) > 0.9 * len(a) * len(b):
                compared += _brute(x, a, b, radius, forest)  # the bound excludes too little here
            else:
                todo += halves
    return nodes, compared


def _shard_links(radius: int):
    """Links of each shard from rows sorted by (choice, value): whole shards of a batch at a time, a tree each."""

    def solve(choice: np.ndarray, value: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(fp):
            return
        new = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (value[1:] != value[:-1])])
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(fp)], strict=True):
            if hi - lo > 1:
                x = fp[lo:hi]
                own = Forest(len(x))
                vantage_join(x, radius, own)
                moved = np.flatnonzero(own.label != np.arange(len(x)))
                yield x[moved], x[own.label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        cols = lambda b: [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]

        def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            got = [z for z in solve(parts[0], parts[1], parts[2].view(np.uint64)) if len(z[0])]
            if got:
                a, b = (np.concatenate(z).view(np.int64) for z in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate(x) for x in zip(held, cols(batch), strict=True)]
            last = (held[0] != held[0][-1]) | (held[1] != held[1][-1])
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut > 50_000 or cut and len(held[0]) > 100_000:
                yield from out([np.ascontiguousarray(x[:cut]) for x in held])
                held = [x[cut:] for x in held]
        yield from out([np.ascontiguousarray(x) for x in held])

    return run


def _blocks(mask: int, parts: int) -> list[int]:
    """parts disjoint sets of the bits of mask, as equal as can be."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _vantage(k: int) -> int:
    """The k-th vantage point: 64 fixed bits."""
    return xxhash.xxh64_intdigest(b"vantage", k)


def cell(fp: Column, mask: int, halvings: int) -> Column:
    """The leaf of a fingerprint in the tree of fixed vantage points in the sub-metric of the mask's bits: a bit for each, on which side it lies."""
    radius = mask.bit_count() // 2
    out = F.lit(0).cast("long")
    for k in range(halvings):
        d = F.bit_count(fp.bitwiseXOR(F.lit(_signed(_vantage(k)))).bitwiseAND(F.lit(_signed(mask))))
        out = out + F.when(d <= radius, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def links(classes: DataFrame, radius: int = 3, shard: int = 1024, max_shard: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints __fp whose components are those of all pairs within the radius."""
    full = (1 << BITS) - 1
    used = {k + 1: m for k, m in enumerate(_blocks(full, radius + 1))}  # choice -> bits on which its pairs agree
    halvings = max(0, min(BITS // (radius + 1), (classes.count() // shard).bit_length()))
    fp = F.col("__fp")
    first = F.array(*(F.struct(F.lit(c).cast("long").alias("c"), cell(fp, m, halvings).alias("v")) for c, m in used.items()))
    rows = classes.select(F.explode(first).alias("x"), "__fp").select(F.col("x.c").alias("choice"), F.col("x.v").alias("value"), "__fp")
    ready = None
    while True:
        rows = table(rows, "vp-rows")
        big = table(rows.groupBy("choice", "value").agg(F.count("*").alias("n")).where(F.col("n") > max_shard).select("choice", "value"), "vp-big")
        choices = [r.choice for r in big.select("choice").distinct().collect()]  # bounded by the radius and the number of cuts
        done = rows if not choices else rows.join(big, ["choice", "value"], "left_anti")
        ready = done if ready is None else ready.unionByName(done)
        if not choices:
            break
        children = {}
        for c in choices:
            for k, m in enumerate(_blocks(full & ~used[c], radius + 1)):
                child = c * (radius + 2) + k + 1
                used[child] = used[c] | m
                children.setdefault(c, []).append((child, used[child]))
        cases = F.create_map(*(x for c, own in children.items() for x in (F.lit(c).cast("long"), F.array(*(F.struct(F.lit(n).cast("long").alias("c"), F.lit(_signed(m)).cast("long").alias("m")) for n, m in own)))))
        made = rows.join(big, ["choice", "value"], "left_semi").select("__fp", F.explode(F.element_at(cases, F.col("choice"))).alias("x"))
        rows = made.select(F.col("x.c").alias("choice"), fp.bitwiseAND(F.col("x.m")).alias("value"), "__fp").distinct()
    dealt = ready.select("choice", "value", "__fp").repartition("choice", "value").sortWithinPartitions("choice", "value")
    return in_arrow(dealt, _shard_links(radius), "a long, b long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, shard: int = 1024, max_shard: int = 20_000) -> DataFrame:
    """One row per input row: id_col, fingerprint (signed long), component_id."""
    fps = table(fingerprints(df, id_col, text_col, shingle), "simhash")
    classes = table(fps.groupBy("__fp").agg(F.min("__id").alias("first")), "simhash-classes")
    comp = components(links(classes, radius, shard, max_shard), "simhash-cc")
    named = classes.join(comp, classes["__fp"] == comp["node"], "left").select("__fp", "first", F.coalesce("root", "__fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("__fp", "component_id")
    return fps.join(of, "__fp").select(F.col("__id").alias(id_col), F.col("__fp").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3) -> DataFrame:
    """The rows of df that stay: of a component those with its id."""
    slim = df.select(F.struct(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text_col).alias("t")).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    fps = table(fingerprints(slim, "__row", "__text", shingle), "simhash")
    classes = table(fps.groupBy("__fp").agg(F.count("*").alias("n")), "simhash-classes")
    comp = components(links(classes, radius), "simhash-cc")
    named = classes.join(comp, classes["__fp"] == comp["node"], "left").select("__fp", F.coalesce("root", "__fp").alias("root"))
    return one_of_each(df, fps.join(named, "__fp").select(F.col("__id.i").alias("i"), F.col("__id.t").alias("t"), "root"), id_col, text_col)


def one_of_each(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df without those of found(i, t, root: id, hash of the text, group) that are not their group's first, by id with nulls last and then by t."""
    order = F.struct(F.col("i").isNull().alias("z"), "i", "t")
    rows = table(found.groupBy("i", "t", "root").agg(F.lit(1).alias("one")).select("i", "t", "root"), "near-rows")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    gone = rows.join(first, "root").where(~order.eqNullSafe(F.col("first"))).select(F.col("i").alias("__gone_i"), F.col("t").alias("__gone_t")).distinct()
    gone = gathered(gone, "near-gone", rows.count())
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    own = df.select(row.alias("row"), F.col(f"`{id_col}`").alias("__i"), F.xxhash64(text_col).alias("__t"))
    return own.join(gone, (F.col("__t") == F.col("__gone_t")) & F.col("__i").eqNullSafe(F.col("__gone_i")), "left_anti").select("row.*")
