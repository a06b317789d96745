"""Groups of near copies by the Jaccard similarity of shingle sets, with SimHash trees as a first step.

A class is a distinct set of shingles. Candidates are pairs of classes within a few bits of SimHash (links(), vantage-point
trees), and pairs that share a band: a band is 16 of the 320 least values of the set under fixed permutations of its
hashes, and there are 120, drawn at random. A pair at similarity s shares one with chance 1 - (1 - s ** 16) ** 120: 0.968
at 0.8, 0.993 at 0.82, 0.9999 at 0.85; one at 0.7 with chance 0.33, one at 0.6 with 0.03. (Wider bands find more at 0.8,
but where thousands of texts are 0.6 to 0.8 alike they make nearly all their pairs candidates.) Every candidate is decided
by the sets themselves, so no pair below the similarity is ever linked. README has measured recall.

Only which classes hang together matters, so a band that many classes share never becomes all its pairs. First, each
class is tried with one least and one greatest class among all it shares bands with; then, where a band holds several of
the groups that came of it, each class with the least and the greatest class of the band that is of another group; only
what is still apart within a band after that is tried pair by pair. That last step grows with the square of the number of
texts that share bands and yet are not linked.

Cases: null text counts as empty; texts without words have the empty set and are one group. Shingles and sets count as
equal if their 64-bit hashes are. Null and repeated ids, clashing columns and empty tables as in simhash_vptree. Very
long texts are hashed in parts; a set is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, gathered, in_arrow, pieces, settled, table
from .simhash_vptree import links, majority, one_of_each, shingle_hashes

VALUES, BANDS, ROWS = 320, 120, 16


def shingle_set(raw: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(raw, shingle)]))


class Permutations:
    """Fixed permutations of 32-bit numbers: exclusive or, then an odd factor."""

    def __init__(self, values: int = VALUES, bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 32, values, dtype=np.uint32)
        self.factor = rng.integers(0, 1 << 32, values, dtype=np.uint32) | np.uint32(1)
        self.bands = np.array([np.sort(rng.choice(values, rows, replace=False)) for _ in range(bands)])

    def keys(self, hashes: np.ndarray) -> list[int]:
        """A 64-bit key of each band; none of an empty set."""
        if not len(hashes):
            return []
        low = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), 1024):
            part = h[at : at + 1024, None] ^ self.flip[None, :]
            part *= self.factor[None, :]
            np.minimum(low, part.min(axis=0), out=low)
        size = 4 * self.bands.shape[1]
        raw = low[self.bands].tobytes()
        return [xxhash.xxh3_64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(len(self.bands))]


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(i, t, fp, key, n, bands) for each row: id, hash of the text, fingerprint, 64-bit hash and size of the shingle set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutations()
        for batch in pieces(batches):
            fps, keys, ns, bands = [], [], [], []
            for x in batch.column(2):
                parts = list(shingle_hashes(x.as_py() or b"", shingle))
                every = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
                fps.append(majority(parts))
                keys.append(xxhash.xxh3_64_intdigest(every.tobytes()))
                ns.append(len(every))
                bands.append(np.array(p.keys(every), np.uint64).view(np.int64))
            long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(fps), long(keys), pa.array(ns, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["i", "t", "fp", "key", "n", "bands"])

    slim = df.select(F.col(f"`{id_col}`").alias("i"), F.xxhash64(text_col).alias("t"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    return in_arrow(slim, run, f"i {slim.schema[0].dataType.simpleString()}, t long, fp long, key long, n long, bands array<long>")


def shingle_sets(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(key, n, hs) for each row: as in signatures(), and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingle_set(x.as_py() or b"", shingle) for x in batch.column(0)]
            keys = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["key", "n", "hs"])

    return in_arrow(df.select(F.col(f"`{text_col}`").cast("binary").alias("raw")), run, "key long, n long, hs array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of keys whose sets have a Jaccard similarity of at least percent / 100."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("hs").alias(f"s{c}"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, radius: int = 3) -> DataFrame:
    """(i, t, root) for each row: id, hash of the text, and the group under links between shingle sets of Jaccard similarity percent / 100 or more."""
    rows = table(signatures(df, id_col, text_col, shingle), "similar-rows")
    classes = table(rows.groupBy("key").agg(F.first("fp").alias("__fp"), F.first("n").alias("n"), F.min("t").alias("t"), F.first("bands").alias("bands")), "similar-classes")
    n = classes.count()
    # bands that two classes or more share; a class joins its bands again, as narrow rows
    each = classes.select("key", F.explode("bands").alias("s"))
    ends = settled(each.groupBy("s").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi"), "similar-ends")
    shared = settled(each.join(ends, "s"), "similar-shared")
    drop(ends)
    n_shared = shared.count()
    tree = links(classes.select("__fp").distinct(), radius)
    faces = classes.groupBy("__fp").agg(F.min("key").alias("face"))
    near = tree.join(faces.select(F.col("__fp").alias("a"), F.col("face").alias("x")), "a").join(faces.select(F.col("__fp").alias("b"), F.col("face").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = classes.join(faces, "__fp").where("key <> face").select(F.col("key").alias("a"), F.col("face").alias("b"))
    most = shared.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first = near.unionByName(same).unionByName(most.select(F.col("key").alias("a"), F.explode(F.array("lo", "hi")).alias("b"))).where("a <> b")
    first = gathered(first, "similar-first", 2 * n)
    # the sets of all classes that stand in a candidate
    able = first.select(F.col("a").alias("key")).union(first.select("b")).union(shared.select("key")).distinct()
    texts = classes.join(able, "key", "left_semi").select(F.col("t").alias("__t"))
    some = df.where(F.length(text_col) > 0).select(text_col).join(texts, F.xxhash64(text_col) == F.col("__t"), "left_semi")
    sets = table(shingle_sets(some, text_col, shingle).groupBy("key").agg(F.first("n").alias("n"), F.first("hs").alias("hs")), "similar-sets")
    sure = gathered(verified(first, sets, percent), "similar-sure", n)

    def apart(sure: DataFrame) -> DataFrame:
        """Classes in shared bands that hold more than one group, with their group."""
        comp = components(sure, "similar-cc")
        named = gathered(shared.select("s", "key").join(comp, shared["key"] == comp["node"], "left").select("s", "key", F.coalesce("root", "key").alias("root")), "similar-named", n_shared)
        mixed = named.groupBy("s").agg(F.min(F.struct("root", "key")).alias("lo"), F.max(F.struct("root", "key")).alias("hi")).where("lo.root < hi.root")
        return gathered(named.join(mixed, "s"), "similar-apart", n_shared)

    rest = apart(sure)
    other = lambda c: F.when(F.col("root") != F.col(f"{c}.root"), F.col(f"{c}.key"))
    tried = rest.select(F.col("key").alias("a"), F.explode(F.array(other("lo"), other("hi"))).alias("b")).where("b is not null")
    sure = sure.unionByName(gathered(verified(tried, sets, percent), "similar-sure", n))
    rest = apart(sure).select("s", "key", "root")
    pair = rest.select("s", *(F.col(c).alias(f"{c}_b") for c in ("key", "root")))
    pairs = rest.join(pair, "s").where((F.col("key") < F.col("key_b")) & (F.col("root") != F.col("root_b")))
    sure = sure.unionByName(gathered(verified(pairs.select(F.col("key").alias("a"), F.col("key_b").alias("b")), sets, percent), "similar-sure", n))
    comp = components(sure, "similar-cc")
    return rows.join(comp, rows["key"] == comp["node"], "left").select("i", "t", F.coalesce("root", "key").alias("root"))


def keep_one_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, radius: int = 3) -> DataFrame:
    """The rows of df that stay: of each group of similar() the one with the least id."""
    return one_of_each(df, similar(df, id_col, text_col, shingle, percent, radius), id_col, text_col)
