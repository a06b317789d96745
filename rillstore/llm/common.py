"""Shared scratch tables, table readers and graph components for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of other characters. Fixed values.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. One is made only in local mode, where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_rill_dir", None) or f"file://{tempfile.mkdtemp(prefix='rill-')}"
        spark.sparkContext._rill_dir = named
    return named.rstrip("/")


def gathered(df: DataFrame, name: str, rows: int) -> DataFrame:
    """table() of narrow rows, about so many, made by many tasks: one more shuffle, and a file for FILE_ROWS of them, not a tiny one of each task."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table(df.repartition(max(1, min(most, -(-rows // FILE_ROWS)))), name)


def settled(df: DataFrame, name: str) -> DataFrame:
    """gathered(), where it is not known how many rows there are: adaptive execution deals them into files of its advisory size."""
    return table(df.hint("rebalance"), name)


def _place(spark: SparkSession, path: str):
    """The path's file system, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which goes when the driver's JVM ends."""
    own = f"{shared_dir(spark)}/rill/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_rill_own", None) != own:
        fs, p = _place(spark, own)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        spark.sparkContext._rill_own = own
    return f"{own}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once no result that reads them is needed."""
    fs, p = _place(spark, f"{shared_dir(spark)}/rill/{spark.sparkContext.applicationId}")
    fs.delete(p, True)


#: Bytes of an Arrow batch, and of a piece of one that a function holds as Python objects.
BATCH_BYTES, PIECE_BYTES = 4 << 20, 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most `most` bytes of text, or of one row where that is longer."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def lean(run: Callable) -> Callable:
    """run, which gives back to the system what it held when its task ends: an idle worker keeps no memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow over batches of bounded bytes. The bound is a session setting, spark.sql.execution.arrow.maxBytesPerBatch, made only where none is."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(lean(run), schema)


#: Rows of a file of a table whose size is known.
FILE_ROWS = 250_000


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors.

    rows: about how many there are, where that is known. The table then has files of FILE_ROWS, not a tiny one of each task.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_rill_path", None):
            fs, p = _place(t.sparkSession, path)
            fs.delete(p, True)


def _cut(held: DataFrame, order: Column, most: int) -> tuple[DataFrame, DataFrame, int]:
    """By a histogram of order, an integer: the rows of the first values that fit into `most`, those of the value that doesn't, and how many fit still."""
    left, cut = most, None
    for r in sorted(held.groupBy(order.alias("s")).agg(F.count("*").alias("k")).collect()):
        if r.k > left:
            cut = r.s
            break
        left -= r.k
    if cut is None:
        return held, held.limit(0), left
    return held.where(order < cut), held.where(order == cut), left


def most_frequent(counts: DataFrame, key: str, most: int) -> list[tuple[str, int]]:
    """The `most` most frequent keys of the table counts(key, n), ties by xxhash64 of the key and then the key.

    Cuts come from histograms: of n by steps of a 16th of a power of two, of n within the step that doesn't fit, and of
    16 bits of the hash among equal n. So no task and not the driver sorts or gathers more than `most` keys and those of
    one bit pattern in 65,536.
    """
    held = counts.select(key, "n", F.xxhash64(key).alias("h"))
    got: list = []
    rest, left = held, most
    for order in (-F.floor(F.log2("n") * 16), -F.col("n"), F.shiftright("h", 48)):
        sure, rest, left = _cut(rest, order, left)
        got += sure.collect()
    got += sorted(rest.collect(), key=lambda r: (r.h, r[key]))[:left]
    return sorted(((r[key], r.n) for r in got), key=lambda x: (-x[1], x[0]))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b), by large-star and small-star rounds.

    Returns (node, root), root the smallest node of each component, for nodes that have an edge to another node.
    Each round is two grouped minima, combined before their shuffle, and two equi-joins of narrow rows; a hub's links are
    never a list. In a join they meet in one task unless they exceed adaptive execution's skew threshold, by which they
    are split. Rounds end at the fixed point, after a logarithmic number. Each round's edges go to a table in the shared
    folder.
    """
    e = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    n, old = e.count(), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = table(large, name, n)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = table(small, name, n)
        sig = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        drop(e, large)
        e = new
        if sig == old:
            break
        old = sig
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
