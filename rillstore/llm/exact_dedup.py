"""Exact dedup: stateful streaming with disk-backed keyed state, DataFrame functions only.

A Structured Streaming aggregation keyed by the digest of the normalised text holds, without expiry, the digest, how
many rows had it, and the stable identifier and content locator (file, row in it) of the row that stays. State lives in
RocksDB on the executors' disks with its checkpoint in the shared folder, so that a lost executor's part is restored,
and later runs with the same checkpoint go on where the last one ended, over new files only.

Then every hit is checked: the full normalised bytes of all rows of a group, the kept one's included, are compared as
the least and the greatest of the group, which combines in each task, so that a group of any size is one row for each
task. Rows whose bytes differ under an equal digest are grouped again by their bytes, so that the result is exact with
any digest. The locator tells the kept row apart from others that tie with it in everything else.

Cases: null text counts as empty. Null ids lose ties. Repeated rows are members of their group; where two rows tie in
everything, the smallest locator stays. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, _place, drop, scratch, table


#: RocksDB with change logs, bounded memory for each executor, and no preallocated files, of which each partition would hold megabytes.
STATE_STORE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "rocksdb.changelogCheckpointing.enabled": "true",
    "rocksdb.boundedMemoryUsage": "true",
    "rocksdb.maxMemoryUsageMB": "256",
    "rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """text without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _rank(id_col: str) -> Column:
    """Most code points, then the smallest id (nulls last), then the smallest locator: the least of this struct stays."""
    return F.struct((-F.length(F.coalesce(F.col("__t"), F.lit("")))).alias("n"), F.col("__id").isNull().alias("z"), F.col("__id").alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"))


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def as_pattern(path: str) -> str:
    """A pattern that only this path meets: the file source takes a single file only as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path[:-1]) + f"[{path[-1]}]"


def stream_state(spark: SparkSession, path: str, checkpoint: str, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256_of, max_bytes_per_trigger: str | None = None) -> DataFrame:
    """Run the stream over the Parquet files at path that the checkpoint has not seen, then read the state: (digest, keep, size)."""
    schema = spark.read.parquet(path).schema
    wanted = {f"spark.sql.streaming.stateStore.{k}": v for k, v in STATE_STORE.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema)
        if max_bytes_per_trigger:
            stream = stream.option("maxBytesPerTrigger", max_bytes_per_trigger)
        # files of any age: the default leaves out those a week older than the newest one seen
        rows = _rows(stream.option("maxFileAge", "36500d").parquet(as_pattern(path)), id_col, text_col)
        held = rows.groupBy(digest(normalised(F.col("__t"))).alias("digest")).agg(F.min(_rank(id_col)).alias("keep"), F.count("*").alias("size"))
        query = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.format("statestore").load(checkpoint).select(F.col("key.*"), F.col("value.*")).toDF("digest", "keep", "size")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _there(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_of, checkpoint: str | None = None, max_bytes_per_trigger: str | None = None) -> DataFrame:
    """One row per row of the Parquet table at path: id_col, keep_id, group_size, kept, digest.

    checkpoint: the state's place; given again, texts are read only of new files, and of files that hold members of groups
    that new rows came into. Beside it stand the narrow rows of all files seen. The table must hold every file that the
    state has seen.
    """
    whole = spark.read.parquet(path)
    kind = whole.schema[id_col].dataType.simpleString()
    if whole.limit(1).isEmpty():
        return spark.createDataFrame([], f"`{id_col}` {kind}, keep_id {kind}, group_size long, kept boolean, digest binary")
    place = checkpoint.rstrip("/") if checkpoint else scratch(spark, "dedup-state")
    state = table(stream_state(spark, path, place, id_col, text_col, digest, max_bytes_per_trigger), "dedup-held")
    held = state.select("digest", F.col("keep.id").alias("__kid"), F.col("keep.file").alias("__kfile"), F.col("keep.row").alias("__krow"), "size")
    norm, file = normalised(F.col("__t")), F.col("_metadata.file_path")

    def rows_of(files: list[str] | None) -> DataFrame:
        return _rows(whole if files is None else whole.where(file.isin(files)), id_col, text_col)

    # narrow rows: what the result is made of. One row a file reaches the driver
    narrow = lambda df: df.select("__id", "__file", "__row", digest(norm).alias("digest"))
    schema, new = narrow(rows_of(None)).schema, None
    if _there(spark, f"{place}-rows"):
        seen = spark.read.schema(schema).parquet(f"{place}-rows").select("__file").distinct()
        every = whole.select(file.alias("__file")).distinct()
        new = [r[0] for r in every.join(seen, "__file", "left_anti").collect()]
    narrow(rows_of(new)).write.mode("append").parquet(f"{place}-rows")
    keyed = spark.read.schema(schema).parquet(f"{place}-rows")
    # a row without a state would be lost by an inner join: it is an error
    known = F.when(F.col("size").isNull(), F.raise_error(F.lit("exact_dedup: a row's digest is not in the state; was the table changed under the stream?"))).otherwise(F.col("size"))
    joined = keyed.join(held, "digest", "left").withColumn("size", known)
    own = (F.col("__file") == F.col("__kfile")) & (F.col("__row") == F.col("__krow"))
    # full bytes of all members of the groups that new rows are in: equal if the least and the greatest are, which combines before the shuffle
    shared = held.where("size > 1").select("digest")
    if new is not None:
        shared = shared.join(keyed.where(F.col("__file").isin(new)).select("digest"), "digest", "left_semi")
    hits = keyed.join(shared, "digest", "left_semi").select("digest", F.col("__file").alias("__hfile"), F.col("__row").alias("__hrow"))
    files = None
    if new is not None:
        hits = table(hits, "dedup-members")
        files = [r[0] for r in hits.select("__hfile").distinct().collect()]
    texts = rows_of(files).select("__file", "__row", norm.cast("binary").alias("__norm"))
    wide = texts.join(hits, (F.col("__row") == F.col("__hrow")) & (F.col("__file") == F.col("__hfile")))
    wide = table(wide.select("digest", "__norm"), "dedup-hits")  # one shuffle of texts; only those of groups go on
    wrong = wide.groupBy("digest").agg(F.min("__norm").alias("a"), F.max("__norm").alias("b")).where("a <> b").select("digest")
    wrong.write.mode("append").parquet(f"{place}-wrong")
    wrong = spark.read.schema(wrong.schema).parquet(f"{place}-wrong").distinct()
    drop(wide)
    fine = joined.select(F.col("__id").alias(id_col), F.col("__kid").alias("keep_id"), F.col("size").alias("group_size"), own.alias("kept"), "digest")
    if wrong.isEmpty():
        return fine
    again = rows_of(None).select("__id", "__t", "__file", "__row", digest(norm).alias("digest"), norm.cast("binary").alias("__norm")).join(wrong, "digest", "left_semi")
    groups = again.groupBy("digest", "__norm").agg(F.min(_rank(id_col)).alias("__keep"), F.count("*").alias("group_size"))
    exact = again.join(groups, ["digest", "__norm"]).select(F.col("__id").alias(id_col), F.col("__keep.id").alias("keep_id"), "group_size", ((F.col("__file") == F.col("__keep.file")) & (F.col("__row") == F.col("__keep.row"))).alias("kept"), "digest")
    return fine.join(wrong, "digest", "left_anti").select(id_col, "keep_id", "group_size", "kept", "digest").unionByName(exact)
