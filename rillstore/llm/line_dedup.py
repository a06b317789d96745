"""Line dedup: overlapping three-line windows, DataFrame functions only.

A text is split at line feeds. Each window of three consecutive lines that holds a word is hashed (128 bits, an MD5 of the
three lines' MD5s; windows count as equal if their hashes are, and bytes are not compared again); of equal windows
anywhere in the table, the first by (id, position) stays and every line that a later one covers goes. Covered positions
of overlapping windows are merged. Texts of fewer than three lines have no window and stay as they are.

Plan: one pass makes windows, each line hashed once; firsts are a grouped minimum with map-side combine, of which only
windows found twice go on; the join back to the windows is an equi-join of narrow rows whose hot keys adaptive execution
splits. Texts meet their removed positions in one join by row key.

Cases: null text counts as empty and is returned as null. Null ids sort first. Rows that repeat both id and text are one
occurrence and share its result. Very long texts are split whole. Extra columns are returned as they are, whatever their
names; only one that has the name of a result column gives way to it. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW = 3
WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(hashed: Column, size: int) -> Column:
    """(position, digest) of each window with a word. hashed: a column of (digest, has a word) by line."""
    starts = F.when(F.size(hashed) >= size, F.sequence(F.lit(0), F.size(hashed) - size)).otherwise(F.array().cast("array<int>"))

    def one(p: Column) -> Column:
        own = [F.get(hashed, p + k) for k in range(size)]
        word = own[0]["w"]
        for x in own[1:]:
            word = word | x["w"]
        return F.struct(p.alias("p"), F.when(word, F.unhex(F.md5(F.concat(*(x["h"] for x in own)).cast("binary")))).alias("h"))

    return F.filter(F.transform(starts, one), lambda x: x["h"].isNotNull())


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(__id, __key, covered): for each row key with a later occurrence, the sorted positions of its removed lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = F.transform(_lines(text), lambda x: F.struct(F.md5(x.cast("binary")).alias("h"), x.rlike(WORD).alias("w")))
    # a column of its own: a lambda would make the array anew for each element
    hashed = df.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__key"), each.alias("__each"))
    rows = hashed.select("__id", "__key", F.explode(_windows(F.col("__each"), size)).alias("__w"))
    win = table(rows.select("__id", "__key", F.col("__w.p").alias("__p"), F.col("__w.h").alias("__h")), "windows")
    place = F.struct("__id", "__key", "__p")
    first = win.groupBy("__h").agg(F.min(place).alias("__first"), F.max(place).alias("__last")).where("__first <> __last").select("__h", "__first")
    later = win.join(first, "__h").where(place > F.col("__first"))
    return later.groupBy("__id", "__key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("__p", F.col("__p") + size - 1))))).alias("covered"))


def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(row, n_lines, n_removed, kept) for each row of df, row being all its columns in one."""
    gone = removed_lines(df, id_col, text_col, size)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df.select(row.alias("row"), F.col(f"`{id_col}`").alias("i"), F.xxhash64(text_col).alias("k"), F.col(f"`{text_col}`").alias("t"))
    both = keyed.join(gone, (F.col("k") == F.col("__key")) & F.col("i").eqNullSafe(F.col("__id")), "left")
    both = both.select("row", "t", "covered", _lines(F.col("t")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    some = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    n = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long")
    return both.select("row", n.alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("covered").isNull(), F.col("t")).otherwise(some).alias("kept"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, new_col: str = "kept_text") -> DataFrame:
    """df with __n_lines, __n_removed and new_col, the text of the lines that stay."""
    new = {"__n_lines": F.col("n_lines"), "__n_removed": F.col("n_removed"), new_col: F.col("kept")}
    old = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in new]
    return marked(df, id_col, text_col, size).select(*old, *(c.alias(n) for n, c in new.items()))
