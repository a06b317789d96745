"""Quality rules: word counts, repetition counts, and zstandard compression bands.

Compression ratio is bytes / compressed bytes. A whole text, and each fixed chunk of it, must stay inside a band that
depends on the length of the text: short texts compress less, so each length class has limits of its own. Too high a ratio is
repetition, too low is noise (keys, encoded binaries). calibrate() draws the upper limits in to what all labelled good
texts of a length class show, which also catches markup and symbol litter that repeats without repeating words.

Cases: null text counts as empty (no words, base_failed, not kept). Null and repeated ids pass through, a row for each
input row. Extra columns are ignored by measure() and returned as they are by keep(). An empty table gives an empty one.
A worker holds a piece of an Arrow batch as Python objects, a megabyte of text or one text that is longer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, pieces, table

SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]


@dataclass(frozen=True)
class Bands:
    """whole: (most bytes, least ratio, greatest ratio) by length class, the last without a bound. chunks: the same for
    chunks of chunk_bytes, by the length of the text that they are of, and the share of them that may be outside; a rest
    of under half a chunk joins the chunk before it."""

    whole: tuple[tuple[float, float, float], ...] = ((362, 1.0, 2.6), (512, 1.0, 2.6), (724, 1.1, 2.8), (1024, 1.1, 2.8), (1448, 1.15, 3.0), (2048, 1.15, 3.0), (2896, 1.2, 3.1), (4096, 1.2, 3.1), (5792, 1.2, 3.3), (8192, 1.2, 3.3), (11585, 1.2, 3.5), (16384, 1.2, 3.5), (65536, 1.2, 3.8), (float("inf"), 1.2, 4.2))
    chunk_bytes: int = 2048
    chunks: tuple[tuple[float, float, float, float], ...] = ((8192, 1.15, 3.2, 0.3), (65536, 1.15, 3.2, 0.3), (float("inf"), 1.1, 3.4, 0.25))
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n >= 4:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            seen, mark = Counter(grams), bytearray(n)
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    mark[i : i + 3] = b"\1\1\1"
            repeat = sum(mark)
    return n, len(b"".join(words).decode("utf-8", "replace")), sum(map(raw.count, SYMBOLS)), len(lines) - len(set(lines)), repeat


def chunks(raw: bytes, size: int) -> list[bytes]:
    ends = list(range(size, len(raw), size))
    if ends and len(raw) - ends[-1] < size // 2:
        ends.pop()
    return [raw[a:b] for a, b in zip([0, *ends], [*ends, len(raw)], strict=True)]


def band_ratios(raw: bytes, z: zstandard.ZstdCompressor, b: Bands) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its chunks outside the band, and whether both are within limits."""
    if not raw:
        return 0.0, 0.0, True
    ratio = len(raw) / len(z.compress(raw))
    _, low, high = next(x for x in b.whole if len(raw) <= x[0])
    if len(raw) <= b.chunk_bytes:
        return ratio, 0.0, low <= ratio <= high
    parts = chunks(raw, b.chunk_bytes)
    _, lo, hi, share = next(x for x in b.chunks if len(raw) <= x[0])
    out = sum(not lo <= len(c) / len(z.compress(c)) <= hi for c in parts) / len(parts)
    return ratio, out, low <= ratio <= high and out <= share


def judge(raw: bytes, z: zstandard.ZstdCompressor, b: Bands) -> tuple:
    n, word_chars, symbols, dup, repeat = base_counts(raw)
    failed = n < b.min_words or 100 * repeat > b.max_repeat_percent * n
    ratio, out, fine = band_ratios(raw, z, b)
    return n, word_chars, symbols, dup, repeat, failed, ratio, out, fine and not failed


FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("zstd_ratio", "double"), ("bad_chunk_share", "double"), ("kept", "boolean")]
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per input row: the id, the counts, the ratios, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=bands.level)
        for batch in pieces(batches):
            rows = [judge(x.as_py() or b"", z, bands) for x in batch.column(1)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, ARROW[t]) for c, (_, t) in zip(cols, FIELDS, strict=True))], names=[id_col, *(n for n, _ in FIELDS)])

    slim = df.select(F.col(id_col), F.col(text_col).cast("binary").alias("__raw"))
    return in_arrow(slim, run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in FIELDS))


def keep(df: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows that pass, with all their columns."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=bands.level)
        for batch in pieces(batches):
            yield batch.filter(pa.array([judge((x.as_py() or "").encode(), z, bands)[-1] for x in batch.column(place)], pa.bool_()))

    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # any name may be a column's
    return in_arrow(plain, run, plain.schema).toDF(*df.columns)


def sized(df: DataFrame, id_col: str, text_col: str, bands: Bands) -> DataFrame:
    """measure(), the id in a struct k with the text's bytes: (i, n)."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return measure(df.select(F.struct(F.col(id_col).alias("i"), size.alias("n")).alias("k"), F.col(text_col).alias("t")), "k", "t", bands)


def by_length(n: Column, values: list, whole: tuple) -> Column:
    """Of values, one for each length class, that of a text of n bytes."""
    got = F.lit(values[-1])
    for x, (most, *_) in reversed(list(zip(values[:-1], whole[:-1], strict=True))):
        got = F.when(n <= int(most), F.lit(x)).otherwise(got)
    return got


#: Ratios are summed in steps of 2 ** -24, exactly, so that the limits don't hang on the order of rows.
STEP = 1 << 24


def fit(seen: DataFrame, labels: DataFrame, id_col: str, label_col: str, spread: float, least: int, bands: Bands) -> Bands:
    """calibrate() from sized() rows: only they, not texts, are joined with the labels."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__good")).distinct()
    rows = seen.where("not base_failed and k.i is not null").select(F.col("k.i").alias("i"), F.col("k.n").alias("n"), (F.col("zstd_ratio") * STEP).cast("long").cast("decimal(19,0)").alias("q"))
    rows = rows.join(good, F.col("i") == F.col("__good"), "left_semi")
    rank = by_length(F.col("n"), list(range(len(bands.whole))), bands.whole)
    limit = {}
    for r in rows.groupBy(rank.alias("k")).agg(F.count("*").alias("c"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss")).collect():
        if r.c >= least:
            s, ss = int(r.s), int(r.ss)
            limit[r.k] = (s + spread * math.sqrt(r.c * ss - s * s)) / r.c / STEP
    return replace(bands, whole=tuple((n, lo, min(hi, limit.get(k, hi))) for k, (n, lo, hi) in enumerate(bands.whole)))


def calibrate(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", spread: float = 5.0, least: int = 20, bands: Bands = Bands()) -> Bands:
    """bands with upper limits of whole texts at mean + spread standard deviations of good texts, where a length class has `least` of them; never above what they were.

    Fitted on all documents whose ids are labelled 1; one row for each length class reaches the driver.
    """
    seen = sized(df, id_col, text_col, replace(bands, chunk_bytes=1 << 62))  # chunks have no part in it
    return fit(seen, labels, id_col, label_col, spread, least, bands)


def calibrated(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", spread: float = 5.0, least: int = 20, bands: Bands = Bands()) -> DataFrame:
    """measure() under the bands of calibrate(), each text counted and compressed once: the limits are held against a table of what was measured."""
    seen = table(sized(df, id_col, text_col, bands), "quality")
    drawn = fit(seen, labels, id_col, label_col, spread, least, bands).whole
    kept = F.col("kept") & (F.col("zstd_ratio") <= by_length(F.col("k.n"), [x[2] for x in drawn], drawn))
    return seen.select(F.col("k.i").alias(id_col), *(n for n, _ in FIELDS[:-1]), kept.alias("kept"))
