"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before kept, written as Parquet and read again. All
but the last return the columns of documents, whatever further columns there are and whatever their names.

Cases: a null or empty text has no words and goes in the first stage; called by itself, each later stage takes it as its
operator does (line dedup and mixing pass it on, near-dedup keeps one of all texts without words, BPE gives no tokens).
Null ids are rows like any other: in line dedup they come first, in near-dedup last. Rows that repeat both id and text
share their fate. Ties go by id. Texts of any length are worked on whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_transducer, line_dedup, quality_bands, similar, temperature_mix
from .common import drop, read, table
from .queries import vocabulary

#: Fingerprints of 64 bits within which two texts are tried first; what links them is the similarity of their shingles.
NEAR_BITS = 6


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_bands.keep(docs, bands=quality_bands.calibrate(docs, read(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go, and documents of which nothing is left. n_chars follows the text."""
    out = line_dedup.marked(docs).where("n_removed = 0 or length(kept) > 0")
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long"))
    new = {"text": F.col("kept"), "n_chars": F.coalesce(size, F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles at a Jaccard similarity of 0.8 or more."""
    return similar.keep_one_similar(docs, shingle=5, percent=80, radius=NEAR_BITS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights; a document appears once for each pass that takes it."""
    return temperature_mix.mixture(docs).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe_transducer.encode_decode(docs, vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
        drop(before)  # a stage's table, once the next one stands; never the input
    return STAGES[-1][1](spark, docs, sf_dir)
