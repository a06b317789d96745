"""Mixing sources to target weights: temperature mixing, and budgeted block permutations.

A source's share of the tokens is raised to an exponent and normalised. Exponent 1 keeps the natural mixture, 0 makes all
sources equal. The exponent is bisected between the two until the mixture's entropy is a given part of the greatest
possible (a natural mixture that is flatter already stays as it is), or, where that would repeat a source more often than
the limit, until the limit is met. A source's budget is its weight of the
whole budget, in tokens, by largest remainder.

A budget becomes documents by blocks: a source's documents are dealt by hash into blocks of about block_tokens, each pass
over the source takes its blocks in a permutation of its own, and the last pass stops at the budget, inside one block
between documents. So a source of any size is never ordered as a whole: running sums are over blocks, and inside the one
block where the budget ends.

A token is a word, a run of characters that are not ASCII white space. Hashes are of md5, the same in any engine.

All of it is one way for any number of sources: the exponent comes from aggregates over the table of sources, each for 63
exponents at once, and largest remainders from range-sorted parts and their counts. What reaches the driver is one row
for each exponent and each part. One (source, pass) has its blocks ordered by one task: a row for a million tokens.

Cases: null text has no tokens and comes along with its block. A null source is a source. A row with a null id is dealt
by its text's hash; null ids and repeated rows are rows like any other. Of equal hashes in the last block, ties go by id
and then by text. A source without tokens gets no budget. Very long texts are one document. Extra columns are returned as
they are, whatever their names; only one that has the name of a result column gives way to it. An empty table gives an
empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, settled, table

TOKEN = r"[^\x20\x09-\x0D]+"
#: A table of sources is broadcast to the documents up to this many rows, by count; beyond, it is joined.
BROADCAST_SOURCES = 100_000
#: Exponents tried at once: each step narrows the interval to one in as many and one parts; ten steps make 2 ** -60.
AT_ONCE, STEPS = 63, 10


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def hash60(*parts: Column) -> Column:
    """60 bits of the md5 of the parts, joined by colons."""
    whole = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def bisect(f: Callable[[list[float]], list[float]], goal: float, low: float, high: float) -> float:
    """Where the falling function f meets goal. f takes a list of places at once."""
    for _ in range(STEPS):
        at = [low + (high - low) * k / (AT_ONCE + 1) for k in range(AT_ONCE + 2)]
        above = sum(y > goal for y in f(at[1:-1]))
        low, high = at[above], at[above + 1]
    return (low + high) / 2


def exponent(per: DataFrame, k: int, total: int, entropy_part: float, max_repeat: float | None, budget: int) -> float:
    """per: n, the tokens of each of k sources, none zero."""
    if k < 2:
        return 1.0
    p = F.col("n") / F.lit(float(total))

    def sums(at: list[float]) -> list:
        """By exponent: the sum of p ** a, of that times ln p, and the most tokens wanted for one there are."""
        tried = per.select("n", F.explode(F.array(*(F.lit(a) for a in at))).alias("a"))
        w = F.pow(p, F.col("a"))
        got = {r.a: r for r in tried.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log(p)).alias("e"), F.max(w / F.col("n")).alias("m")).collect()}
        return [got[a] for a in at]

    entropy = lambda at: [math.log(r.z) - r.a * r.e / r.z for r in sums(at)]
    repeats = lambda at: [r.m / r.z * budget for r in sums(at)]
    a = bisect(entropy, entropy_part * math.log(k), 0.0, 1.0)
    if max_repeat and repeats([a])[0] > max_repeat and budget <= max_repeat * total:
        a = bisect(repeats, max_repeat, min(a, 1.0), 1.0)
    return a


def budgets(per: DataFrame, a: float, total: int, budget: int) -> DataFrame:
    """per with budget: tokens for each source; what rounding leaves goes to the largest remainders, ties by name."""
    power = F.pow(F.col("n") / F.lit(float(total)), F.lit(a))
    z = per.agg(F.sum(power)).first()[0]
    floored = per.withColumn("x", power / F.lit(z) * F.lit(float(budget))).withColumn("f", F.floor("x").cast("long"))
    rest = budget - floored.agg(F.sum("f")).first()[0]
    mid = F.monotonically_increasing_id()  # the part in the upper bits, the place in it in the lower 33
    order = [F.expr("f - x"), F.col("__s").asc_nulls_last()]
    placed = table(floored.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftrightunsigned(mid, 33).alias("part"), mid.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "mix-remainders")
    # in how many places of a part a token is added: all of the first parts, some of one, none of the others
    starts, left = [], max(0, rest)
    for part, n in sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, min(n, left)))
        left -= min(n, left)
    more = per.sparkSession.createDataFrame(starts, "part long, upto long")
    return placed.join(more, "part").select("__s", "n", (F.col("f") + F.when(F.col("place") < F.col("upto"), 1).otherwise(0)).alias("budget"))


def plan(rows: DataFrame, entropy_part: float, max_repeat: float | None, budget: int | None, block_tokens: int) -> DataFrame:
    """rows: __s, __n. (__s, n, budget, blocks) for each source with tokens."""
    per = table(rows.groupBy("__s").agg(F.sum("__n").alias("n")).where("n > 0"), "mix-sources")
    k, total = per.agg(F.count("*"), F.sum("n")).first()
    if not k:
        return rows.sparkSession.createDataFrame([], "__s string, n long, budget long, blocks long")
    budget = int(total) if budget is None else budget
    got = budgets(per, exponent(per, k, total, entropy_part, max_repeat, budget), total, budget)
    return got.select("__s", "n", "budget", F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens)).cast("long").alias("blocks"))


RESULT = {"n_tokens": "__n_tokens", "pass": "__pass", "block": "__block", "rank": "__rank"}


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy_part: float = 0.95, max_repeat: float | None = 4.0, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """df's rows, one for each time that the mixture takes them, with __n_tokens, __pass, __block and __rank (the block's place in its pass).

    budget: tokens in all; the table's own number if not given. The order of training is (__pass, __rank, hash of the id) in each source.
    """
    out = mixture(df, id_col, source_col, text_col, entropy_part, max_repeat, budget, block_tokens, seed)
    old = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in RESULT.values()]
    return out.select(*old, *(F.col(k).alias(v) for k, v in RESULT.items()))


def mixture(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy_part: float = 0.95, max_repeat: float | None = 4.0, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17) -> DataFrame:
    """(row, n_tokens, pass, block, rank), row being all columns of df in one."""
    s, i, t = (F.col(f"`{c}`") for c in (source_col, id_col, text_col))
    # what a row is dealt by: its id, and its text where it has none
    own = F.coalesce(i.cast("string"), F.concat(F.lit("\\N:"), F.md5(F.coalesce(t, F.lit("")).cast("binary"))))
    at = hash60(F.lit(seed), F.lit("block"), own)
    narrow = settled(df.select(s.cast("string").alias("__s"), tokens(t).alias("__n"), at.alias("__h")), "mix-rows")
    per = table(plan(narrow, entropy_part, max_repeat, budget, block_tokens), "mix-plan")
    p = per.withColumnRenamed("__s", "__ps")
    blocks = narrow.join(p, F.col("__s").eqNullSafe(F.col("__ps"))).groupBy("__ps", (F.col("__h") % F.col("blocks")).alias("__b")).agg(F.sum("__n").alias("bn"), F.first("n").alias("n"), F.first("budget").alias("budget"))
    # an exact quotient: floating division is exact enough only below 2 ** 53, so the rest is taken by the integer remainder
    times, rest = F.expr("budget div n"), F.col("budget") % F.col("n")
    passes = blocks.withColumn("__pass", F.explode(F.sequence(F.lit(0).cast("long"), times)))
    order = Window.partitionBy("__ps", "__pass").orderBy(hash60(F.lit(seed), F.lit("pass"), F.col("__pass"), F.col("__ps"), F.col("__b")), "__b")
    ranked = passes.withColumns({"__rank": F.row_number().over(order).cast("long"), "cum": F.sum("bn").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    full, before = F.col("__pass") < times, F.col("cum") - F.col("bn")
    taken = ranked.where(full | (before < rest)).withColumn("need", F.when(~full & (F.col("cum") > rest), rest - before))
    taken = table(taken.select("__ps", "__b", "__pass", "__rank", "need"), "mix-taken")
    drop(narrow)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    sized = df.select(row.alias("row"), s.cast("string").alias("__s"), tokens(t).alias("n_tokens"), at.alias("__h"), hash60(F.lit(seed), F.lit("doc"), own).alias("__d"), i.alias("__i"), F.xxhash64(t).alias("__t"))
    few = per.count() <= BROADCAST_SOURCES
    sources = p.select("__ps", "blocks")
    blocked = sized.join(F.broadcast(sources) if few else sources, F.col("__s").eqNullSafe(F.col("__ps"))).withColumn("block", F.col("__h") % F.col("blocks")).drop("blocks").withColumnRenamed("__ps", "__src")
    got = blocked.join(taken, F.col("__src").eqNullSafe(F.col("__ps")) & (F.col("block") == F.col("__b")))
    keep = ["row", "n_tokens", F.col("__pass").alias("pass"), "block", F.col("__rank").alias("rank")]
    whole = got.where("need is null").select(*keep)
    # the one block of a source in which its budget ends: documents by hash while they fit
    ends = Window.partitionBy("__src", "block", "__pass").orderBy("__d", "__i", "__t").rowsBetween(Window.unboundedPreceding, 0)
    cut = got.where("need is not null").withColumn("__sum", F.sum("n_tokens").over(ends)).where(F.col("__sum") <= F.col("need")).select(*keep)
    return whole.unionByName(cut)
