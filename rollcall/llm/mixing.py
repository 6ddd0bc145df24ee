"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets share all words by weight; no target exceeds ``most`` times its source's words, and what is
cut off is shared again by weight.  Equal blocks of ``block_words`` words, or fewer where the least
target is small (a block is a 64th of it at most), are then allocated to
sources by highest quotients of (target over odd numbers), a source's blocks to its shards the same
way by shard size, and each shard lays its documents out in seeded order and takes its quota as a
run of blocks on that ring, from a seeded start: whole passes first, then part of one.  The run cuts
at most two documents of a shard, and no document is passed more than ``most`` times.

Shards are dealt by a seeded hash of the id, so a source with a third of all rows is spread over its
shards; there are at most ``most_shards`` for each source, and one task sorts thin rows of one
shard.  The driver holds one row, some 100 bytes, for each source: sources are a dimension, not data.

Edge cases: a null text has no word; the null source is one source, last in order; sources without a
word get target zero and documents without one aren't in the mix; rows that repeat an id are documents of their own; an empty table gives an
empty result; extra columns are carried by ``mix`` whatever their names.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import WORD, cut, packed, table, text_of

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 17
MOST_SHARDS = 4096
SEED = 20_011


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[Fraction]:
    """Shares of all words by weight, capped at ``most`` times each size, the excess reshared."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if weight[k] * level > most * sizes[k]}
        for k in over or open_:
            out[k] = Fraction(most * sizes[k]) if over else weight[k] * level
        if not over:
            break
        left -= sum(out[k] for k in over)
        open_ -= over
    return out


def sainte_lague(seats: int, votes: list[Fraction | int], caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / 1, / 3, / 5 ...; the earlier wins a tie.

    Seats start at the rounded proportional shares, which are the quotients above one level, and
    single seats then move to the highest quotient left, or from the lowest one given."""
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    caps = caps or [seats] * len(votes)
    seats = min(seats, sum(c for c, v in zip(caps, votes) if v))
    got = [min(c, math.floor(Fraction(v) * seats / total + Fraction(1, 2))) for v, c in zip(votes, caps)]
    short = seats - sum(got)
    if short > 0:
        heap = [(-Fraction(v) / (2 * g + 1), k) for k, (v, g, c) in enumerate(zip(votes, got, caps)) if v and g < c]
    else:
        heap = [(Fraction(v) / (2 * g - 1), -k) for k, (v, g) in enumerate(zip(votes, got)) if g]
    heapq.heapify(heap)
    while short:
        _, k = heapq.heappop(heap)
        if short > 0:
            got[k] += 1
            short -= 1
            if got[k] < caps[k]:
                heapq.heappush(heap, (-Fraction(votes[k]) / (2 * got[k] + 1), k))
        else:
            got[-k] -= 1
            short += 1
            if got[-k]:
                heapq.heappush(heap, (Fraction(votes[-k]) / (2 * got[-k] - 1), k))
    return got


def _shard_quotas(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One source's blocks over its shards: at most MOST_SHARDS rows."""
    rows = rows.sort_values("_shard")
    block, most = int(rows["_block"].iloc[0]), int(rows["_most"].iloc[0])
    words = [int(x) for x in rows["_words"]]
    rows["_quota"] = sainte_lague(int(rows["_blocks"].iloc[0]), words, [most * w // block for w in words])
    return rows[["_source", "_shard", "_words", "_quota"]]


def apportioned(rows: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most_shards: int = MOST_SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` (_id, _source, _size and others) with _source_size, _target, _words (the shard's),
    _quota (the shard's, in blocks), _block (words) and _from (the document's first word on its shard's ring)."""
    spark = rows.sparkSession
    totals = [(r["_source"], int(r["n"])) for r in rows.groupBy("_source").agg(F.sum("_size").alias("n")).collect()]
    totals.sort(key=lambda t: (t[0] is None, (t[0] or "").encode("utf-32-be", "surrogatepass")))
    want = targets([n for _, n in totals], weights, most)
    shards = [min(most_shards, max(1, -(-n // shard_words))) for _, n in totals]
    block_words = max(1, min([block_words, *(math.floor(t / 64) for t in want if t)]))
    blocks = sainte_lague(math.floor(sum(want) / block_words + Fraction(1, 2)), want, [most * n // block_words for _, n in totals])
    plan = spark.createDataFrame(
        [(s, n, float(t), k, b, block_words) for (s, n), t, k, b in zip(totals, want, shards, blocks)],
        "_source string, _source_size long, _target double, _shards int, _blocks long, _block long")
    at = rows.withColumn("_s", F.col("_source")).drop("_source").join(plan, F.col("_s").eqNullSafe(plan["_source"])).drop("_s")
    at = at.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id")), F.col("_shards")).cast("int"))
    sums = at.groupBy("_source", "_shard").agg(F.sum("_size").alias("_words"), F.first("_blocks").alias("_blocks"), F.first("_block").alias("_block"))
    sums = sums.withColumn("_most", F.lit(most))
    quota = sums.groupBy("_source").applyInPandas(_shard_quotas, "_source string, _shard int, _words long, _quota long")
    quota = quota.select(F.col("_source").alias("_qs"), F.col("_shard").alias("_qk"), "_words", "_quota")
    at = at.join(quota, F.col("_source").eqNullSafe(F.col("_qs")) & (F.col("_shard") == F.col("_qk"))).drop("_qs", "_qk", "_shards", "_blocks")
    ring = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed), "_id", "_size"), "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    return at.withColumn("_from", F.coalesce(F.sum("_size").over(ring), F.lit(0)))


def _arc(seed: int) -> dict[str, Column]:
    """Whole passes, and the two stretches that a part pass takes of a document, in its own words."""
    words, taken = F.col("_words"), F.col("_quota") * F.col("_block")
    size, at = F.col("_size"), F.col("_from")
    passes = F.when(words > 0, F.floor(taken / words)).otherwise(0).cast("long")
    rest = taken - passes * words
    start = F.when(words > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "_shard"), F.greatest(F.floor(words / F.col("_block")), F.lit(1))) * F.col("_block")).otherwise(0)
    stretch = lambda low, high: (F.least(F.greatest(low - at, F.lit(0)), size), F.least(F.greatest(high - at, F.lit(0)), size))
    (a, b), (c, d) = stretch(start, F.least(start + rest, words)), stretch(F.lit(0), F.greatest(start + rest - words, F.lit(0)))
    return {"_passes": passes, "_a": a, "_b": b, "_c": c, "_d": d}


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, **limits) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    thin = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), word_count().alias("_size"))
    at = apportioned(cut(thin), block_words=block_words, seed=seed, **limits).withColumns(_arc(seed))
    taken = F.col("_passes") * F.col("_size") + F.col("_b") - F.col("_a") + F.col("_d") - F.col("_c")
    return at.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED, **limits) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document once for each whole pass, and once more
    with the words that a part pass takes of it.  n_chars, where there is one, follows the text."""
    rows = packed(docs, _id=F.col("doc_id").cast("long"), _source=F.col("source").cast("string"), _size=word_count())
    at = apportioned(rows, block_words=block_words, seed=seed, **limits).withColumns(_arc(seed))
    some = lambda low, high: F.when((F.col(low) == 0) & (F.col(high) == F.col("_size")), text_of("_row.text")).otherwise(
        F.concat_ws(" ", F.slice(F.regexp_extract_all(text_of("_row.text"), F.lit(WORD), F.lit(0)), (F.col(low) + 1).cast("int"), (F.col(high) - F.col(low)).cast("int"))))
    whole = F.array_repeat(text_of("_row.text"), F.when(F.col("_size") > 0, F.col("_passes")).otherwise(0).cast("int"))
    parts = [F.when(F.col(high) > F.col(low), F.array(some(low, high))).otherwise(F.array().cast("array<string>")) for low, high in (("_a", "_b"), ("_c", "_d"))]
    at = at.withColumn("_text", F.explode(F.concat(whole, *parts)))
    given = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return at.select(*(given.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
