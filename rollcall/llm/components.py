"""Connected components by alternating large and small stars.

Every round sets beside each link the least neighbour of its end, twice.  A hub's links are dealt over
``SALTS`` tasks, each knows the hub's least neighbour from a table of at most as many rows a node, and
both sides come straight from their exchanges, so Spark may split a task's share once more.  Edges are
cut to the shared folder each round.  The driver sees two numbers a round, never links or components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

#: Tasks that share one key's rows.
SALTS = 32


def beside_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the least ``value`` of their ``key`` as ``name``; keys aren't null."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    shares = salted.groupBy(key, "_salt").agg(F.min(value).alias(name))
    least = shares.select(key, "_salt", F.min(name).over(Window.partitionBy(key)).alias(name))  # at most SALTS rows a key
    return salted.join(least, [key, "_salt"]).drop("_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    return beside_least(both, "u", "v", "m").filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return beside_least(down, "u", "v", "m").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node that an edge (a, b) names; root is the component's least node.

    Edges may repeat, loops and rows with a null end are ignored, and an empty table gives an
    empty result.  Node ids are of any type that can be ordered."""
    at = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = at.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        at = cut(_small_star(_large_star(at)).filter("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select("b", "b").distinct())
