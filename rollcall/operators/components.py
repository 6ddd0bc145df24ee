"""Connected components of (left_id, right_id) edges by least-label propagation with pointer jumping.

Labels and edges are cut to the shared folder each round; the driver sees one count.  Joins are on
ids, so a round shuffles thin rows only, and partial aggregation keeps a hub out of one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all is one machine, as in tests."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rollcall-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id of each node's component, for every node that an edge names."""
    pairs = edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).filter("a <> b")
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        low = labels.join(near, F.col("id") == F.col("a")).select("id", "component", F.least("component", "m").alias("next"))
        up = low.select(F.col("id").alias("via"), F.col("next").alias("far"))
        new = cut(low.join(up, F.col("next") == F.col("via"), "left").select("id", "component", F.least("next", F.coalesce("far", "next")).alias("next")))
        moved = not new.filter("next <> component").isEmpty()
        labels = new.select("id", F.col("next").alias("component"))
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
