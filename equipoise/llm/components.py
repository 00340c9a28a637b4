"""Connected components of an edge table, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import stored


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: bigint); the label is the
    smallest node of the component.

    Alternates large-star and small-star steps (logarithmic in the diameter). Both
    take the minimum of a node's neighbours by a partial aggregation and join it
    back, so no neighbour list is ever gathered: a hub with millions of links is
    an ordinary skewed join."""
    e = stored(spark, edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _print(e)
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(spark, both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.toDF("a", "b"))
        e = stored(spark, small.filter("a <> b").distinct())
        now = _print(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _print(e: DataFrame) -> tuple:
    """Size and order-free 128-bit fingerprint of an edge table."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())
