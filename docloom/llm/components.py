"""Connected components of a graph of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(pairs: DataFrame, small: bool) -> DataFrame:
    """Link each neighbour of u to u's least neighbour: the greater ones, or the lesser and u."""
    if small:
        sym = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    else:
        sym = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = sym.join(least, "u")
    if small:
        own = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(own)
    else:
        out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of `links` (a, b: longs); root is the component's least node.

    Rounds grow with the logarithm of the longest chain; each is settled in the
    shared folder (by `scratch`, if given).  No group is collected: a hub meets its links
    in joins alone.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    scratch = scratch or Scratch(links.sparkSession)
    pairs, before = scratch.settle(pairs), None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "a", "b"))).first()
        if state == before or not state[0]:
            break
        before, last = state, pairs
        pairs = scratch.settle(_stars(_stars(pairs, small=False), small=True))
        scratch.drop(last)
    roots = pairs.select("a").distinct()
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        roots.select(F.col("a").alias("node"), F.col("a").alias("root"))
    )
