"""A time stamp as the set of its one bits, and ranges evaluated on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bit 63 is the sign: times before 1970 are negative seconds.
BITS = 64


def seconds(c):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def bit_slices(docs: DataFrame, column: str = "created") -> DataFrame:
    """(bit, doc_id): the bits of the whole seconds since 1970; a null time has none, nor has 0."""
    u = docs.select("doc_id", seconds(column).alias("u")).where("u is not null")
    every = u.select("doc_id", "u", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit"))
    return every.where(F.getbit("u", F.col("bit")) == 1).select("bit", "doc_id")


def _values(slices: DataFrame) -> DataFrame:
    """(doc_id, u): each document's bits folded to its seconds; those of 0 seconds have no row."""
    return slices.groupBy("doc_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("u"))


def at_least(slices: DataFrame, docs: DataFrame, bound: int) -> DataFrame:
    """doc_ids of docs (those with a time) whose seconds, known by their slices only, are at least `bound`."""
    if bound > 0:
        return _values(slices).where(F.col("u") >= bound).select("doc_id")
    below = _values(slices).where(F.col("u") < bound).select("doc_id")
    return docs.select("doc_id").join(below, "doc_id", "left_anti")


def at_most(slices: DataFrame, docs: DataFrame, bound: int) -> DataFrame:
    """doc_ids of docs (those with a time) whose seconds are `bound` at most."""
    if bound < 0:
        return _values(slices).where(F.col("u") <= bound).select("doc_id")
    above = _values(slices).where(F.col("u") > bound).select("doc_id")
    return docs.select("doc_id").join(above, "doc_id", "left_anti")


def valid_throughout(created: DataFrame, die: DataFrame, docs: DataFrame, start: int, end: int) -> DataFrame:
    """doc_ids created by `start` that don't die before `end`, by slices of both times; a null `die` is never."""
    born = at_most(created, docs.where("created is not null"), start)
    below = _values(die).where(F.col("u") < end).select("doc_id")
    if end > 0:  # no slice: the second 0, or no time at all
        at_zero = docs.where("die is not null").select("doc_id").join(_values(die), "doc_id", "left_anti")
        below = below.unionByName(at_zero)
    return born.join(below, "doc_id", "left_anti")
