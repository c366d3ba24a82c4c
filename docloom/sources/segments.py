"""Postings stored as segments of sorted Parquet, merged level by level.

A segment is a folder `segment=<level>~<id>` with (term, rterm, bucket, doc_ids, n).
Its files are sorted by term, so that a term or prefix touches few pages of each; a
Parquet bloom filter on term spares the rest.  New segments are dealt to files by hash,
in one pass over the texts; merged ones are range-partitioned, so that a term or prefix
touches few files, too (bounds take a second pass, which is cheap over stored lists).
A list holds the ids of one bucket of
65 536, so no row grows with the corpus.  Segments appear by one rename.  New ones are
of level 0; once a level has `fan_in` of them, they are merged into one of the next
level, so an id is rewritten once a level.  A merged segment lists in `_merged` those
that it stands for, which don't count from then on; so a reader sees the old ones or the
new one, and ids never get lost or counted twice.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hadoop, note_of, parts, publish

SCHEMA = "term string, rterm string, bucket bigint, doc_ids array<bigint>, n bigint"


def bucket_of(doc_id: Column) -> Column:
    """65 536 successive ids make a bucket."""
    return F.shiftright(doc_id, 16)


def _listed(rows: DataFrame, ids: Column) -> DataFrame:
    """(term, rterm, bucket, doc_ids, n), in the order of `rows`; lists are sorted and distinct."""
    rows = rows.groupBy("term", "bucket").agg(F.array_distinct(F.sort_array(ids)).alias("doc_ids"))
    return rows.select("term", F.reverse("term").alias("rterm"), "bucket", "doc_ids", F.size("doc_ids").cast("long").alias("n"))


def merge_lists(rows: DataFrame) -> DataFrame:
    """One list of ids per term and bucket from many; whole lists travel, once, not their ids."""
    rows, n = rows.select("term", "bucket", "doc_ids"), parts(rows)
    rows = rows.repartitionByRange(*([n] if n else []), "term", "bucket").sortWithinPartitions("term", "bucket")
    return _listed(rows, F.flatten(F.collect_list("doc_ids")))


def lists(pairs: DataFrame) -> DataFrame:
    """(term, rterm, bucket, doc_ids, n) of postings (term, doc_id), which travel once."""
    rows, n = pairs.select("term", bucket_of(F.col("doc_id")).alias("bucket"), "doc_id"), parts(pairs)
    rows = rows.repartition(*([n] if n else []), "term", "bucket").sortWithinPartitions("term", "bucket")  # sorting ids in their lists costs less
    return _listed(rows, F.collect_list("doc_id"))


_ordered, _lock = [0, None], threading.Lock()


@contextmanager
def _by_order(spark: SparkSession):
    """Groups of sorted rows are put together as they come; a hash table of lists would sort all rows again.

    The setting is put back when the last of the threads that write is done.
    """
    name = "spark.sql.execution.replaceHashWithSortAgg"
    with _lock:
        if not _ordered[0]:
            _ordered[1] = spark.conf.get(name, None)
            spark.conf.set(name, "true")
        _ordered[0] += 1
    try:
        yield
    finally:
        with _lock:
            _ordered[0] -= 1
            if not _ordered[0]:
                spark.conf.unset(name) if _ordered[1] is None else spark.conf.set(name, _ordered[1])


class SegmentStore:
    def __init__(self, spark: SparkSession, folder: str, fan_in: int = 5):
        self.spark, self.folder, self.fan_in = spark, folder.rstrip("/"), fan_in

    def _listed(self) -> tuple[list[str], set[str]]:
        """Segments that count, and those that others stand for."""
        p, fs = hadoop(self.spark, self.folder)
        if not fs.exists(p):
            return [], set()
        names = {s.getPath().getName().removeprefix("segment=") for s in fs.listStatus(p) if s.getPath().getName().startswith("segment=")}
        merged = {m for name in names if not name.startswith("0~") for m in note_of(self.spark, f"{self.folder}/segment={name}/_merged").split()}
        return sorted(names - merged), merged

    def segments(self) -> list[str]:
        return self._listed()[0]

    def levels(self) -> dict[int, list[str]]:
        """Segments by level."""
        out: dict[int, list[str]] = {}
        for name in self.segments():
            out.setdefault(int(name.split("~")[0]), []).append(name)
        return out

    def _put(self, rows: DataFrame, name: str, merged: set[str] = frozenset()) -> bool:
        # The bloom filter takes the size that fits the terms of a file.
        options = {"parquet.bloom.filter.enabled#term": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        note = ("_merged", "\n".join(sorted(merged))) if merged else None
        rows = rows.sortWithinPartitions("term", "bucket")  # no work on rows in order
        with _by_order(self.spark):
            return publish(self.spark, rows, f"{self.folder}/segment={name}", f"{self.folder}/tmp", lambda w: w.options(**options), note)

    def append(self, pairs: DataFrame, name: str) -> bool:
        """Store postings (term, rterm, doc_id); False if the segment is there already."""
        if f"0~{name}" in self._listed()[1]:
            return False
        return self._put(lists(pairs), f"0~{name}")

    def _rows(self, names: list[str]) -> DataFrame:
        paths = [f"{self.folder}/segment={s}" for s in names]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def rows(self) -> DataFrame:
        """All segments' rows; a term has one a bucket in each segment that holds it."""
        return self._rows(self.segments())

    def postings(self) -> DataFrame:
        """(term, rterm, doc_id) of all segments; filters on term reach the files."""
        return self.rows().select("term", "rterm", F.explode("doc_ids").alias("doc_id"))

    def lookup(self, term: str) -> DataFrame:
        """Distinct doc_ids of a term over all segments."""
        return self.rows().where(F.col("term") == term).select(F.explode("doc_ids").alias("doc_id")).distinct()

    def _merge(self, names: list[str], level: int) -> bool:
        old = {m for n in names for m in note_of(self.spark, f"{self.folder}/segment={n}/_merged").split()}
        if not self._put(merge_lists(self._rows(names)), f"{level}~{uuid.uuid4().hex}", old | set(names)):
            return False
        for name in names:
            p, fs = hadoop(self.spark, f"{self.folder}/segment={name}")
            fs.delete(p, True)
        return True

    def compact(self, force: bool = False) -> bool:
        """Merge every level that has `fan_in` segments into the next, from the lowest up; with
        `force`, all segments into one.  For a single maintainer."""
        if force:
            names = self.segments()
            return len(names) > 1 and self._merge(names, max(self.levels()) + 1)
        level, done = 0, False
        while level <= max(self.levels(), default=-1):
            own = self.levels().get(level, [])
            if len(own) >= self.fan_in:
                done = self._merge(own, level + 1) or done
            level += 1
        return done

    def clear(self) -> None:
        p, fs = hadoop(self.spark, self.folder)
        fs.delete(p, True)
