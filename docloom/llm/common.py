"""Expressions and helpers that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import hadoop, passing_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="docloom-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  `lower` is far faster and says the same of ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def _no_empty(words: Column) -> Column:
    return F.coalesce(F.array_remove(words, ""), F.array().cast("array<string>"))


def space_words(c: Column) -> Column:
    """Runs of other characters than space and \\t to \\r, in order; a null text has none.

    Replacing bytes and splitting at one space needs no regular expression.
    """
    for space in "\t\n\x0b\f\r":
        c = F.replace(c, F.lit(space), F.lit(" "))
    return _no_empty(F.split(c, " "))


def alnum_words(c: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII, case as it is."""
    return _no_empty(F.split(c, NON_WORD))


def flags(numbers: str) -> Column:
    """A column of sorted distinct numbers as bytes, a 1 at each number: one look tells whether a number is there."""

    def gap(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col(numbers), i.cast("int") - 1), F.lit(-1))
        return F.concat(F.repeat(F.lit("0"), (x - before - 1).cast("int")), F.lit("1"))

    return F.array_join(F.transform(numbers, gap), "").cast("binary")


def flagged(marks: Column, i: Column) -> Column:
    """Whether the flags have number i (an int)."""
    return F.substring(marks, i + 1, F.lit(1)) == F.lit(b"1")


def text_key(c: Column) -> list[Column]:
    """128 bits of a text as two longs, `_k1` and `_k2`.  Null and empty differ.

    Operators that depend on the text alone group by (doc_id, these), which
    keeps rows apart where ids repeat or are null.
    """
    return [
        F.xxhash64(c, c.isNull()).alias("_k1"),
        F.xxhash64(F.lit(1), c, c.isNull()).alias("_k2"),
    ]


def packed(docs: DataFrame) -> DataFrame:
    """row (all columns as a struct), doc_id, _k1, _k2: keyed rows whose columns can't clash with ours."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(own, F.col("doc_id"), *text_key(F.col("text")))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of the packed rows, those in `new` replaced."""
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that one operator writes on its way, in the folder that all executors share.

    `settle` computes a frame once and reads it back, so that a lost executor costs no
    rerun and later steps read only the columns they need.  `close` removes all tables
    but those that the operator's lazy result still reads; these go with the session.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, passing_folder(spark, "scratch"), {}

    def settle(self, df: DataFrame) -> DataFrame:
        """The shuffles that led here are removed at once; nothing reads them again."""
        path, before = f"{self.folder}/{len(self.tables)}", self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[path] = table
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        for path in [p for p, t in self.tables.items() if any(t is x for x in tables)]:
            self.tables[path] = None
            p, fs = hadoop(self.spark, path)
            fs.delete(p, True)

    def close(self, *kept: DataFrame) -> None:
        self.drop(*(t for t in self.tables.values() if t is not None and not any(t is x for x in kept)))


def settle(df: DataFrame) -> DataFrame:
    """A small table that an operator's result reads; it goes with the session."""
    return Scratch(df.sparkSession).settle(df)


#: Rows of keys that may be broadcast, some 40 bytes each.
MAX_KEYS = 1_000_000


def bounded(keys: DataFrame) -> DataFrame:
    """`keys`, settled rows of a few numbers, to be broadcast if they are counted small."""
    return F.broadcast(keys) if keys.count() <= MAX_KEYS else keys
