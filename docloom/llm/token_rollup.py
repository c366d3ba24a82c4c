"""Token counts kept as additive rollups that signed batches of changes maintain.

A batch is reduced to a delta per source, language and tokenizer version: inserted
documents add their tokens, deleted ones take them away and revised ones add the
difference.  Deltas are stored a folder per batch; a folder appears by one rename,
so a batch is there as a whole or not at all, and committing it again changes
nothing.  Of two writers of a batch that meet, the first rename wins.  Totals are sums of deltas, in any order; `compact` folds deltas into one.

Counting never shuffles texts.  Deltas are summed before the shuffle, so a source
with a third of all rows sends a row a task.

Defined cases.  Null or empty text: 0 tokens.  Null source or language: a group of
its own.  Very long text: whole in one row.  Ties: none, sums have no order.  Extra and
clashing columns are ignored.  An empty table: no totals.  Repeated rows count as often as they occur.  An empty batch commits.
Totals of a group may be negative if its deletes come first.
"""

from __future__ import annotations

import base64
import re
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import hadoop, note_of, publish
from .common import ship, space_words

GROUP = ["source", "lang", "tokenizer"]
#: Fixed value: how byte-level vocabularies of this kind cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_encodings: dict = {}


def words(text: Column) -> Column:
    return F.size(space_words(text)).cast("long")


def byte_pairs(spark: SparkSession, vocabulary: str):
    """A counter of byte-pair tokens; the file of ranks is read here and sent to the executors."""
    ship(spark)
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        if vocabulary not in _encodings:
            import tiktoken

            pairs = (line.split() for line in ranks.value.splitlines() if line)
            _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        encode = _encodings[vocabulary].encode_ordinary
        return pa.array([len(encode(x.as_py())) if x.is_valid else 0 for x in column], pa.int64())

    return count


def counted(docs: DataFrame, tokenizers: dict) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: a row per document and tokenizer version."""
    d = docs.select("doc_id", "source", "lang", *(F.coalesce(f(F.col("text")), F.lit(0)).alias(f"_{i}") for i, f in enumerate(tokenizers.values())))
    pairs = F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.col(f"_{i}").alias("tokens")) for i, name in enumerate(tokenizers)))
    return d.select("doc_id", "source", "lang", F.explode(pairs).alias("p")).select("doc_id", "source", "lang", "p.*")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.lit(1).cast("long").alias("docs"), "tokens")


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts out, new ones in; a document may change its source or language, too."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """The rollup stored in `folder`, a URI that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _folders(self) -> tuple[list[str], set[str]]:
        """Batches that count, and ids of all that were ever committed.

        A folded batch lists in `_folds` what it stands for; those don't count any more.
        """
        p, fs = hadoop(self.spark, f"{self.folder}/deltas")
        if not fs.exists(p):
            return [], set()
        there = {s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")}
        folded = {x for name in there if name.startswith("folded-") for x in note_of(self.spark, f"{self.folder}/deltas/batch={name}/_folds").split()}
        return sorted(there - folded), there | folded

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows (GROUP, docs, tokens); False if it is there already."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id) or batch_id.startswith("folded-"):
            raise ValueError(f"a batch id is letters, digits, _, . and -, not {batch_id!r}")
        if batch_id in self._folders()[1]:
            return False
        delta = changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return publish(self.spark, delta, f"{self.folder}/deltas/batch={batch_id}", f"{self.folder}/tmp")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the groups that have documents or tokens."""
        schema = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
        paths = [f"{self.folder}/deltas/batch={b}" for b in self._folders()[0]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        t = rows.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return t.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the batches into one; for a single maintainer.

        The folded batch appears by a rename, with the list of what it stands for, and
        from then on the others don't count; removing them only frees space.
        """
        batches, ids = self._folders()
        if len(batches) < 2:
            return
        rows = self.totals().select(*GROUP, F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens"))
        name = f"{self.folder}/deltas/batch=folded-{uuid.uuid4().hex}"
        if publish(self.spark, rows, name, f"{self.folder}/tmp", note=("_folds", "\n".join(sorted(ids)))):
            for b in batches:
                p, fs = hadoop(self.spark, f"{self.folder}/deltas/batch={b}")
                fs.delete(p, True)


def report(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals after three batches: all documents inserted, those with id % 10 = 3 deleted
    and those with id % 10 = 7 revised (a line with the source's name added).  The first
    batch is committed twice."""
    spark = docs.sparkSession
    tokenizers = {"words-1": words, "byte-bpe-50k": byte_pairs(spark, vocabulary)}
    rollup = TokenRollup(spark, folder)
    digit = F.pmod(F.col("doc_id"), F.lit(10))
    rows = counted(docs, tokenizers)
    rollup.commit("insert-all", inserts(rows))
    rollup.commit("insert-all", inserts(rows))
    rollup.commit("delete-3", deletes(counted(docs.where(digit == 3), tokenizers)))
    sevens = docs.where(digit == 7)
    new = sevens.withColumn("text", F.concat_ws("\n", "text", "source"))
    rollup.commit("revise-7", revisions(counted(sevens, tokenizers), counted(new, tokenizers)))
    return rollup.totals()
