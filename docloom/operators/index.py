"""The index as users see it: documents in, boolean queries, ids newest first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import expressions as x
from .postings import postings


class Found:
    """A query bound to an index; combine with &, | and ~."""

    def __init__(self, index: DocIndex, expr: x.Expr):
        self.index, self.expr = index, expr

    def __and__(self, other: Found) -> Found:
        return Found(self.index, self.expr & other.expr)

    def __or__(self, other: Found) -> Found:
        return Found(self.index, self.expr | other.expr)

    def __invert__(self) -> Found:
        return Found(self.index, ~self.expr)

    def to_df(self) -> DataFrame:
        """Distinct doc_ids in no order."""
        return self.index.ids(self.expr)

    def ids_desc(self) -> DataFrame:
        return self.to_df().orderBy(F.desc("doc_id"))


class DocIndex:
    """Documents (doc_id, created, die) with their texts or with stored postings."""

    def __init__(self, docs: DataFrame, pairs: DataFrame | None = None):
        for c in ("created", "die"):
            if c not in docs.columns:
                docs = docs.withColumn(c, F.lit(None).cast("timestamp_ntz"))
        self.docs, self.pairs = docs, pairs

    @classmethod
    def from_documents(cls, docs: DataFrame) -> DocIndex:
        """Search texts as they are: each query is one filter over one scan."""
        return cls(docs)

    @classmethod
    def from_postings(cls, pairs: DataFrame, docs: DataFrame) -> DocIndex:
        """Search stored (term, rterm, doc_id): filters on sorted Parquet, then joins on ids."""
        return cls(docs, pairs)

    def postings(self) -> DataFrame:
        return self.pairs if self.pairs is not None else postings(self.docs)

    def ids(self, expr: x.Expr) -> DataFrame:
        if self.pairs is not None:
            return x.matching_ids(expr, self.pairs, self.docs)
        return self.docs.where(x.predicate(expr)).select("doc_id")

    def precise(self, query: str) -> Found:
        return Found(self, x.precise(query))

    def wildcard(self, query: str) -> Found:
        return Found(self, x.wildcard(query))

    def created_between(self, start: datetime, end: datetime) -> Found:
        return Found(self, x.created_between(start, end))

    def valid_throughout(self, start: datetime, end: datetime) -> Found:
        return Found(self, x.valid_throughout(start, end))
