"""Tokens of a text: runs of characters that aren't Unicode white space, as they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters with Unicode's White_Space property (Java's \s has the ASCII ones only).
SPACE_CLASS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACES = f"[{SPACE_CLASS}]+"


def tokens(text: Column) -> Column:
    """Array of tokens in order; of a null text, null."""
    return F.array_remove(F.split(text, SPACES), "")


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term), a row per token."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term"))


#: Keys below this one are of other features; what a term is salted with until its key isn't.
FIRST_KEY, SALT = 128, "salt"
#: Salts tried; a salt fails for one term in 512, so none is known to need more than 3.
SALTS = 16


def _key(term: Column) -> Column:
    """First 16 bits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 4), 16, 10).cast("int")


def _salted_key(term: Column) -> Column:
    """Key of a term whose own is below FIRST_KEY."""

    def again(a: Column, _: Column) -> Column:
        salted = F.when(a["key"] >= FIRST_KEY, a["term"]).otherwise(F.concat(a["term"], F.lit(SALT)))
        return F.struct(salted.alias("term"), F.when(a["key"] >= FIRST_KEY, a["key"]).otherwise(_key(salted)).alias("key"))

    start = F.struct(term.alias("term"), _key(term).alias("key"))
    salted = F.aggregate(F.sequence(F.lit(1), F.lit(SALTS)), start, again, lambda a: a["key"])
    failed = F.raise_error(F.concat(F.lit("no key for the term "), term)).cast("int")
    return F.when(salted >= FIRST_KEY, salted).otherwise(failed)


def feature_key(term: Column) -> Column:
    """First 16 bits of SHA-256 of the term as a number, the term salted until that is FIRST_KEY or more."""
    return F.when(_key(term) >= FIRST_KEY, _key(term)).otherwise(_salted_key(term))


def feature_keys(terms: Column) -> Column:
    """Array of the distinct feature keys of an array of terms; each term is hashed once."""
    hashed = F.transform(terms, lambda t: F.struct(t.alias("term"), _key(t).alias("key")))
    return F.array_distinct(F.transform(hashed, lambda h: F.when(h["key"] >= FIRST_KEY, h["key"]).otherwise(_salted_key(h["term"]))))
