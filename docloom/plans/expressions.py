"""Boolean queries as lazy trees, and their two compilations.

`predicate` makes one Column of a tree, for a table of whole documents: any nesting
of terms, wildcards and dates is then one filter in one scan, without a shuffle.
`matching_ids` makes a DataFrame, for stored postings: leaves become filters that
reach the Parquet scan, AND a left-semi join, AND NOT a left-anti join, OR a union.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRangeError, UnsupportedWildcardError
from ..functions.text import SPACE_CLASS, tokens

_SPACE = re.compile("[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Expr:
    def __and__(self, other: Expr) -> Expr:
        return And((*_parts(self, And), *_parts(other, And)))

    def __or__(self, other: Expr) -> Expr:
        return Or((*_parts(self, Or), *_parts(other, Or)))

    def __invert__(self) -> Expr:
        return self.of if isinstance(self, Not) else Not(self)


@dataclass(frozen=True)
class Terms(Expr):
    """Documents with a token that starts with `prefix` and ends with `suffix`, or equals `exact`."""

    exact: str | None = None
    prefix: str = ""
    suffix: str = ""

    @property
    def nothing(self) -> bool:
        """No token can match: it is never empty and holds no white space; a bare * matches none."""
        said = self.exact if self.exact is not None else self.prefix + self.suffix
        return not said or bool(_SPACE.search(said))


@dataclass(frozen=True)
class Between(Expr):
    """Documents created from `start` to `end`, both seconds included."""

    start: datetime
    end: datetime


@dataclass(frozen=True)
class Throughout(Expr):
    """Documents created by `start` that don't die before `end` (in whole seconds)."""

    start: datetime
    end: datetime


@dataclass(frozen=True)
class And(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Or(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


def _parts(e: Expr, kind: type) -> tuple[Expr, ...]:
    return e.parts if isinstance(e, kind) else (e,)


def precise(query: str) -> Expr:
    return Terms(exact=query)


def wildcard(query: str) -> Expr:
    """`p*`, `*s`, `p*s` (the two may overlap) or no `*`; a bare `*` finds nothing."""
    parts = query.split("*")
    if len(parts) > 2:
        raise UnsupportedWildcardError(f"more than one * in {query!r}")
    return Terms(exact=query) if len(parts) == 1 else Terms(prefix=parts[0], suffix=parts[1])


def created_between(start: datetime, end: datetime) -> Expr:
    return Between(*_range(start, end))


def valid_throughout(start: datetime, end: datetime) -> Expr:
    return Throughout(*_range(start, end))


def _range(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    if start > end:
        raise InvalidRangeError(f"the range starts at {start}, after its end at {end}")
    return start, end


def _second(t: datetime) -> Column:
    return F.expr(f"timestamp_ntz'{t.replace(microsecond=0, tzinfo=None).isoformat(sep=' ')}'")


def _in_time(e: Between | Throughout, created: Column, die: Column) -> Column:
    # Bounds are cut to the second, not the columns, so that they reach the scan.
    second = F.expr("interval 1 second")
    if isinstance(e, Between):
        return (created >= _second(e.start)) & (created < _second(e.end) + second)
    return (created < _second(e.start) + second) & (die.isNull() | (die >= _second(e.end)))


def predicate(e: Expr, text: Column | None = None, created: Column | None = None, die: Column | None = None) -> Column:
    """The tree as one condition on a row of documents; never null."""
    text, created, die = (F.col(n) if c is None else c for c, n in ((text, "text"), (created, "created"), (die, "die")))
    if isinstance(e, Not):
        return ~predicate(e.of, text, created, die)
    if isinstance(e, (And, Or)):
        both = (lambda a, b: a & b) if isinstance(e, And) else (lambda a, b: a | b)
        return reduce(both, [predicate(p, text, created, die) for p in e.parts])
    if isinstance(e, (Between, Throughout)):
        return F.coalesce(_in_time(e, created, die), F.lit(False))
    if e.nothing:
        return F.lit(False)
    if e.exact is not None:
        found = F.array_contains(tokens(text), e.exact)
    elif not e.suffix:
        found = text.rlike(rf"(?:^|[{SPACE_CLASS}]){_quoted(e.prefix)}")
    elif not e.prefix:
        found = text.rlike(rf"{_quoted(e.suffix)}(?:\z|[{SPACE_CLASS}])")
    else:
        found = F.exists(tokens(text), lambda t: t.startswith(e.prefix) & t.endswith(e.suffix))
    return F.coalesce(found, F.lit(False))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}" for c in s)


def term_condition(e: Terms, term: Column | None = None, rterm: Column | None = None) -> Column:
    """A leaf on stored postings; a suffix is a prefix of the reversed term, which Parquet can prune."""
    term, rterm = (F.col(n) if c is None else c for c, n in ((term, "term"), (rterm, "rterm")))
    if e.nothing:
        return F.lit(False)
    if e.exact is not None:
        return term == e.exact
    said = [term.startswith(e.prefix)] * bool(e.prefix) + [rterm.startswith(e.suffix[::-1])] * bool(e.suffix)
    return reduce(lambda a, b: a & b, said)


def matching_ids(e: Expr, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct doc_ids from postings (term, rterm, doc_id) and docs (doc_id, created, die)."""
    if isinstance(e, Terms):
        return postings.where(term_condition(e)).select("doc_id").distinct()
    if isinstance(e, (Between, Throughout)):
        return docs.where(_in_time(e, F.col("created"), F.col("die"))).select("doc_id").distinct()
    if isinstance(e, Not):
        return docs.select("doc_id").distinct().join(matching_ids(e.of, postings, docs), "doc_id", "left_anti")
    if isinstance(e, Or):
        leaves = [p for p in e.parts if isinstance(p, Terms)]
        rest = [matching_ids(p, postings, docs) for p in e.parts if not isinstance(p, Terms)]
        if leaves:  # one scan for all terms
            some = reduce(lambda a, b: a | b, [term_condition(p) for p in leaves])
            rest.append(postings.where(some).select("doc_id"))
        return reduce(DataFrame.union, rest).distinct()
    dates = [p for p in e.parts if isinstance(p, (Between, Throughout))]
    rest = [p for p in e.parts if not isinstance(p, (Between, Throughout, Not))]
    found = matching_ids(rest[0], postings, docs) if rest else docs.select("doc_id").distinct()
    if dates:  # one filter for all dates
        time = reduce(lambda a, b: a & b, [_in_time(d, F.col("created"), F.col("die")) for d in dates])
        found = found.join(docs.where(time).select("doc_id"), "doc_id", "left_semi")
    for p in rest[1:]:
        found = found.join(matching_ids(p, postings, docs), "doc_id", "left_semi")
    for p in e.parts:
        if isinstance(p, Not):
            found = found.join(matching_ids(p.of, postings, docs), "doc_id", "left_anti")
    return found
