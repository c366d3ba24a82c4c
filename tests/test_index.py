"""Boolean queries in both forms, against sets in Python, and the corners of their meaning."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docloom.errors import InvalidRangeError, UnsupportedWildcardError
from docloom.operators.index import DocIndex
from docloom.operators.postings import postings
from docloom.plans import expressions as x

SCHEMA = "doc_id bigint, text string, created timestamp_ntz, die timestamp_ntz"
T0 = datetime(2009, 11, 10, 23)
DOCS = [
    (0, "wild creatures dig for a diamond, a rose and some space space, diamond", T0, None),
    (1, "diamond did rose", datetime(2014, 4, 8, 4, 20), datetime(2015, 4, 8, 4, 20)),
    (2, "disease and disturbia Rose", datetime(2020, 12, 14, 23, 30, 15), None),
    (3, "", datetime(1969, 12, 31, 23, 59, 58), datetime(1969, 1, 1)),
    (4, None, datetime(1970, 1, 1), None),
    (5, "nbsp\xa0split　wide\x0btab 100% a_b c\\d x.y 😀smile", datetime(2024, 1, 1, 0, 0, 1, 900_000), None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


@pytest.fixture(scope="module")
def both(docs):
    return DocIndex.from_documents(docs), DocIndex.from_postings(postings(docs).cache(), docs)


def ids(found):
    return [r.doc_id for r in found.ids_desc().collect()]


def same(both, build, expected):
    for index in both:
        assert ids(build(index)) == expected


def test_reference_cases(both):
    same(both, lambda i: i.precise("diamond"), [1, 0])
    same(both, lambda i: i.precise("rose") | i.precise("space"), [1, 0])
    same(both, lambda i: i.precise("diamond") & i.precise("space"), [0])
    same(both, lambda i: ~(i.precise("diamond") & i.precise("space")), [5, 4, 3, 2, 1])
    same(both, lambda i: i.wildcard("di*"), [2, 1, 0])
    same(both, lambda i: i.wildcard("dia*"), [1, 0])
    same(both, lambda i: i.wildcard("di*d"), [1, 0])
    same(both, lambda i: i.wildcard("di*a"), [2])
    same(both, lambda i: i.wildcard("cre*es"), [0])
    first = lambda i: i.created_between(datetime(2000, 1, 1), datetime(2020, 1, 1))
    same(both, first, [1, 0])
    same(both, lambda i: first(i) | i.created_between(datetime(2020, 12, 1), datetime(2020, 12, 31, 23, 59, 59)), [2, 1, 0])
    same(both, lambda i: i.valid_throughout(datetime(2010, 12, 1), datetime(2024, 12, 1, 23, 59, 59)), [4, 0])


def test_wildcard_corners(both):
    same(both, lambda i: i.wildcard("*"), [])
    same(both, lambda i: i.wildcard(""), [])
    same(both, lambda i: i.wildcard("did*id"), [1])
    same(both, lambda i: i.wildcard("di*id"), [1])
    same(both, lambda i: i.wildcard("*,"), [0])
    same(both, lambda i: i.precise("Rose"), [2])
    same(both, lambda i: i.wildcard("R*"), [2])
    for q in ("100%", "a_b", "c\\d", "x.y", "split", "wide", "tab", "😀smile", "100*", "*%", "a_*", "c\\*", "*.y", "*😀smile", "😀*", "sp*t"):
        same(both, lambda i, q=q: i.wildcard(q), [5])
    for q in ("a.b", "x_y", "nbsp split", "nbsp *", "*\xa0split", "spl%*", "c\\\\d"):
        same(both, lambda i, q=q: i.wildcard(q), [])
    for q in ("a**b", "a*b*c", "**"):
        with pytest.raises(UnsupportedWildcardError):
            both[0].wildcard(q)


def test_date_corners(both):
    second = timedelta(seconds=1)
    at = datetime(2014, 4, 8, 4, 20)
    same(both, lambda i: i.created_between(at, at), [1])
    same(both, lambda i: i.created_between(at + second, at + 2 * second), [])
    same(both, lambda i: i.created_between(at - 2 * second, at - second), [])
    same(both, lambda i: i.created_between(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1)), [5])
    same(both, lambda i: i.created_between(datetime(2024, 1, 1, 0, 0, 1, 950_000), datetime(2024, 1, 1, 0, 0, 1, 960_000)), [5])
    same(both, lambda i: i.created_between(datetime(1960, 1, 1), datetime(1970, 1, 1)), [4, 3])
    same(both, lambda i: i.created_between(datetime(1970, 1, 1), datetime(1970, 1, 1)), [4])
    same(both, lambda i: i.valid_throughout(at, datetime(2015, 4, 8, 4, 20)), [4, 1, 0])
    same(both, lambda i: i.valid_throughout(at, datetime(2015, 4, 8, 4, 20, 1)), [4, 0])
    for bad in ("created_between", "valid_throughout"):
        with pytest.raises(InvalidRangeError):
            getattr(both[0], bad)(at + second, at)


def test_empty_complement(both):
    everything = lambda i: i.created_between(datetime(1900, 1, 1), datetime(2100, 1, 1))
    same(both, everything, [5, 4, 3, 2, 1, 0])
    same(both, lambda i: ~everything(i), [])
    same(both, lambda i: ~~i.precise("rose"), [1, 0])


LEAVES = st.sampled_from([x.precise("diamond"), x.precise("rose"), x.precise("and"), x.wildcard("di*"), x.wildcard("*e"), x.wildcard("d*d"), x.wildcard("*"), x.created_between(T0, datetime(2016, 1, 1)), x.valid_throughout(datetime(2014, 5, 1), datetime(2015, 1, 1))])
TREES = st.recursive(LEAVES, lambda t: st.one_of(st.builds(lambda a, b: a & b, t, t), st.builds(lambda a, b: a | b, t, t), st.builds(lambda a: ~a, t)), max_leaves=5)


def brute(e):
    every = {d[0] for d in DOCS}
    if isinstance(e, x.Not):
        return every - brute(e.of)
    if isinstance(e, x.And):
        return set.intersection(*map(brute, e.parts))
    if isinstance(e, x.Or):
        return set.union(*map(brute, e.parts))
    if isinstance(e, x.Between):
        return {i for i, _, c, _ in DOCS if e.start <= c <= e.end}
    if isinstance(e, x.Throughout):
        return {i for i, _, c, d in DOCS if c <= e.start and (d is None or d >= e.end)}
    if e.nothing:
        return set()
    ok = (lambda w: w == e.exact) if e.exact is not None else lambda w: w.startswith(e.prefix) and w.endswith(e.suffix)
    return {i for i, t, _, _ in DOCS if any(map(ok, (t or "").split()))}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(TREES)
def test_any_tree(both, e):
    for index in both:
        assert {r.doc_id for r in index.ids(e).collect()} == brute(e)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, docs, tmp_path):
    path = str(tmp_path / "p")
    postings(docs).write.parquet(path)
    docs.write.parquet(path + "d")
    pairs, stored = spark.read.parquet(path), spark.read.parquet(path + "d")
    assert "StringStartsWith(term,dia)" in plan(x.matching_ids(x.wildcard("dia*"), pairs, stored))
    assert "StringStartsWith(rterm,dno)" in plan(x.matching_ids(x.wildcard("*ond"), pairs, stored))
    created = plan(x.matching_ids(x.created_between(T0, T0), None, stored))
    assert "GreaterThanOrEqual(created" in created and "LessThan(created" in created
    # Any tree over texts is one scan and no shuffle.
    tree = ~(x.precise("a") & x.wildcard("b*")) | x.created_between(T0, T0)
    one = plan(DocIndex.from_documents(stored).ids(tree))
    assert one.count("FileScan") == 1 and "Exchange" not in one
