"""Queries over texts that shuffle texts and counts, not postings: the same sets, and what travels."""

import random
from collections import Counter

import pytest
from oracle import data_dir
from pyspark.sql import functions as F

from docloom import catalogue
from docloom.catalogue import QUERIES
from docloom.functions.text import feature_key
from docloom.operators import postings as ops
from docloom.sources import segments
from docloom.sources.corpus import table


def dealt(df):
    """Rows that the shuffles of a query write."""
    df.collect()

    def of(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return of(node.executedPlan())
        if "QueryStage" in name:
            return of(node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(of(node.children().apply(i)) for i in range(node.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def docs_at_edges(spark):
    """Documents around edges of blocks and buckets, with gaps, without words and without a text."""
    r, edges = random.Random(5), (0, 256, 512, 65_536, 131_072, 131_328)
    ids = {-1, *(e + d for e in edges for d in range(-4, 5) if r.random() < 0.9), *range(65_536 - 300, 65_536 + 300)}
    held = {i: {t for t, p in (("all", 1), ("most", 0.9), ("half", 0.5), ("some", 0.1)) if r.random() < p} | {f"own{i}"} for i in ids}
    held[256], held[65_535] = set(), set()
    rows = [(i, " ".join([*sorted(t), *sorted(t)[:1]]) if t or i == 256 else None) for i, t in held.items()]
    r.shuffle(rows)
    sets = {}
    for i, terms in held.items():
        for t in terms:
            sets.setdefault(t, set()).add(i)
    return spark.createDataFrame(rows, "doc_id bigint, text string"), sets


def islands(s):
    return sorted((i, next(k for k in range(1, len(s) + 1) if i + k not in s)) for i in s if i - 1 not in s)


def test_runs_of_documents(spark):
    docs, sets = docs_at_edges(spark)
    found = {}
    for x in ops.document_runs(docs).collect():
        found.setdefault(x.term, []).append((x.start, x.length))
    assert {t: sorted(x) for t, x in found.items()} == {t: islands(s) for t, s in sets.items()}
    assert sorted(ops.document_runs(docs).collect()) == sorted(ops.runs(ops.postings(docs)).collect())


def test_containers_of_documents(spark):
    docs, sets = docs_at_edges(spark)
    found = {x.term: (x.n, x.n_runs) for x in ops.document_containers(docs).collect()}
    assert found == {t: (len(s), len(islands(s))) for t, s in sets.items()}
    assert sorted(ops.document_containers(docs).collect()) == sorted(ops.containers(ops.postings(docs)).collect())


def test_key_frequency(spark):
    """Terms of one document that share a key count once; salted ones are found too."""
    terms = spark.range(3000).selectExpr("concat('t', id) as term").withColumn("key", feature_key(F.col("term"))).collect()
    keys = {x.term: x.key for x in terms}
    docs = [(k, " ".join(t for i, t in enumerate(keys) if i % 3 == k % 3)) for k in range(5)] + [(7, None), (8, " ")]
    wanted = Counter(key for _, text in docs for key in {keys[t] for t in (text or "").split()})
    assert max(Counter(keys.values()).values()) > 1
    assert {x.key: x.n for x in ops.key_frequency(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == wanted


@pytest.mark.parametrize(("name", "share"), [("container_kind", 1.0), ("runs", 0.5), ("runs_expanded", 0.5), ("hashed_postings", 0.5)])
def test_postings_do_not_travel(spark, name, share):
    folder = data_dir("sf0.001")
    pairs = QUERIES["postings"](spark, folder).count()
    assert dealt(QUERIES[name](spark, folder)) < share * pairs


def test_a_segment_is_one_shuffle(spark, tmp_path):
    """Postings and stored lists travel once, and sorted rows aren't sorted again to be grouped."""
    pairs = ops.postings(table(spark, data_dir("sf0.001"), "documents"))
    with segments._by_order(spark):
        fresh = segments.lists(pairs)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortAggregate" in plan and "ObjectHashAggregate" not in plan
        assert dealt(fresh) == pairs.count()
        stored = fresh.unionByName(segments.lists(pairs.where("pmod(doc_id, 2) = 0")))
        stored.write.parquet(str(tmp_path / "l"))
        rows = spark.read.parquet(str(tmp_path / "l"))
        merged = segments.merge_lists(rows)
        assert dealt(merged) == rows.count()
    assert spark.conf.get("spark.sql.execution.replaceHashWithSortAgg", "false") == "false"
    wanted = {(x.term, x.bucket): sorted(x.doc_ids) for x in ops.postings_arrays(pairs).collect()}
    for found in (fresh, merged):
        assert {(x.term, x.bucket): x.doc_ids for x in found.collect()} == wanted
        assert all(x.n == len(x.doc_ids) and x.rterm == x.term[::-1] for x in found.collect())


def test_segments_of_a_store_are_written_side_by_side(spark, monkeypatch):
    """Five batches meet: none waits for another to be written."""
    from threading import Barrier

    met, append = Barrier(5, timeout=60), segments.SegmentStore.append

    def late(store, *args):
        met.wait()
        return append(store, *args)

    monkeypatch.setattr(segments.SegmentStore, "append", late)
    monkeypatch.setattr(catalogue, "_stores", {})
    store = catalogue._store(spark, data_dir("sf0.001"))
    assert len(store.segments()) == 5
    assert store.postings().count() == QUERIES["postings"](spark, data_dir("sf0.001")).count()
    assert spark.conf.get("spark.sql.execution.replaceHashWithSortAgg", "false") == "false"
