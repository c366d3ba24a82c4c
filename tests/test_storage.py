"""Postings in segments, the dictionary, sets of ids, and documents that stream in."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docloom.functions.text import feature_key, tokenize
from docloom.operators import bit_slices as bits
from docloom.operators import postings as ops
from docloom.plans import expressions as x
from docloom.sources.corpus import empty_documents, empty_postings, text_files
from docloom.sources.segments import SegmentStore, lists
from docloom.sources.shared import publish
from docloom.streaming.ingest import StreamingIndex


def pairs_of(spark, sets):
    return spark.createDataFrame([(t, t[::-1], i) for t, ids in sets.items() for i in ids], "term string, rterm string, doc_id bigint")


def as_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.term, set()).add(r.doc_id)
    return out


def test_segments(spark, tmp_path):
    store = SegmentStore(spark, (tmp_path / "s").as_uri(), fan_in=3)
    assert store.postings().count() == 0 and not store.compact(force=True)
    parts = [{"a": {1, 2}, "b": {1}}, {"a": {2, 70_000}, "c": {9}}, {"d": set(range(0, 9000, 2))}, {"a": {5}}]
    for k, p in enumerate(parts[:2]):
        assert store.append(pairs_of(spark, p), f"batch-{k}")
    assert not store.append(pairs_of(spark, parts[0]), "batch-0")
    assert not store.compact()
    store.append(pairs_of(spark, parts[2]), "batch-2")
    whole = {"a": {1, 2, 70_000}, "b": {1}, "c": {9}, "d": set(range(0, 9000, 2))}
    assert as_sets(store.postings()) == whole
    assert sorted(r.doc_id for r in store.lookup("a").collect()) == [1, 2, 70_000]
    assert store.compact() and len(store.segments()) == 1
    assert as_sets(store.postings()) == whole
    assert not store.append(pairs_of(spark, parts[0]), "batch-0")
    store.append(pairs_of(spark, parts[3]), "batch-3")
    assert store.compact(force=True) and not store.append(pairs_of(spark, parts[3]), "batch-3")
    assert as_sets(store.postings())["a"] == {1, 2, 5, 70_000}
    assert "EqualTo(term,a)" in store.lookup("a")._jdf.queryExecution().executedPlan().toString()
    store.clear()
    assert store.segments() == []


def test_levels(spark, tmp_path):
    """Fan-in segments of a level become one of the next; ids are rewritten once a level."""
    store = SegmentStore(spark, (tmp_path / "s").as_uri(), fan_in=2)
    for k in range(7):
        store.append(pairs_of(spark, {"a": {k}, f"t{k}": {k}}), f"batch-{k}")
        store.compact()
    assert {level: len(names) for level, names in store.levels().items()} == {0: 1, 1: 1, 2: 1}
    assert as_sets(store.postings())["a"] == set(range(7))
    assert not any(store.append(pairs_of(spark, {"a": {99}}), f"batch-{k}") for k in range(7))
    assert store.compact(force=True) and len(store.segments()) == 1 and as_sets(store.postings())["a"] == set(range(7))
    assert not store.append(pairs_of(spark, {"a": {99}}), "batch-3")


def test_scan_prunes_row_groups(spark, tmp_path):
    """A term lies in few row groups, as segments are sorted by it; the filter reaches the scan."""
    store = SegmentStore(spark, (tmp_path / "s").as_uri())
    pairs = spark.range(200_000).selectExpr("concat('term', lpad(id % 50000, 6, '0')) as term", "'x' as rterm", "id as doc_id")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    try:
        store.append(pairs, "one")
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    groups, held, blooms = 0, 0, 0
    for f in (tmp_path / "s").glob("segment=*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(0).statistics
            groups, held = groups + 1, held + (stats.min <= "term001234" <= stats.max)
    assert groups >= 8 and held <= 2
    found = store.lookup("term001234")
    assert "EqualTo(term,term001234)" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in found.collect()} == {1234, 51234, 101234, 151234}


def test_publishing_twice_at_once(spark, tmp_path):
    """A writer that meets a target which came up meanwhile leaves it as it is."""
    target, work = (tmp_path / "t").as_uri(), (tmp_path / "w").as_uri()

    def late(writer):
        publish(spark, spark.range(3), target, work)
        return writer

    assert not publish(spark, spark.range(9), target, work, late)
    assert spark.read.parquet(target).count() == 3
    assert not list((tmp_path / "t").glob("_*-*")) and not [p for p in (tmp_path / "t").iterdir() if p.is_dir()]


def test_dictionary(spark):
    r = random.Random(7)
    known = {"".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(8, 23))) for _ in range(10_000)}
    frame = spark.createDataFrame([(t,) for t in [*known, *list(known)[:50]]], "term string")
    terms = ops.dictionary(frame).cache()
    assert terms.count() == len(known)
    missing = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(100)]
    keys = spark.createDataFrame([(t,) for t in [*list(known)[:100], *missing]], "term string")
    assert {x.term for x in ops.dictionary_contains(terms, keys).collect()} == set(list(known)[:100])
    assert {(x.term, x.found) for x in ops.dictionary_insert(terms, keys).collect()} == {(t, t in known) for t in [*list(known)[:100], *missing]}
    for letter in "akz":
        assert [x.term for x in ops.dictionary_prefix(terms, letter).collect()] == sorted(t for t in known if t.startswith(letter))


def test_sets_of_ids(spark):
    r = random.Random(1)
    sets = {"one": {5}, "run": set(range(100, 5200)), "mixed": {0, 1, 2, 5}, "odd": set(range(1, 9000, 2)), "wide": set(r.sample(range(200_000), 6000)), "edge": {0, 32768, 32769, 65536}}
    pairs = pairs_of(spark, sets).cache()
    assert as_sets(ops.expand_runs(ops.runs(pairs))) == sets
    kinds = {x.term: (x.n, x.kind) for x in ops.containers(pairs).collect()}
    assert kinds == {"one": (1, "array"), "run": (5100, "run"), "mixed": (4, "array"), "odd": (4500, "bitmap"), "wide": (6000, "bitmap"), "edge": (4, "array")}
    arrays = {(x.term, x.bucket): x.doc_ids for x in ops.postings_arrays(pairs).collect()}
    assert arrays == {(t, b): sorted((i for i in s if i >> 16 == b), reverse=True) for t, s in sets.items() for b in {i >> 16 for i in s}}
    only = {t: pairs.where(f"term = '{t}'").select("doc_id") for t in sets}
    for a, b in (("run", "odd"), ("wide", "run"), ("edge", "mixed"), ("one", "edge")):
        assert sum(x.n for x in ops.bitmap_and([only[a], only[b]]).collect()) == len(sets[a] & sets[b])
        assert sum(x.n for x in ops.bitmap_or([only[a], only[b]]).collect()) == len(sets[a] | sets[b])
    as_one = [ops.runs(pairs.where(f"term = '{t}'").selectExpr("'x' as term", "doc_id")) for t in ("run", "odd")]
    assert as_sets(ops.expand_runs(ops.interval_intersect(*as_one)))["x"] == sets["run"] & sets["odd"]
    counted = lists(pairs).groupBy("term").agg({"n": "sum"}).collect()
    assert {r[0]: r[1] for r in counted} == {t: len(s) for t, s in sets.items()}


def test_runs_swept(spark):
    """AND, OR and NOT of runs that touch, overlap and cross buckets, against sets."""
    r = random.Random(4)
    near = [65_536 * k + d for k in (0, 1, 2, 3) for d in (-3, -2, -1, 0, 1, 2)]
    a = {*range(10, 20), *range(65_500, 200_000), *(x for x in near if x > 0 and r.random() < 0.5), 300_000}
    b = {*range(15, 40), *range(131_000, 131_080), *(x for x in near if x > 0 and r.random() < 0.5), 200_000, 300_001}
    universe = set(range(250_000)) | {300_000}
    frames = [ops.runs(spark.createDataFrame([("x", i) for i in s], "term string, doc_id bigint")) for s in (a, b, universe)]

    def islands(s):
        return sorted((i, next(k for k in range(1, len(s) + 1) if i + k not in s)) for i in s if i - 1 not in s)

    def of(df):
        return sorted((x.start, x.length) for x in df.collect())

    assert of(frames[0]) == islands(a) and of(frames[1]) == islands(b)
    assert of(ops.interval_intersect(frames[0], frames[1])) == islands(a & b)
    assert of(ops.interval_union(frames[0], frames[1])) == islands(a | b)
    assert of(ops.interval_not(frames[2], frames[0])) == islands(universe - a)
    points = spark.createDataFrame([("x", i) for i in (0, 12, 65_535, 65_536, 200_000, 300_000)], "term string, doc_id bigint")
    assert {x.doc_id for x in ops.points_in_runs(points, frames[0]).collect()} == a & {0, 12, 65_535, 65_536, 200_000, 300_000}
    empty = spark.createDataFrame([], "term string, start bigint, length bigint")
    assert of(ops.interval_union(frames[0], empty)) == islands(a) and of(ops.interval_intersect(frames[0], empty)) == []


def test_bitmaps_back_to_ids(spark):
    a, universe = {0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 65_537}, set(range(0, 40_000)) | {65_536, 65_537, 98_304}
    own, every = (ops.bitmaps(spark.createDataFrame([(i,) for i in s], "doc_id bigint")) for s in (a, universe))
    assert {x.doc_id for x in ops.bitmap_to_ids(own).collect()} == a
    assert {x.doc_id for x in ops.bitmap_to_ids(ops.bitmap_not(every, own)).collect()} == universe - a


def test_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None), (4, "")], "doc_id bigint, text string")
    assert {x.term: x.n for x in ops.doc_frequency(docs).collect()} == {"a": 1, "b": 2}
    assert ops.document_count(docs).first().n == 4


def test_feature_keys(spark):
    """Hashed again with the salt behind until the key is 128 or more, however often."""
    from hashlib import sha256

    def key(t):
        while (k := int.from_bytes(sha256(t.encode()).digest()[:2], "big")) < 128:
            t += "salt"
        return k

    terms = [f"t{i}" for i in range(300_000)]
    once = [t for t in terms if sha256(t.encode()).digest()[0] == 0 and sha256(t.encode()).digest()[1] < 128]
    twice = [t for t in once if int.from_bytes(sha256((t + "salt").encode()).digest()[:2], "big") < 128]
    some = once[:200] + twice + terms[:200] + ["é", ""]
    assert twice
    found = spark.createDataFrame([(t,) for t in some], "term string").select("term", feature_key(F.col("term")).alias("key")).collect()
    assert {r.term: r.key for r in found} == {t: key(t) for t in some}


def test_bit_slices(spark):
    from datetime import datetime

    times = {i: s for i, s in enumerate([0, 1, 2, 3, -1, -7, 1_257_894_000, 1_257_894_001, 2**33])}
    base = datetime(1970, 1, 1)
    from datetime import timedelta

    docs = spark.createDataFrame([(i, base + timedelta(seconds=s)) for i, s in times.items()], "doc_id bigint, created timestamp_ntz")
    slices = bits.bit_slices(docs).cache()
    for bound in (0, -1, -5, 1, 1_257_894_000, 2**33):
        assert {r.doc_id for r in bits.at_most(slices, docs, bound).collect()} == {i for i, s in times.items() if s <= bound}
    for bound in (0, 1, 2, -1, -3, 1_257_894_000, 1_257_894_001, 2**33 + 1):
        assert {r.doc_id for r in bits.at_least(slices, docs, bound).collect()} == {i for i, s in times.items() if s >= bound}


def test_valid_by_slices(spark):
    from datetime import datetime, timedelta

    base, r = datetime(1970, 1, 1), random.Random(2)
    rows = [(i, r.choice([None, *range(-4, 5)]), r.choice([None, *range(-4, 5)])) for i in range(200)]
    at = lambda s: None if s is None else base + timedelta(seconds=s)
    docs = spark.createDataFrame([(i, at(c), at(d)) for i, c, d in rows], "doc_id bigint, created timestamp_ntz, die timestamp_ntz").cache()
    slices = bits.bit_slices(docs), bits.bit_slices(docs, "die")
    for start, end in ((-2, 1), (0, 0), (1, 3), (-3, -1), (4, 4)):
        found = {x.doc_id for x in bits.valid_throughout(*slices, docs, start, end).collect()}
        assert found == {i for i, c, d in rows if c is not None and c <= start and (d is None or d >= end)}


def test_sources(spark, tmp_path):
    for name, text in (("b.txt", "two\nlines"), ("a.txt", "one"), ("c.txt", "")):
        (tmp_path / name).write_text(text)
    rows = sorted((r.doc_id, r.text) for r in text_files(spark, str(tmp_path), first_id=10).collect())
    assert rows[:2] == [(10, "one"), (11, "two\nlines")]
    assert empty_documents(spark).count() == empty_postings(spark).count() == 0
    doc = spark.createDataFrame([(1, "a b c\x85d\tb"), (2, None), (3, " ")], "doc_id bigint, text string")
    assert sorted(r.term for r in tokenize(doc).collect()) == ["a", "b", "b", "c", "d"]


def test_streaming(spark, tmp_path):
    source, folder = tmp_path / "in", (tmp_path / "index").as_uri()
    schema = "doc_id bigint, text string"
    index = StreamingIndex(spark, folder)
    batches = [[(1, "red rose"), (2, "blue")], [(3, "red sky"), (4, None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        index.start(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "cp")).awaitTermination()
    found = index.index()
    assert sorted(r.doc_id for r in found.ids(x.precise("red")).collect()) == [1, 3]
    assert sorted(r.doc_id for r in found.ids(~x.wildcard("r*")).collect()) == [2, 4]
    before = as_sets(index.store.postings())
    index.add(spark.createDataFrame(batches[0], schema), 0)
    assert as_sets(index.store.postings()) == before and index.index().docs.count() == 4
