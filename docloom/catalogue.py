"""Queries over the standard tables, each with its equivalent in DuckDB's SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import functions as F

from .functions.text import SPACES, feature_key, tokenize
from .operators import bit_slices as bits
from .operators import postings as ops
from .operators.index import DocIndex
from .plans import expressions as x
from .sources.corpus import order_lifetimes, table
from .sources.segments import SegmentStore
from .sources.shared import passing_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The common table expressions that the SQL builds on.
T = rf"""tok as (select doc_id, term from (select doc_id, unnest(regexp_split_to_array(text, '{SPACES}')) as term from documents) where term <> ''),
post as (select distinct term, doc_id from tok)"""
LIFE = """life as (select o_orderkey as doc_id, o_orderdate as created, case when o_orderstatus = 'F' then last end as die
from orders left join (select l_orderkey, max(l_shipdate) as last from lineitem group by 1) on o_orderkey = l_orderkey)"""
TIMED = f"{T}, timed as (select doc_id, timestamp '2024-01-01' + to_hours(doc_id) as created from documents)"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _search(spark, sf_dir, expr):
    return DocIndex.from_documents(_docs(spark, sf_dir)).ids(expr)


def _pairs(spark, sf_dir):
    return ops.postings(_docs(spark, sf_dir))


def _unix(t: datetime) -> int:
    return int((t - datetime(1970, 1, 1)).total_seconds())


def _ids(condition: str) -> str:
    return f"select distinct doc_id from post where {condition}"


@query(f"with {T} select doc_id, term from tok")
def tokenize_documents(spark, sf_dir):
    return tokenize(_docs(spark, sf_dir))


@query(f"with {T} select term, reverse(term) as rterm, doc_id from post")
def postings(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"with {T} select term, doc_id >> 16 as bucket, string_agg(doc_id::varchar, ',' order by doc_id desc) as doc_ids, count(*) as n from post group by all")
def postings_arrays(spark, sf_dir):
    found = ops.postings_arrays(_pairs(spark, sf_dir))
    return found.withColumn("doc_ids", F.array_join(F.col("doc_ids").cast("array<string>"), ","))


@query(f"with {T} select term, count(distinct doc_id) as n from tok group by term")
def doc_frequency(spark, sf_dir):
    return ops.doc_frequency(_docs(spark, sf_dir))


@query(f"with {T} select distinct term from tok")
def dictionary(spark, sf_dir):
    return ops.dictionary(tokenize(_docs(spark, sf_dir)))


@query(f"with {T} select distinct term from tok where starts_with(term, 'thea')")
def dictionary_prefix(spark, sf_dir):
    return ops.dictionary_prefix(ops.dictionary(tokenize(_docs(spark, sf_dir))), "thea")


@query(f"with {T} select distinct p_name as term from part where p_name in (select term from tok) union select distinct p_brand from part where p_brand in (select term from tok) union select w from (values ('the'), ('und'), ('que')) v(w) where w in (select term from tok)")
def dictionary_contains(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    some = spark.createDataFrame([("the",), ("und",), ("que",)], "term string")
    keys = part.select(F.col("p_name").alias("term")).unionByName(part.select(F.col("p_brand").alias("term"))).unionByName(some).distinct()
    return ops.dictionary_contains(ops.dictionary(tokenize(_docs(spark, sf_dir))), keys)


@query(rf"with {T}, new as (select distinct w as term from (select unnest(regexp_split_to_array(text, '{SPACES}')) as w from benchmark) where w <> '') select term, term in (select term from tok) as found from new")
def dictionary_insert(spark, sf_dir):
    keys = tokenize(table(spark, sf_dir, "benchmark"), "item_id")
    return ops.dictionary_insert(tokenize(_docs(spark, sf_dir)), keys)


@query(f"with {T} {_ids("term = 'the'")}")
def precise(spark, sf_dir):
    return _search(spark, sf_dir, x.precise("the"))


@query(f"with {T} {_ids("starts_with(term, 'th')")}")
def wildcard_prefix(spark, sf_dir):
    return _search(spark, sf_dir, x.wildcard("th*"))


@query(f"with {T} {_ids("ends_with(term, 'ing.')")}")
def wildcard_suffix(spark, sf_dir):
    return _search(spark, sf_dir, x.wildcard("*ing."))


@query(f"with {T} {_ids("starts_with(term, 'in') and ends_with(term, 'ing')")}")
def wildcard_infix(spark, sf_dir):
    return _search(spark, sf_dir, x.wildcard("in*ing"))


@query("select doc_id from documents where false")
def wildcard_bare(spark, sf_dir):
    return _search(spark, sf_dir, x.wildcard("*"))


@query(f"with {T} {_ids("term = 'with'")}")
def wildcard_none(spark, sf_dir):
    return _search(spark, sf_dir, x.wildcard("with"))


@query(f"with {T} {_ids("term = 'the'")} intersect {_ids("term = 'and'")}")
def and_terms(spark, sf_dir):
    return _search(spark, sf_dir, x.precise("the") & x.precise("and"))


@query(f"with {T} {_ids("term = 'und'")} union {_ids("term = 'que'")}")
def or_terms(spark, sf_dir):
    return _search(spark, sf_dir, x.precise("und") | x.precise("que"))


@query(f"with {T} select doc_id from documents except {_ids("term = 'the'")}")
def not_term(spark, sf_dir):
    return _search(spark, sf_dir, ~x.precise("the"))


@query(f"with {T} {_ids("term = 'the'")} except {_ids("term = 'with'")}")
def and_not(spark, sf_dir):
    return _search(spark, sf_dir, x.precise("the") & ~x.precise("with"))


@query(f"with {T} select doc_id from documents except ({_ids("term = 'the'")} intersect {_ids("term = 'with'")})")
def not_of_and(spark, sf_dir):
    return _search(spark, sf_dir, ~(x.precise("the") & x.precise("with")))


NESTED = (x.wildcard("th*") & ~x.precise("with")) | (x.precise("und") & ~(x.precise("der") & x.wildcard("*ung")))


@query(
    f"with {T} ({_ids("starts_with(term, 'th')")} except {_ids("term = 'with'")}) union "
    f"({_ids("term = 'und'")} except ({_ids("term = 'der'")} intersect {_ids("ends_with(term, 'ung')")}))"
)
def nested_boolean(spark, sf_dir):
    return _search(spark, sf_dir, NESTED)


_stores: dict = {}


def _store(spark, sf_dir, compacted: bool = False) -> SegmentStore:
    """The documents' postings stored as five segments, as if every fifth document came with each batch."""
    key = (spark.sparkContext.applicationId, sf_dir, compacted)
    if key not in _stores:
        store, pairs = SegmentStore(spark, passing_folder(spark, "segments")), _pairs(spark, sf_dir)
        with ThreadPoolExecutor(5) as pool:  # a batch's last tasks leave no core idle
            list(pool.map(lambda k: store.append(pairs.where(F.pmod("doc_id", F.lit(5)) == k), f"batch-{k}"), range(5)))
        if compacted:
            store.compact()
        _stores[key] = store
    return _stores[key]


@query(ORACLES["nested_boolean"])
def nested_boolean_postings(spark, sf_dir):
    """The same tree on stored postings: filters on sorted segments, then joins on ids."""
    return DocIndex.from_postings(_store(spark, sf_dir).postings(), _docs(spark, sf_dir).drop("text")).ids(NESTED)


@query(f"with {LIFE} select doc_id from life where floor(epoch(created)) between epoch(timestamp '1996-01-01') and epoch(timestamp '1996-12-31 23:59:59')")
def created_range(spark, sf_dir):
    expr = x.created_between(datetime(1996, 1, 1), datetime(1996, 12, 31, 23, 59, 59))
    return x.matching_ids(expr, None, order_lifetimes(spark, sf_dir))


@query("select event_id as doc_id from events where floor(epoch(ts)) between epoch(timestamp '2024-01-05 10:00:00') and epoch(timestamp '2024-01-06 09:59:59')")
def created_range_events(spark, sf_dir):
    """Sub-second times: the end's whole second is in."""
    expr = x.created_between(datetime(2024, 1, 5, 10), datetime(2024, 1, 6, 9, 59, 59))
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created"), F.lit(None).cast("timestamp_ntz").alias("die"))
    return x.matching_ids(expr, None, docs)


@query(f"with {LIFE} select doc_id from life where floor(epoch(created)) <= epoch(timestamp '1997-01-01') and (die is null or floor(epoch(die)) >= epoch(timestamp '1997-06-01'))")
def valid_throughout(spark, sf_dir):
    expr = x.valid_throughout(datetime(1997, 1, 1), datetime(1997, 6, 1))
    return x.matching_ids(expr, None, order_lifetimes(spark, sf_dir))


@query(
    f"with {LIFE} select doc_id from life where created >= timestamp '1996-01-01' and created < timestamp '1996-02-01' "
    "or created >= timestamp '1998-03-01' and created < timestamp '1998-04-01'"
)
def created_or_ranges(spark, sf_dir):
    january = x.created_between(datetime(1996, 1, 1), datetime(1996, 1, 31, 23, 59, 59))
    march = x.created_between(datetime(1998, 3, 1), datetime(1998, 3, 31, 23, 59, 59))
    return x.matching_ids(january | march, None, order_lifetimes(spark, sf_dir))


@query(f"with {TIMED} {_ids("term = 'the'")} intersect select doc_id from timed where created between timestamp '2024-01-03' and timestamp '2024-01-20 12:00:00'")
def term_and_date(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("created", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, doc_id)"))
    return DocIndex.from_documents(docs).ids(x.precise("the") & x.created_between(datetime(2024, 1, 3), datetime(2024, 1, 20, 12)))


@query("select event_id as doc_id, bit from (select event_id, cast(floor(epoch(ts)) as bigint) as u, unnest(range(0, 63)) as bit from events) where (u >> bit) & 1 = 1")
def bit_slices(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created"))
    return bits.bit_slices(docs)


@query("select event_id as doc_id from events where floor(epoch(ts)) >= epoch(timestamp '2024-01-15 08:30:00')")
def bitsliced_range(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created"))
    return bits.at_least(bits.bit_slices(docs), docs, _unix(datetime(2024, 1, 15, 8, 30)))


@query("select event_id as doc_id from events where floor(epoch(ts)) <= epoch(timestamp '2024-01-15 08:30:00')")
def bitsliced_at_most(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created"))
    return bits.at_most(bits.bit_slices(docs), docs, _unix(datetime(2024, 1, 15, 8, 30)))


@query(f"with {LIFE} select doc_id from life where floor(epoch(die)) >= epoch(timestamp '1997-06-01')")
def bitsliced_die(spark, sf_dir):
    docs = order_lifetimes(spark, sf_dir).where("die is not null")
    return bits.at_least(bits.bit_slices(docs, "die"), docs, _unix(datetime(1997, 6, 1)))


@query(ORACLES["valid_throughout"])
def bitsliced_valid_throughout(spark, sf_dir):
    docs = order_lifetimes(spark, sf_dir)
    slices = bits.bit_slices(docs), bits.bit_slices(docs, "die")
    return bits.valid_throughout(*slices, docs, _unix(datetime(1997, 1, 1)), _unix(datetime(1997, 6, 1)))


@query("select count(distinct doc_id) as n from documents")
def document_count(spark, sf_dir):
    return ops.document_count(_docs(spark, sf_dir))


ISLANDS = "islands as (select term, doc_id - row_number() over (partition by term order by doc_id) as i, doc_id from post)"
RUNS = "runs as (select term, min(doc_id) as start, count(*) as length from islands group by term, i)"


@query(f"with {T}, {ISLANDS}, {RUNS} select term, start, length from runs")
def runs(spark, sf_dir):
    return ops.document_runs(_docs(spark, sf_dir))


@query(f"with {T} select term, doc_id from post")
def runs_expanded(spark, sf_dir):
    return ops.expand_runs(ops.document_runs(_docs(spark, sf_dir)))


@query(
    f"with {T}, {ISLANDS}, {RUNS}, c as (select term, sum(length)::bigint as n, count(*) as n_runs from runs group by term) select *, "
    "case when n <= 4096 then case when n_runs < (n + 1) // 2 then 'run' else 'array' end when n_runs < 2047 then 'run' else 'bitmap' end as kind from c"
)
def container_kind(spark, sf_dir):
    return ops.document_containers(_docs(spark, sf_dir))


def _bucketed(ids: str) -> str:
    return f"select case when doc_id > 0 then 1 + (doc_id - 1) // 32768 else doc_id // 32768 end as bucket, count(*) as n from ({ids}) group by 1"


@query(f"with {T} {_bucketed(f"{_ids("term = 'the'")} intersect {_ids("term = 'and'")}")}")
def bitmap_and(spark, sf_dir):
    return ops.bitmap_and([_search(spark, sf_dir, x.precise(t)) for t in ("the", "and")])


@query(f"with {T} {_bucketed(f"{_ids("term = 'the'")} union {_ids("term = 'und'")}")}")
def bitmap_or(spark, sf_dir):
    return ops.bitmap_or([_search(spark, sf_dir, x.precise(t)) for t in ("the", "und")])


@query(
    f"with {T}, both_ids as ({_ids("term = 'the'")} intersect {_ids("term = 'and'")}), "
    "i as (select doc_id, doc_id - row_number() over (order by doc_id) as i from both_ids) "
    "select 'both' as term, min(doc_id) as start, count(*) as length from i group by i"
)
def interval_intersect(spark, sf_dir):
    """Runs of "the" and of "and", intersected as runs."""
    pairs = _pairs(spark, sf_dir)
    a, b = (ops.runs(pairs.where(F.col("term") == t).withColumn("term", F.lit("both"))) for t in ("the", "and"))
    return ops.interval_intersect(a, b)


def _runs_of(ids: str) -> str:
    return (
        f"ids as ({ids}), i as (select doc_id, doc_id - row_number() over (order by doc_id) as i from ids) "
        "select 'both' as term, min(doc_id) as start, count(*) as length from i group by i"
    )


def _named(spark, sf_dir, term: str):
    """(term, doc_id) of a term, under one name, so that sets of two terms meet."""
    return _pairs(spark, sf_dir).where(F.col("term") == term).select(F.lit("both").alias("term"), "doc_id")


def _set(term: str) -> str:
    return _ids(f"term = '{term}'")


@query(f"with {T}, {_runs_of(f"{_set('the')} union {_set('and')}")}")
def interval_union(spark, sf_dir):
    """Runs of "the" and of "and", united as runs."""
    return ops.interval_union(*(ops.runs(_named(spark, sf_dir, t)) for t in ("the", "and")))


@query(f"with {T}, {_runs_of(f"select doc_id from documents except {_set('the')}")}")
def interval_not(spark, sf_dir):
    """Runs of the documents without "the", from runs of all documents."""
    every = _docs(spark, sf_dir).select(F.lit("both").alias("term"), "doc_id").distinct()
    return ops.interval_not(ops.runs(every), ops.runs(_named(spark, sf_dir, "the")))


@query(f"with {T} select 'both' as term, doc_id from ({_set('the')} intersect {_set('with')})")
def points_in_runs(spark, sf_dir):
    """Ids of "with", as an array, that runs of "the" cover."""
    return ops.points_in_runs(_named(spark, sf_dir, "with"), ops.runs(_named(spark, sf_dir, "the")))


@query(f"with {T}, {_runs_of(f"{_set('the')} union {_set('with')}")}")
def array_run_union(spark, sf_dir):
    """Ids of "with", as an array, united with runs of "the"."""
    return ops.interval_union(ops.as_points(_named(spark, sf_dir, "with")), ops.runs(_named(spark, sf_dir, "the")))


def _bits(spark, sf_dir, term: str):
    return ops.bitmaps(_named(spark, sf_dir, term))


@query(f"with {T} select 'both' as term, doc_id from ({_set('the')} intersect {_set('and')})")
def bitmap_run_and(spark, sf_dir):
    """A bitmap of "the" with runs of "and"."""
    ids = ops.bitmap_to_ids(_bits(spark, sf_dir, "the")).select(F.lit("both").alias("term"), "doc_id")
    return ops.points_in_runs(ids, ops.runs(_named(spark, sf_dir, "and")))


@query(f"with {T}, {_runs_of(f"{_set('und')} union {_set('and')}")}")
def bitmap_run_or(spark, sf_dir):
    """A bitmap of "und" united with runs of "and"."""
    ids = ops.bitmap_to_ids(_bits(spark, sf_dir, "und")).select(F.lit("both").alias("term"), "doc_id")
    return ops.interval_union(ops.runs(ids), ops.runs(_named(spark, sf_dir, "and")))


@query(f"with {T} {_set('the')} intersect {_set('with')}")
def array_bitmap_and(spark, sf_dir):
    """Ids of "with", as an array, looked up in a bitmap of "the"."""
    return _named(spark, sf_dir, "with").select("doc_id").join(ops.bitmap_to_ids(_bits(spark, sf_dir, "the")), "doc_id", "left_semi")


@query(f"with {T} {_bucketed(f"{_set('with')} union {_set('the')}")}")
def array_bitmap_or(spark, sf_dir):
    """Ids of "with", as an array, put into a bitmap of "the"."""
    rows = _bits(spark, sf_dir, "the").unionByName(ops.bitmaps(_named(spark, sf_dir, "with")))
    return rows.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))


@query(f"with {T} select doc_id from documents except {_set('the')}")
def bitmap_not(spark, sf_dir):
    """The complement of a bitmap of "the" among all documents, as ids."""
    return ops.bitmap_to_ids(ops.bitmap_not(ops.bitmaps(_docs(spark, sf_dir)), _bits(spark, sf_dir, "the")))


@query(f"with {T} {_set('the')}")
def bitmap_to_array(spark, sf_dir):
    return ops.bitmap_to_ids(_bits(spark, sf_dir, "the"))


@query(f"with {T}, {_runs_of(_set('the'))}")
def bitmap_to_runs(spark, sf_dir):
    return ops.runs(ops.bitmap_to_ids(_bits(spark, sf_dir, "the")).select(F.lit("both").alias("term"), "doc_id"))


#: Big-endian first 16 bits of SHA-256; below 128 the term gets "salt" behind it and is hashed again.
KEYED = f"""with recursive {T}, h as (select term, term as salted, ('0x' || substr(sha256(term), 1, 4))::integer as key from (select distinct term from tok)
union all select term, salted || 'salt', ('0x' || substr(sha256(salted || 'salt'), 1, 4))::integer from h where key < 128),
keyed as (select term, key from h where key >= 128)"""


@query(f"{KEYED} select term, key from keyed")
def feature_keys(spark, sf_dir):
    return ops.dictionary(tokenize(_docs(spark, sf_dir))).select("term", feature_key(F.col("term")).alias("key"))


@query(f"{KEYED} select key, count(distinct doc_id) as n from post join keyed using (term) group by 1")
def hashed_postings(spark, sf_dir):
    """Postings by 16-bit key: what terms that share a key would find together."""
    return ops.key_frequency(_docs(spark, sf_dir))


@query(f"with {T} select term, doc_id >> 16 as bucket, string_agg(doc_id::varchar, ',' order by doc_id) as doc_ids, count(*) as n from post group by all")
def compacted_segments(spark, sf_dir):
    """Five stored segments merged into one of the next level."""
    found = _store(spark, sf_dir, compacted=True).rows()
    return found.select("term", "bucket", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"), "n")


@query(f"with {T} {_ids("term = 'ering'")}")
def segment_lookup(spark, sf_dir):
    """A term over five stored segments that aren't merged yet."""
    return _store(spark, sf_dir).lookup("ering")


@query(f"with {T} {_ids("starts_with(term, 'er') and ends_with(term, 'ing')")}")
def segment_wildcard(spark, sf_dir):
    """A prefix and a suffix on stored segments."""
    return DocIndex.from_postings(_store(spark, sf_dir).postings(), _docs(spark, sf_dir).drop("text")).ids(x.wildcard("er*ing"))
