"""Mixing sources to target weights by Sainte-Laguë apportionment of token blocks.

Each source's words, its documents laid end to end in seeded order, are cut into
blocks of `block` words.  The mix has as many blocks as the corpus, dealt to `shards`
shards.  Blocks go to the sources by the highest quotients target / (2 j + 1), which
gives whole quotas that only grow with the number dealt, so a shard's quotas are the
differences between successive apportionments.  A source's blocks stand in an order
that a seeded permutation gives, over and over if its quota exceeds them; the shards
take their quotas from that order one after the other.

A source of less than a block is dealt by words: its quota is its target.

Targets: sources in code-point order (null last) weigh `weights` in turn and share
the size of the corpus; a target stops at `cap` times its source's size and what it
can't take is shared among the others by weight.

A source with a third of all rows is laid out in parallel: its documents fall into
4096 buckets by key, only bucket totals are summed along the source.  What goes
through one task is a row per source (for each shard) or per bucket of one source, no
document.  Millions of sources, such as hosts, should be grouped before.

Defined cases.  Null or word-less text: size 0, taken 0.  Null source: a source of
its own.  Very long text: its blocks are summed in its row.  Ties of quotients go to
the first source.  Null or repeated ids and repeated rows: each row is a document of
its own (equal rows are interchangeable).  Sources of billions of blocks: the products
of the permutation stay below 2**63.  Empty table: no rows.  Extra and clashing columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, space_words

#: Primes just below 2**31, multipliers of the block permutation.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563)
#: The same for sources of 2**31 blocks and more: primes just below 2**20.
SMALL_PRIMES = (1048573, 1048571)
SRC = ["_no", "_src"]


def document_sizes(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size in words, and the seeded key that orders a source's documents."""
    words = F.size(space_words(F.col("text"))).cast("long")
    key = F.md5(
        F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    )
    return docs.select(
        "doc_id", "source", words.alias("size"), key.alias("_key"),
        F.col("source").isNull().alias("_no"), F.coalesce("source", F.lit("")).alias("_src"),
    ).withColumn("_bucket", F.substring("_key", 1, 3))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """SRC, source_size, target: a row per source."""
    every = Window.partitionBy()
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), F.col("_rank") % len(weights) + 1)
    s = sizes.groupBy(*SRC).agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_rank", F.row_number().over(Window.orderBy("_no", "_src")) - 1).withColumn("w", w.cast("long"))
    s = s.withColumn("_t", F.sum("source_size").over(every)).withColumn("_cap", cap * F.col("source_size"))
    # Sources meet their caps in the order of cap / weight.
    upto = Window.orderBy(F.col("_cap") / F.col("w"), "_no", "_src").rowsBetween(Window.unboundedPreceding, -1)
    cap0, w0 = (F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in ("_cap", "w"))
    s = s.withColumn("_c0", cap0).withColumn("_w0", w0).withColumn("_w", F.sum("w").over(every))
    s = s.withColumn("_full", F.col("_cap") * (F.col("_w") - F.col("_w0")) <= (F.col("_t") - F.col("_c0")) * F.col("w"))
    full = [F.coalesce(F.sum(F.when(F.col("_full"), F.col(c))).over(every), F.lit(0)) for c in ("_cap", "w")]
    s = s.withColumn("_fc", full[0]).withColumn("_fw", full[1])
    level = F.try_divide(F.col("_t") - F.col("_fc"), F.col("_w") - F.col("_fw"))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level * F.col("w"))
    return s.select(*SRC, "source_size", target.alias("target"), F.col("_t").alias("total"))


def quotas(targets: DataFrame, block: int = 64, cap: int = 3, shards: int = 1) -> DataFrame:
    """SRC, source_size, target, _shard (from 1), quota: blocks by the highest quotients
    target / (2 j + 1) when the first _shard of `shards` equal parts of all blocks are dealt.

    Rounding target / divisor gives every quota but for at most half a block a source;
    those few quotients around the boundary are ranked, not all of them.
    """
    every = Window.partitionBy("_shard")
    t = targets.select("*", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("_shard"))
    k = F.when(F.col("total") > 0, F.greatest(F.floor(F.col("total") / block), F.lit(1))).otherwise(0)
    t = t.withColumn("_k", F.floor(k * F.col("_shard") / shards)).withColumn("_d", F.try_divide(F.sum("target").over(every), F.col("_k")))
    q0 = F.when(F.col("_k") > 0, F.coalesce(F.floor(F.try_divide("target", "_d") + 0.5), F.lit(0))).otherwise(0).cast("long")
    t = t.withColumn("_q", q0).withColumn("_gap", F.col("_k") - F.sum("_q").over(every))
    # No source gains or loses more than its share of 1.5 blocks a source, and one.
    reach = F.ceil(F.try_divide(1.5 * F.count(F.lit(1)).over(every) * F.col("target"), F.sum("target").over(every))).cast("long") + 2
    t = t.withColumn("_reach", F.when(F.col("_gap") == 0, 0).otherwise(F.coalesce(reach, F.lit(0))))
    grown = t.where("_gap > 0 and target > 0").select("*", F.explode(F.sequence(F.col("_q"), F.col("_q") + F.col("_reach"))).alias("_j"))
    shrunk = t.where("_gap < 0 and _q > 0").select(
        "*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_q") - F.col("_reach")), F.col("_q") - 1)).alias("_j")
    )
    quotient = F.col("target") / (2 * F.col("_j") + 1)
    up = grown.withColumn("_r", F.row_number().over(every.orderBy(quotient.desc(), "_no", "_src"))).where("_r <= _gap")
    down = shrunk.withColumn("_r", F.row_number().over(every.orderBy(quotient.asc(), F.desc("_no"), F.desc("_src")))).where("_r <= -_gap")
    moved = up.select(*SRC, "_shard", F.lit(1).alias("_m")).unionByName(down.select(*SRC, "_shard", F.lit(-1).alias("_m")))
    moved = moved.groupBy(*SRC, "_shard").agg(F.sum("_m").alias("_m"))
    t = t.join(moved, [*SRC, "_shard"], "left").withColumn("quota", F.col("_q") + F.coalesce("_m", F.lit(0)))
    most = cap * F.ceil(F.col("source_size") / block)
    return t.select(*SRC, "source_size", "target", "_shard", F.least("quota", most).cast("long").alias("quota"))


def plan(targets: DataFrame, block: int = 64, cap: int = 3, shards: int = 8) -> DataFrame:
    """SRC, source_size, target, _size (of a block), upto: per source, the quotas of the first 1, 2 ... shards."""
    q = quotas(targets, block, cap, shards).groupBy(*SRC, "source_size", "target")
    q = q.agg(F.transform(F.array_sort(F.collect_list(F.struct("_shard", "quota"))), lambda x: x["quota"]).alias("upto"))
    # A source of less than a block, by words.
    few = F.least(F.floor(F.col("target") + 0.5), cap * F.col("source_size")).cast("long")
    words = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.floor(few * i / shards).cast("long"))
    small = F.col("source_size") < block
    return q.withColumn("_size", F.when(small, 1).otherwise(block).cast("long")).withColumn("upto", F.when(small, words).otherwise(F.col("upto")))


def shard_quotas(docs: DataFrame, shards: int = 8, block: int = 64, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """shard, source, block_size, blocks: what each shard takes of each source."""
    p = plan(source_targets(document_sizes(docs), weights, cap), block, cap, shards)
    p = p.select("*", F.posexplode("upto").alias("shard", "_q"))
    before = F.when(F.col("shard") > 0, F.get(F.col("upto"), F.col("shard") - 1)).otherwise(0)
    return p.select(
        "shard", F.when(~F.col("_no"), F.col("_src")).alias("source"), F.col("_size").alias("block_size"),
        (F.col("_q") - before).alias("blocks"),
    )


def places(block_no: Column, n_blocks: Column, seed: int) -> Column:
    """Place of a block in its source's seeded order: a permutation of 0 to n_blocks - 1 whose product stays below 2**63."""
    large = F.when(n_blocks % SMALL_PRIMES[0] != 0, SMALL_PRIMES[0]).otherwise(SMALL_PRIMES[1])
    a = F.when(n_blocks < 2**31, F.lit(PRIMES[seed % len(PRIMES)])).otherwise(large).cast("long")
    return F.pmod(F.pmod(a, n_blocks) * block_no + F.lit(seed * 7919).cast("long"), n_blocks)


def mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3, block: int = 64, seed: int = 17, shards: int = 8) -> DataFrame:
    """Per row of `docs`: doc_id, source, size, source_size, target, taken (words, repeats
    counted) and per_shard, the words that each shard takes."""
    sizes = settle(document_sizes(docs, seed))
    deal = plan(source_targets(sizes, weights, cap), block, cap, shards)
    along = Window.partitionBy(*SRC).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spots = sizes.groupBy(*SRC, "_bucket").agg(F.sum("size").alias("_n"))
    spots = spots.withColumn("_at", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    # Sources that hold a third of all rows meet their figures as 4096 buckets.
    spots = spots.join(deal, SRC)
    within = Window.partitionBy(*SRC, "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    d = sizes.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(spots, [*SRC, "_bucket"]).withColumn("_c", F.col("_at") + F.col("_in"))
    b = F.greatest(F.ceil(F.col("source_size") / F.col("_size")), F.lit(1)).cast("long")
    first, last = (F.floor(x / F.col("_size")).cast("long") for x in (F.col("_c"), F.col("_c") + F.col("size") - 1))

    def block_of(j: Column) -> Column:
        """Place in the seeded order, and the words of the document in the block."""
        words = F.least(F.col("_c") + F.col("size"), (j + 1) * F.col("_size")) - F.greatest(F.col("_c"), j * F.col("_size"))
        return F.struct(places(j, F.col("_b"), seed).alias("place"), words.alias("words"))

    d = d.withColumn("_b", b).withColumn("_blocks", F.when(F.col("size") > 0, F.transform(F.sequence(first, last), block_of)))

    def upto(q: Column) -> Column:
        """Words taken by the first q blocks of the order, which starts again after _b blocks."""
        rounds, rest = F.floor(q / F.col("_b")).cast("long"), F.pmod(q, F.col("_b"))
        return F.coalesce(
            F.aggregate("_blocks", F.lit(0).cast("long"), lambda acc, x: acc + x["words"] * (rounds + (x["place"] < rest).cast("long"))),
            F.lit(0).cast("long"),
        )

    d = d.withColumn("_upto", F.transform("upto", upto))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("_upto", 1, shards - 1))
    return d.select(
        "doc_id", "source", "size", "source_size", "target", F.element_at("_upto", shards).alias("taken"),
        F.zip_with("_upto", before, lambda x, y: x - y).alias("per_shard"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(docs).drop("per_shard")
