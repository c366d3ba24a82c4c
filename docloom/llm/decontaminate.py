"""Benchmark decontamination with a broadcast set of normalised n-grams.

The benchmark's windows (10 words; a shorter item is one window) form a hash set
that is broadcast, along with each window's longest word.  Documents are scanned as
a stream of words: where one is some window's longest word, the window around it is
hashed, probed and, on a match, verified word by word.  No document window is ever
shuffled; only hits travel, to be grouped by document.

The set is broadcast while its words take at most `max_bytes`.  A larger set is
cut by hash into slices of that size and the documents are scanned once per slice.

Defined cases.  Null, empty or word-less text: no words, never contaminated.  An
item without words has no windows.  A null item id marks words as hit but is not
counted or listed.  Equal ids or texts among items count once per id.  Rows equal
in doc_id and text are scanned once and reported as often as they occur.  Very long
text: its words are streamed, its hits gathered in its row.  Ties: of a window's longest
words the first starts the probe.  Empty tables: no rows, or nothing contaminated.  Extra
and clashing columns are ignored by `find_hits` and kept by `remove_contaminated`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, flagged, flags, packed, settle, text_key, unpacked

KEY = ["doc_id", "_k1", "_k2"]


def benchmark_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(win, len, h, h2, anchor, offset, item): one row per item and distinct window.

    anchor is the window's longest word, first of those, and offset its place from 0.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"),
        F.transform(alnum_words(F.col("text")), ascii_lower).alias("words"),
    ).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(size)))
    wins = items.select(
        "item",
        "len",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("words") - F.col("len") + 1),
                lambda i: F.slice(F.col("words"), i, F.col("len")),
            )
        ).alias("_w"),
    )
    ranked = F.transform("_w", lambda w, i: F.struct((-F.char_length(w)).alias("n"), i.alias("i"), w.alias("w")))
    wins = wins.withColumn("_a", F.array_min(ranked)).withColumn("win", F.array_join("_w", " "))
    return wins.select(
        "win", "len", "item", F.xxhash64("win").alias("h"), F.xxhash64(F.lit(1), "win").alias("h2"),
        F.col("_a.w").alias("anchor"), F.col("_a.i").alias("offset"),
    ).distinct()


def _scan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per document (idx 0) and one per verified hit: KEY, n_words, idx, pos, len, wh, wh2.

    A word that is some window's longest starts a probe: the window around it is
    hashed and looked up in the n-gram set.  Any other window can't be in the set.
    """
    words = F.col("words")
    rows = docs.select("doc_id", *text_key(F.col("text")), alnum_words(F.col("text")).alias("words"))
    rows = rows.select(
        *KEY, "words", F.size(words).alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), words)).alias("idx", "word"),
    )
    rows = rows.withColumn("wa", F.xxhash64(ascii_lower(F.col("word"))))
    anchors = windows.select(F.xxhash64("anchor").alias("a"), "offset", "len").distinct()
    # Of a window's start, the word before it has the number pos in `idx`.
    pos = F.col("idx") - 1 - F.col("offset")
    rows = rows.join(
        F.broadcast(anchors),
        (F.col("wa") == F.col("a"))
        & F.col("word").isNotNull()
        & (pos >= 0)
        & (pos + F.col("len") <= F.col("n_words")),
        "left",
    ).where((F.col("idx") == 0) | F.col("a").isNotNull())
    # A string from here on: carrying the words along would copy the document for each probe.
    there = F.when(F.col("a").isNotNull(), ascii_lower(F.array_join(F.slice(words, pos + 1, F.col("len")), " ")))
    rows = rows.select(*KEY, "n_words", "idx", pos.alias("pos"), "len", there.alias("there"))
    rows = rows.withColumn("hash", F.xxhash64("there"))
    grams = windows.select(F.col("win").alias("b_win"), F.col("h").alias("wh"), F.col("h2").alias("wh2"))
    return (
        rows.join(F.broadcast(grams), (F.col("hash") == F.col("wh")) & (F.col("there") == F.col("b_win")), "left")
        .where((F.col("idx") == 0) | F.col("wh").isNotNull())
        .select(*KEY, "n_words", "idx", "pos", "len", "wh", "wh2")
    )


def find_hits(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, max_bytes: int = 64 << 20
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, spans, items, contaminated, and its key.

    spans are (pos, len, wh, wh2): first word (from 0) and length of each hit window.
    """
    by_item = settle(benchmark_windows(benchmark, size))
    windows = by_item.drop("item").distinct()
    total = windows.agg(F.sum(F.octet_length("win") + 64)).first()[0]
    slices = max(1, -(-(total or 0) // max_bytes))
    scans = []
    for k in range(slices):
        part = windows if slices == 1 else windows.where(F.pmod("h", F.lit(slices)) == k)
        scan = _scan(docs, part)
        scans.append(scan if k == 0 else scan.where(F.col("idx") > 0))
    first = F.col("idx") == 0
    hit = F.when(
        F.col("wh").isNotNull(),
        F.struct(F.col("pos").cast("long").alias("pos"), F.col("len").cast("long").alias("len"), "wh", "wh2"),
    )
    # A document's hits are no more than its words.
    per_doc = (
        reduce(DataFrame.unionByName, scans)
        .groupBy(*KEY)
        .agg(
            F.max(F.col("n_words").cast("long")).alias("n_words"),
            F.count_if(first).alias("copies"),
            F.array_sort(F.collect_set(hit)).alias("spans"),
        )
    )
    # Settled, as the items are looked up from it.
    per_doc = settle(
        per_doc.withColumn(
            "n_hit",
            F.aggregate(
                "spans",
                F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
                lambda a, s: F.struct(
                    (
                        a["hit"]
                        + F.greatest(F.lit(0).cast("long"), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))
                    ).alias("hit"),
                    F.greatest(a["end"], s["pos"] + s["len"]).alias("end"),
                ),
                lambda a: a["hit"],
            ),
        )
    )
    pairs = per_doc.where(F.size("spans") > 0).select(*KEY, F.explode("spans").alias("s"))
    named = (
        pairs.select(*KEY, F.col("s.wh").alias("h"), F.col("s.wh2").alias("h2"))
        .distinct()
        .join(by_item.select("h", "h2", "item").distinct(), ["h", "h2"])
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"i.{c}")) for c in KEY]
    found = per_doc.alias("d").join(named.alias("i"), on, "left")
    return found.select(
        *(F.col(f"d.{c}") for c in (*KEY, "n_words", "n_hit", "spans", "copies")),
        F.coalesce("i.items", F.array().cast("array<string>")).alias("items"),
        (F.col("d.n_hit") > 0).alias("contaminated"),
    )


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row of `docs`: the digest columns of the contract."""
    found = find_hits(docs, benchmark, size)
    return found.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, mode: str = "document"
) -> DataFrame:
    """`docs` without contaminated documents, or (mode "span") without the hit words.

    Columns are those of `docs`.  In span mode a hit word goes together with the
    separators that follow it; n_chars, if there, is counted anew.
    """
    bad = find_hits(docs, benchmark, size).where("contaminated")
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEY]
    if mode == "document":
        return unpacked(packed(docs).alias("d").join(bad.alias("b"), on, "left_anti"), docs.columns)
    if mode != "span":
        raise ValueError(f"mode is 'document' or 'span', not {mode!r}")
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
    other = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
    joined = packed(docs).alias("d").join(bad.select(*KEY, "spans").alias("b"), on, "left").select("row", "spans")
    # Hit words as flags: one look a word.
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))
    joined = joined.withColumn("hit", F.array_sort(F.array_distinct(hit))).withColumn("flags", flags("hit"))
    pieces = F.regexp_extract_all("row.text", F.lit(f"{word}|{other}"), F.lit(0))
    joined = joined.withColumn("pieces", F.when(F.col("spans").isNotNull(), pieces))
    # Words and separators alternate: two places for each word, and one for a lead.
    lead = F.when(F.element_at("pieces", 1).rlike(f"^{word}"), 0).otherwise(1)
    joined = joined.withColumn("lead", lead)
    kept = F.filter(
        "pieces", lambda _, i: (i < F.col("lead")) | ~flagged(F.col("flags"), F.floor((i - F.col("lead")) / 2).cast("int"))
    )
    out = joined.withColumn("text", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(count)
    return unpacked(out, docs.columns, **new)
