"""Line deduplication across documents, exact and within one edit.

Lines are compared by their words.  Of equal lines the earliest stays (least doc_id,
then least line number).  A line also goes if an earlier one is within the edit bound,
one element replaced, put in or left out.  Elements are words where both lines have
WORDS of them or more, else characters, for lines of CHARS of them or more (so that an
edit is a fifth of a line's words at most, and a twentieth of its characters).

Near lines are found by their deletion neighbourhood: every variant of a line with one
element left out is emitted as a hashed key, and equal variants are joined.  Lines that
share a variant with the element missing at the same place are all within the bound of
each other, and so is a line that equals another's variant; so each key needs the
earliest line that bears it, not pairs, and a template with a million fillings costs a
million rows.  The link to the earliest is verified on the lines themselves; should a line
be unlike the earliest, which its hash alone brought, all that bear a hash of its meet
again by SHA-256 of the variants, so no other partner is lost with that one.

Only lines with a possible partner emit variants.  One edit leaves the first or the last
half of the shorter line intact, so keys of the halves (for a partner as long or longer,
and for one shorter) are counted first.  A line that shares one with another line emits
the variants with an element of the rest left out; the others, nearly all, emit none.
Of lines of more than BLOCK characters only blocks emit variants whose surroundings
another line shares (see `_long_marks`), so a line of any length is compared.

Defined cases.  Null text stays null.  Lines without words are kept and compared with
nothing.  Lines compared by characters that have under 20 are compared exactly.  Very
long texts: work grows with the text, and with the square of a line's length for a line
of many words that shares a half.  Ties: only lines of repeated ids.
Null doc_ids come last.  Rows with the same doc_id are one document: lines at the same
place in both are as early as each other, and neither goes for the other.  Repeated rows get the same result.  Empty table:
no rows.  Extra and clashing columns are kept by `keep_lines`, ignored otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, flagged, flags, packed, text_key, unpacked

KEY = ["doc_id", "_k1", "_k2"]
ID = ["h1", "h2"]
#: Words from which lines are compared by words, and characters from which shorter lines are compared at all.
WORDS, CHARS = 5, 20
#: Characters of a block; lines of more are hashed by blocks.
BLOCK = 1000


def _spaced(text: Column) -> Column:
    """The other white space than line ends as spaces."""
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _single(line: Column) -> Column:
    """A line's words with one space between."""
    return F.when(F.contains(line, F.lit("  ")), F.regexp_replace(F.btrim(line, F.lit(" ")), " +", " ")).otherwise(F.btrim(line, F.lit(" ")))


def _n_words(t: Column) -> Column:
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1)


def _first(t: Column, k: Column, chars: bool) -> Column:
    return F.substr(t, F.lit(1), k) if chars else F.call_function("substring_index", t, F.lit(" "), k)


def _last(t: Column, k: Column, chars: bool) -> Column:
    return F.right(t, k) if chars else F.call_function("substring_index", t, F.lit(" "), -k)


def _without(t: Column, at: Column, n: Column, chars: bool) -> Column:
    """t without element `at` of its n."""
    before, after = _first(t, at - 1, chars), _last(t, n - at, chars)
    return F.concat(before, after) if chars else F.btrim(F.concat(before, F.lit(" "), after), F.lit(" "))


def _half(m: Column) -> Column:
    return F.floor(m / 2).cast("int")


def _halves(t: Column, n: Column, chars: bool) -> Column:
    """Keys of the first and last halves for a partner as long or longer, then for one shorter."""
    keys = []
    for m in (n, n - 1):
        for kind, part in ((0, _first), (1, _last)):
            keys.append(F.xxhash64(F.lit(2 * chars + kind), m, part(t, _half(m), chars)))
    return F.array(*keys)


def _lines(docs: DataFrame) -> DataFrame:
    """KEY, line_no, h1, h2 (128 bits of the words) and keys of the lines with words."""
    rows = docs.select("doc_id", *text_key(F.col("text")), F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line_no", "line"))
    rows = rows.select(*KEY, "line_no", _single(F.col("line")).alias("t")).where("t <> ''").withColumn("n", _n_words(F.col("t")))
    t, n, c = F.col("t"), F.col("n"), F.char_length("t")
    by_words, by_chars = _halves(t, n, False), _halves(t, c, True)
    short = (n <= WORDS) & (c >= CHARS)
    keys = F.when(n > WORDS, by_words).when(short & (n == WORDS), F.concat(by_words, by_chars)).when(short, by_chars).when(n == WORDS, by_words)
    # Of a line of WORDS words the characters count only against a shorter one.
    return rows.select(*KEY, "line_no", F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"), (n < WORDS).alias("short"), keys.alias("keys"))


def _kinds() -> Column:
    """(kind, key) of a line's halves: 0 to 3 by words, 4 to 7 by characters."""
    return F.transform("keys", lambda k, i: F.struct(F.when(F.col("short"), i + 4).otherwise(i).alias("kind"), k.alias("key")))


def _fetched(docs: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """o (order among all these lines), doc_id, line_no, ID, mask, t of lines at places (KEY, line_no, ID, mask)."""
    told = F.array_sort(F.collect_list(F.struct("line_no", *ID, "mask")))
    per = places.groupBy(*KEY).agg(told.alias("told")).withColumn("nos", F.col("told.line_no"))
    per = scratch.settle(per.withColumn("flags", flags("nos")).drop("nos"))
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in KEY]
    own = docs.select("doc_id", *text_key(F.col("text")), "text").alias("d").join(bounded(per).alias("p"), on)
    got = F.filter(F.split(_spaced(F.col("text")), "\n"), lambda _, i: flagged(F.col("flags"), i))
    own = own.select("d.doc_id", "told", F.posexplode(got).alias("j", "line"))
    own = own.select("doc_id", F.get("told", F.col("j")).alias("p"), _single(F.col("line")).alias("t"))
    # Rows that are repeated bring a line twice.
    own = scratch.settle(own.select("doc_id", "p.*", "t").dropDuplicates(ID))
    scratch.drop(per)
    own = own.orderBy(F.col("doc_id").isNull(), "doc_id", "line_no", *ID).withColumn("o", F.monotonically_increasing_id())
    return scratch.settle(own.select("o", "doc_id", "line_no", *ID, "mask", "t"))


def _marks(found: DataFrame, chars: bool) -> DataFrame:
    """v, m, at, o: the variants of lines (o, mask, t) with element `at` left out (0: none)."""
    t, shift = F.col("t"), 4 * chars
    n = F.char_length(t) if chars else _n_words(t)
    own = found.withColumn("mask", F.shiftright("mask", shift).bitwiseAND(15)).where("mask > 0").withColumn("n", n.cast("int"))
    if chars:
        own = own.where(F.col("n") <= BLOCK)

    def has(*bits: int) -> Column:
        return F.col("mask").bitwiseAND(sum(1 << b for b in bits)) > 0

    n = F.col("n")
    # What is left of a half that others share.
    lo = F.when(has(1, 3), 1).when(has(2), _half(n - 1) + 1).otherwise(_half(n) + 1)
    hi = F.when(has(0, 2), n).when(has(3), n - _half(n - 1)).otherwise(n - _half(n))
    cut = own.select("o", "n", "t", F.explode(F.sequence(lo, hi)).alias("at"))
    rest = _without(t, F.col("at"), n, chars)
    cut = cut.select("o", (n - 1).alias("m"), "at", F.xxhash64(F.lit(int(chars)), rest).alias("v"))
    whole = own.select("o", n.alias("m"), F.lit(0).alias("at"), F.xxhash64(F.lit(int(chars)), t).alias("v"))
    return cut.unionByName(whole)


def _long_marks(found: DataFrame, scratch: Scratch) -> DataFrame:
    """`_marks` by characters of the lines (o, n, t) of more than BLOCK; those of BLOCK only tell what they share.

    A text's hash is the xor of its blocks' hashes, each with the block's number; with one
    block that is the hash of `_marks`.  Where a character of a block is left out, later
    blocks begin one further on.  So a block's surroundings are known without its variants,
    and only blocks whose surroundings another line shares emit them.
    """
    j, b, m = F.col("j"), F.col("b"), F.col("n") - 1

    def hashed(part: Column) -> Column:
        return F.when(part == "", F.lit(0)).otherwise(F.xxhash64(j + 1, part))

    # The empty block at the end stands for one that only a longer partner has.
    cuts = (F.regexp_extract_all("t", F.lit(f"(?s)(.{{0,{BLOCK}}})(?=(.?))"), F.lit(k)) for k in (1, 2))
    blocks = found.select("o", "n", F.posexplode(F.arrays_zip(*cuts))).select("o", "n", "pos", "col.*").toDF("o", "n", "j", "b", "next")
    blocks = blocks.withColumn("f", hashed(b)).withColumn("g", hashed(F.concat(F.substr(b, F.lit(2)), "next")))
    line = Window.partitionBy("o")
    before = F.bit_xor(F.col("f").bitwiseXOR(F.col("g"))).over(line.orderBy("j").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("whole", F.bit_xor("f").over(line)).withColumn("rest", F.bit_xor("g").over(line).bitwiseXOR(F.coalesce(before, F.lit(0))))
    rest, others = F.col("rest").bitwiseXOR(F.col("g")), F.col("whole").bitwiseXOR(F.col("f"))
    blocks = scratch.settle(blocks.select("o", "n", "j", "b", "next", "whole", rest.alias("rest"), others.alias("others")))
    long = blocks.where((F.col("n") > BLOCK) & (b != "")).withColumn("m", m)
    keys = long.select("m", "j", "rest", F.lit(1).alias("c")).unionByName(blocks.select(F.col("n").alias("m"), "j", F.col("others").alias("rest"), F.lit(0).alias("c")))
    shared = keys.groupBy("m", "j", "rest").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("lines")).where("c > 0 and lines > 1")
    shared = scratch.settle(shared.select("m", "j", "rest"))
    cut = long.join(bounded(shared), ["m", "j", "rest"]).select("o", "m", "j", "b", "next", "rest", F.explode(F.sequence(F.lit(1), F.char_length("b"))).alias("i"))
    left = F.concat(F.substr(b, F.lit(1), F.col("i") - 1), F.substr(b, F.col("i") + 1), "next")
    cut = cut.select("o", "m", (j * BLOCK + F.col("i")).alias("at"), F.col("rest").bitwiseXOR(hashed(left)).alias("v"))
    whole = blocks.where((F.col("n") > BLOCK) & (j == 0)).select("o", F.col("n").alias("m"), F.lit(0).alias("at"), F.col("whole").alias("v"))
    marks = scratch.settle(cut.unionByName(whole))
    scratch.drop(blocks, shared)
    return marks


def _met(marks: DataFrame, found: DataFrame, chars: bool, scratch: Scratch) -> DataFrame:
    """o, ID, alike, near: lines that bear a key (v, m) of an earlier one; whether the earliest is within one edit, and they go."""
    # The same element missing at the same place: one replaced.
    swapped = marks.where("at > 0").groupBy("v", "m", "at").agg(F.min("o").alias("by"), F.count(F.lit(1)).alias("c"))
    swapped = scratch.settle(swapped.where("c > 1").select("v", "m", "at", "by"))
    a = marks.where("at > 0").join(bounded(swapped), ["v", "m", "at"])
    # A whole line that is another's variant: one put in or left out.
    whole, cut = (F.min(F.when(c, F.col("o"))) for c in (F.col("at") == 0, F.col("at") > 0))
    grown = marks.groupBy("v", "m").agg(whole.alias("w"), cut.alias("c")).where("w is not null and c is not null")
    grown = scratch.settle(grown)
    b = marks.join(bounded(grown), ["v", "m"]).withColumn("by", F.when(F.col("at") == 0, F.col("c")).otherwise(F.col("w")))
    links = a.select("o", "by").unionByName(b.select("o", "by")).where("by < o").groupBy("o").agg(F.min("by").alias("by"))
    x = links.join(found.select("o", "doc_id", "line_no", *ID, "t"), "o")
    y = found.select(F.col("o").alias("by"), F.col("t").alias("other"), F.col("doc_id").alias("at_id"), F.col("line_no").alias("at_no"))
    alike = within_one_edit(*(F.split(c, "" if chars else " ") for c in ("t", "other")))
    near = F.lit(True)
    if chars:  # levenshtein is fast on short lines and takes the square of a length
        alike = F.when(F.char_length("t") <= BLOCK, F.call_function("levenshtein", "t", "other", F.lit(1)) >= 0).otherwise(alike)
        # A pair that both have WORDS words is compared by those; then one word differs, so it is found there.
        near = F.least(_n_words(F.col("t")), _n_words(F.col("other"))) < WORDS
    # Where ids repeat, lines may be at the same place: neither is earlier, nor is one between them.
    earlier = ~(F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("line_no") == F.col("at_no")))
    met = x.join(y, "by").where(earlier).select("o", *ID, alike.alias("alike"), near.alias("near"))
    met = scratch.settle(met.withColumn("near", F.col("alike") & F.col("near")))
    scratch.drop(swapped, grown)
    return met


def _spelled(marks: DataFrame, astray: DataFrame, found: DataFrame, chars: bool) -> DataFrame:
    """The marks with a hash that one of lines `astray` (o) bears, with SHA-256 of the variants instead."""
    hashes = marks.join(astray, "o").select("v", "m").distinct()
    own = marks.join(hashes, ["v", "m"]).select("o", "m", "at").join(found.select("o", "t"), "o")
    t, at = F.col("t"), F.col("at")
    variant = F.when(at == 0, t).otherwise(_without(t, at, F.col("m") + 1, chars))
    return own.select("o", "m", "at", F.unhex(F.sha2(variant, 256)).alias("v"))


def _near(found: DataFrame, chars: bool, scratch: Scratch) -> DataFrame:
    """ID of the lines (o, doc_id, line_no, ID, mask, t) that have one at an earlier place within one edit."""
    tables = [scratch.settle(_marks(found, chars))]
    long = found.where("mask >= 16").select("o", F.char_length("t").alias("n"), "t").where(F.col("n") >= BLOCK)
    if chars and long.count():
        tables.append(_long_marks(long, scratch))
    marks = reduce(DataFrame.unionByName, tables)
    met = _met(marks, found, chars, scratch)
    # Lines that hashes alone brought together may hide later partners.
    astray = met.where("not alike").select("o")
    if astray.count():
        tables.append(scratch.settle(_spelled(marks, astray, found, chars)))
        met = met.unionByName(_met(tables[-1], found, chars, scratch))
    scratch.drop(*tables)
    return met.where("near").select(*ID)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether word lists differ by at most one word replaced, put in or left out."""
    n, m = F.size(a), F.size(b)

    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(differs > 0, differs - 1).otherwise(F.least(n, m))

    kept = common(a, b) + common(F.reverse(a), F.reverse(b))
    return ((n == m) & (kept >= n - 1)) | ((F.abs(n - m) == 1) & (kept >= F.least(n, m)))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """KEY, n_exact, n_near, flags (bytes, a 1 for each line that goes): per document that loses a line."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.settle(_lines(docs))
    # Lines that share a half with another line; counted before any shuffle, however common the line.
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ID for f in (F.min, F.max)]
    halves = lines.select(*ID, F.explode("keys").alias("key")).groupBy("key").agg(*ends)
    shared = scratch.settle(halves.where("min_h1 <> max_h1 or min_h2 <> max_h2").select("key"))
    wanted = lines.select(*ID, F.explode(_kinds()).alias("k")).select(*ID, "k.kind", "k.key").join(bounded(shared), "key")
    wanted = wanted.groupBy(*ID).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("kind"))).alias("mask"))
    repeated = lines.groupBy(*ID).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*ID, F.lit(0).alias("mask"))
    touched = scratch.settle(wanted.unionByName(repeated).groupBy(*ID).agg(F.bit_or("mask").alias("mask")))
    marked = scratch.settle(lines.join(bounded(touched), ID).select(*KEY, "line_no", *ID, "mask"))
    scratch.drop(lines, shared, touched)
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "line_no", "_k1", "_k2")
    first = marked.groupBy(*ID).agg(F.min(place).alias("p"), F.max("mask").alias("mask"), F.count(F.lit(1)).alias("c"))
    first = scratch.settle(first.select(*ID, "mask", "c", "p.*"))
    found = _fetched(docs, first.where("mask > 0").select(*KEY, "line_no", *ID, "mask"), scratch)
    near = _near(found, False, scratch).unionByName(_near(found, True, scratch)).distinct().withColumn("near", F.lit(True))
    # A row for each line of which some occurrence goes.
    fate = first.select(*ID, "c", F.col("doc_id").alias("at_id"), F.col("line_no").alias("at_no")).join(near, ID, "left")
    fate = scratch.settle(fate.where("near or c > 1").drop("c"))
    gone = marked.join(bounded(fate), ID)
    later = ~(F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("line_no") == F.col("at_no")))
    gone = gone.where(F.col("near") | later).groupBy(*KEY).agg(
        F.size(F.collect_set(F.when(F.col("near").isNull(), F.col("line_no")))).alias("n_exact"),
        F.size(F.collect_set(F.when(F.col("near"), F.col("line_no")))).alias("n_near"),
        F.sort_array(F.collect_set("line_no")).alias("nos"),
    )
    gone = scratch.settle(gone.withColumn("flags", flags("nos")).drop("nos"))
    scratch.close(gone)
    return gone


def cleaned(docs: DataFrame) -> DataFrame:
    """row (the columns of `docs` as a struct), text without the lines, n_lines (with words, before), n_exact, n_near."""
    gone = dropped_lines(docs)
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}")) for c in KEY]
    lines = F.split("row.text", "\n")
    left = F.filter(lines, lambda _, i: ~F.coalesce(flagged(F.col("flags"), i), F.lit(False)))
    worded = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))
    rows = packed(docs).alias("d").join(gone.hint("shuffle_hash").alias("g"), on, "left").select("row", "flags", "n_exact", "n_near")
    return rows.select(
        "row",
        F.when(F.col("flags").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(F.col("row.text").isNull(), 0).otherwise(worded).cast("long").alias("n_lines"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_near")),
    )


def report(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_lines (with words), n_exact and n_near gone, n_chars and text_sha256 of what is left."""
    return cleaned(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_exact", "n_near",
        F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
    )


def keep_lines(docs: DataFrame) -> DataFrame:
    """`docs` after the loss, n_chars counted anew, without the documents that lost every line with words."""
    d = cleaned(docs).where("n_lines = 0 or n_exact + n_near < n_lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_exact") + F.col("n_near") > 0, count).otherwise(F.col("row.n_chars"))
    return unpacked(d, docs.columns, **new)
