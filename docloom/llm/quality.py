"""Quality rules whose cutoffs come with a risk guarantee.

Every rule scores a document, higher being worse, and rejects above a cutoff.  Cutoffs
come into force along one path that is fixed beforehand, the lenient ones of all rules
first, one cutoff of one rule a step.  At each step an exact binomial test on the
labelled good documents of a stratum must rule out that the rules in force together
reject more than `alpha` of them.  Testing stops at the first step that fails (a fixed
sequence, so neither steps nor rules need a correction); the level is divided by strata
(Bonferroni).  With probability `confidence` the rules together falsely reject at most
`alpha` of the good documents of every stratum.  Before the first step all rules are silent.

Defined cases.  Null, empty or word-less text: no words, base_failed.  Null stratum:
one of its own.  A null label is no label; of repeated labels the best one counts.
Repeated rows are documents of their own.  Very long text: its windows are counted in
its row.  Ties: a score equal to a cutoff isn't rejected.  Empty tables: no rows, or no
cutoffs.  Extra and clashing columns are ignored.  A stratum with few good labels (under
86 with four strata: 0.95^n <= 0.05 / 4) has no certified cutoff at all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, space_words

SYMBOLS = "#*$%&|<>"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Cutoffs of the rules, lenient first; fixed before any label is seen.
GRIDS = {
    "symbols": (4.0, 2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "repeats": (0.19, 0.16, 0.13, 0.1, 0.07, 0.04, 0.02),
    "dup_lines": (0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05),
    "long_words": (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
    "short_words": (-2.0, -2.5, -3.0, -3.5, -4.0),
}
#: The cutoffs in the order in which they come into force.
PATH = [(rule, grid[j]) for j in range(max(map(len, GRIDS.values()))) for rule, grid in GRIDS.items() if j < len(grid)]
#: Strata that may be broadcast, a row each.
MAX_STRATA = 10_000


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row of `docs`: doc_id, stratum and the base counts of its whole text."""
    text = F.col("text")
    group = F.col(stratum).cast("string") if stratum in docs.columns else F.lit(None).cast("string")
    bare = text
    for symbol in SYMBOLS:
        bare = F.replace(bare, F.lit(symbol), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    d = docs.select(
        "doc_id", group.alias("stratum"), space_words(text).alias("words"), lines.alias("lines"),
        F.coalesce(F.octet_length(text) - F.octet_length(bare), F.lit(0)).alias("n_symbols"),
    )
    n = F.size("words")
    window = F.when(
        n >= 5,
        F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(5)))),
    )
    d = d.select(
        "doc_id", "stratum", n.alias("n_words"), F.char_length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols", F.when(F.size("lines") > 0, F.size("lines")).otherwise(0).alias("n_lines"),
        F.when(F.size("lines") > 0, F.size("lines") - F.size(F.array_distinct("lines"))).otherwise(0).alias("n_dup_lines"),
        window.alias("hs"),
    )
    # Only a text with a repeated window sorts its windows.
    ranked = F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("hs")) < F.size("hs"), ranked))
    s = F.col("sorted")
    again = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - 1),
        lambda j: F.coalesce(F.get(s, j)["h"] == F.get(s, j - 1)["h"], F.lit(False))
        | F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False)),
    )
    d = d.withColumn("again", F.when(s.isNotNull(), F.sort_array(F.transform(again, lambda j: F.get(s, j)["i"]))))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n"), (p + 5).alias("end")),
        lambda a: a["n"],
    )
    counts = {"n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_lines": F.col("n_lines"), "n_dup_lines": F.col("n_dup_lines"), "n_repeat_words": F.coalesce(covered, F.lit(0))}
    d = d.select("doc_id", "stratum", *(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in counts.items()))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def scores() -> dict[str, Column]:
    """Each rule's score; null where it says nothing."""
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    mean = F.col("word_chars") / n
    return {
        "symbols": F.col("n_symbols") / n,
        "repeats": F.col("n_repeat_words") / n,
        "dup_lines": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines")),
        "long_words": mean,
        "short_words": -mean,
    }


def log_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(X <= k), X binomial of n trials at p, exact; 0 where k is at or above the mean.

    Terms follow from each other and are summed as logarithms, so nothing underflows.
    """
    n, k = n.cast("long"), k.cast("long")
    first = n * math.log1p(-p)
    odds = math.log(p / (1 - p))

    def step(a, i):
        term = a["t"] + F.ln((n - i + 1) / i) + odds
        most = F.greatest(a["m"], term)
        return F.struct(term.alias("t"), most.alias("m"), (a["s"] * F.exp(a["m"] - most) + F.exp(term - most)).alias("s"))

    start = F.struct(first.alias("t"), first.alias("m"), F.lit(1.0).alias("s"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.aggregate(steps, start, step, lambda a: a["m"] + F.ln(a["s"]))).otherwise(F.lit(0.0))


def first_step(rules: set[str] | None = None) -> Column:
    """The step of PATH from which on a row is rejected (by one of `rules`), null if none rejects it."""
    score = scores()
    return F.coalesce(*(F.when(score[k] > cut, F.lit(t)) for t, (k, cut) in enumerate(PATH) if rules is None or k in rules))


def certified_steps(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """stratum, n_good, steps: how many steps of PATH are certified."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1")
    rows = measured.where(~F.col("base_failed")).join(good.select("doc_id"), "doc_id")
    # A row for each stratum, however many labels there are.
    seen = rows.select("stratum", first_step().alias("first")).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_good"), F.array(*(F.count_if(F.col("first") <= t) for t in range(len(PATH)))).alias("ks")
    )
    level = F.ln(F.lit(1 - confidence) / F.count(F.lit(1)).over(Window.partitionBy()))
    seen = seen.withColumn("_level", level)
    fine = F.transform("ks", lambda k: log_tail(F.col("n_good"), k, alpha) <= F.col("_level"))
    failed = F.array_position(fine, False)
    return seen.select("stratum", "n_good", F.when(failed > 0, failed - 1).otherwise(len(PATH)).cast("int").alias("steps"))


def judge(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, confidence: float = 0.95
) -> DataFrame:
    """Per row of `docs`: doc_id, stratum, base counts, base_failed, rejected_by, kept."""
    measured = settle(measure(docs, stratum))
    found = settle(certified_steps(measured, labels, alpha, confidence))
    if found.count() <= MAX_STRATA:
        found = F.broadcast(found)
    d = measured.alias("m").join(found.alias("c"), F.col("m.stratum").eqNullSafe(F.col("c.stratum")), "left")
    d = d.select("m.*", "c.steps")
    over = [F.when(first_step({k}) < F.col("steps"), F.lit(k)) for k in GRIDS]
    d = d.withColumn("rejected_by", F.array_compact(F.array(*over)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("steps")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("rejected_by", ",").alias("rejected_by"),
    )
