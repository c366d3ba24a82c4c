"""Odd rows through every operator, against plain Python."""

import brute
import pytest

from docloom.llm import decontaminate, langid, licenses, line_dedup, mixture, ngram_join, quality


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ITEMS = "item_id bigint, text string, extra int"


@pytest.fixture(scope="module")
def items(spark, corpus):
    long = next(t for i, t in pairs(corpus) if i == 3).split()
    found = [(1, " ".join(long[20:45]).upper(), 0), (2, "one TWO", 0), (3, None, 0), (4, "", 0), (5, "not there at all", 0), (None, " ".join(long[60:75]), 0), (1, "élan école", 0), (6, "Élan ÉcOLE", 0)]
    return spark.createDataFrame([*found, found[0]], ITEMS)


def test_decontaminate(corpus, items):
    found = sorted_rows(decontaminate.report(corpus, items))
    expected = brute.contamination(pairs(corpus), [(r.item_id, r.text) for r in items.collect()])
    assert found == sorted(expected, key=repr)
    assert sum(r[5] for r in found) == 5


def test_decontaminate_in_slices_and_removal(corpus, items, empty):
    whole = sorted_rows(decontaminate.find_hits(corpus, items).select("doc_id", "n_hit", "items"))
    cut = sorted_rows(decontaminate.find_hits(corpus, items, max_bytes=400).select("doc_id", "n_hit", "items"))
    assert whole == cut
    clean = decontaminate.remove_contaminated(corpus, items)
    assert clean.columns == corpus.columns
    assert {3, 7, 8, 12}.isdisjoint(r.doc_id for r in clean.collect()) and clean.count() == corpus.count() - 5
    spans = decontaminate.remove_contaminated(corpus, items, mode="span")
    texts = {r.doc_id: (r.text, r.n_chars) for r in spans.collect()}
    old = dict(pairs(corpus))
    assert texts[7] == ("", 0) and texts[0][0] == old[0] and texts[4][0] is None
    words = old[3].split()
    assert texts[3][0] == " ".join(words[:20] + words[45:60] + words[75:])
    assert decontaminate.report(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(corpus, items.limit(0)).collect())


def test_mixture(spark, corpus, empty):
    found = mixture.mix(corpus).collect()
    sizes = [(r.source, len(brute.SPACED.findall(r.text or ""))) for r in corpus.collect()]
    expected = brute.targets(sizes)
    assert sorted((r.source or "", r.size) for r in found) == sorted((s or "", n) for s, n in sizes)
    assert {r.source: round(r.target, 6) for r in found} == {s: round(float(t), 6) for s, t in expected.items()}
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    for s, t in expected.items():
        assert abs(sum(r.taken for r in found if r.source == s) - t) <= max(64, 0.01 * t) * 2
    assert sorted_rows(mixture.mix(corpus)) == sorted(map(tuple, found), key=repr)
    assert mixture.mix(empty).count() == 0
    assert [r.taken for r in mixture.mix(corpus.where("doc_id in (4, 5, 6)")).collect()] == [0, 0, 0]


def test_quotas_are_highest_quotients(spark):
    t = [(False, f"s{k}", 10_000, float(x), 0) for k, x in enumerate((997.0, 400.5, 250.25, 31.0, 31.0, 5.0, 0.0))]
    total = int(sum(x[3] for x in t))
    frame = spark.createDataFrame([(*x[:4], total) for x in t], "_no boolean, _src string, source_size bigint, target double, total bigint")
    found = {r._src: r.quota for r in mixture.quotas(frame, block=7).collect()}
    k = total // 7
    ranked = sorted(((x[3] / (2 * j + 1), x[1]) for x in t for j in range(k)), key=lambda q: (-q[0], q[1]))[:k]
    assert found == {x[1]: sum(s == x[1] for _, s in ranked) for x in t}


def test_shards_share_the_quotas(corpus):
    shards = mixture.shard_quotas(corpus, shards=4).collect()
    assert all(r.blocks >= 0 for r in shards)
    deal = mixture.quotas(mixture.source_targets(mixture.document_sizes(corpus))).collect()
    for r in deal:
        own = [x for x in shards if x.source == (None if r._no else r._src)]
        assert sum(x.blocks for x in own) == (r.quota if r.source_size >= 64 else min(int(r.target + 0.5), 3 * r.source_size))
    found = mixture.mix(corpus, shards=4).collect()
    assert all(sum(r.per_shard) == r.taken and min(r.per_shard) >= 0 for r in found)
    for x in shards:
        words = sum(r.per_shard[x.shard] for r in found if r.source == x.source)
        assert (x.blocks - 3) * x.block_size <= words <= x.blocks * x.block_size
    assert [r.taken for r in found] == [r.taken for r in mixture.mix(corpus, shards=1).collect()]


def test_tiny_sources_meet_their_targets(spark):
    rows = [(i, "w " * (i % 23), f"s{i // 2:03}") for i in range(300)] + [(999, "w " * 20_000, "zz")]
    found = mixture.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r[2] - r.target) <= 1 for r in found if r.source != "zz")


def test_block_order_of_huge_sources(spark):
    """Billions of blocks neither overflow nor meet in one place."""
    for n in (10**11, 2**31, 1048573 * 3000, 7):
        blocks = spark.range(5000).selectExpr(f"case when {n} > 5000 then {n} - 1 - id * 19999999 else id end as j").where(f"j >= 0 and j < {n}")
        got = blocks.select(mixture.places(mixture.F.col("j"), mixture.F.lit(n).cast("long"), 17).alias("p"))
        assert got.where(f"p < 0 or p >= {n}").count() == 0 and got.distinct().count() == got.count()


def test_quality(spark, corpus, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, None, None), (None, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    found = sorted_rows(quality.report(corpus, labels).drop("kept", "rejected_by"))
    assert found == sorted(((i, *brute.quality(t)) for i, t in pairs(corpus)), key=repr)
    judged = quality.judge(corpus, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in judged)
    assert quality.report(empty, labels).count() == 0


def test_exact_bounds(spark):
    from math import comb, exp

    cases = [(10, 0, 0.1), (50, 2, 0.1), (400, 3, 0.02), (1000, 9, 0.01), (100_000, 900, 0.01), (5, 5, 0.3)]
    for n, k, p in cases:
        got = spark.range(1).select(quality.log_tail(quality.F.lit(n), quality.F.lit(k), p)).first()[0]
        if k >= n * p:
            assert got == 0
        elif n <= 1000:
            assert exp(got) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
        else:
            assert -10 < got < -5


def test_certified_cutoffs(spark):
    """Good documents never have symbols, so the strictest cutoff of that rule is certified; others follow their rates."""
    good = [(i, " ".join(f"word{i * 31 + k}" for k in range(12)), "en") for i in range(1500)]
    bad = [(i, " ".join(f"w#{i}{k}#" for k in range(12)), "en") for i in range(1500, 1600)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1600)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(found[i].kept for i in range(1500))
    assert all(found[i].rejected_by == ["symbols"] for i in range(1500, 1600))
    # One stratum: 59 labels are enough, 58 aren't.
    for n in (58, 59):
        few = quality.judge(docs, labels.where(f"doc_id % 25 = 0 and doc_id < 25 * {n} or doc_id >= 1500")).collect()
        assert all(r.kept == (n < 59 or r.doc_id < 1500) for r in few)


def test_certified_steps(spark):
    """Steps in force by stratum against exact fractions; a failed step ends the path."""
    import random
    from fractions import Fraction
    from math import comb

    r = random.Random(3)
    path, rows, labels = quality.PATH, [], []
    for lang, n in (("en", 700), ("fr", 130), ("de", 85), (None, 300)):
        for _ in range(n):
            w = [r.choice(("a", "be", "sea", "word", "#", "longer")) if r.random() < 0.03 else "x" * r.randrange(3, 8) + str(r.random())[2:4] for _ in range(40)]
            rows.append((len(rows), "\n".join([" ".join(w)] * (1 + (r.random() < 0.02))), lang))
            labels.append((rows[-1][0], int(r.random() < 0.9), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    measured = quality.measure(docs).cache()
    good = {i for i, q, _ in labels if q}
    first = {}
    for x in measured.select("*", *(c.alias(f"s_{k}") for k, c in quality.scores().items())).collect():
        if x.doc_id in good and not x.base_failed:
            steps = [t for t, (k, cut) in enumerate(path) if x[f"s_{k}"] is not None and x[f"s_{k}"] > cut]
            first.setdefault(x.stratum, []).append(min(steps, default=len(path)))
    expected, share = {}, Fraction(1, 20)
    for lang, of in first.items():
        n, steps = len(of), 0
        while steps < len(path):
            k = sum(f <= steps for f in of)
            if sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) > Fraction(1, 20) / len(first):
                break
            steps += 1
        expected[lang] = (n, steps)
    found = {x.stratum: (x.n_good, x.steps) for x in quality.certified_steps(measured, frame).collect()}
    assert found == expected and expected["de"][1] == 0 < expected["en"][1] < len(path)


def test_ngram_join(corpus, empty):
    found = sorted_rows(ngram_join.report(corpus))
    assert found == sorted(brute.near_components(pairs(corpus)), key=repr)
    assert ngram_join.report(empty).count() == 0


def test_keep_one(corpus):
    kept = ngram_join.keep_one(corpus)
    assert kept.columns == corpus.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([0, 3, 4, 5, 6, 7, 9, 10, 11, 12, None, None, 14, 15], key=repr)


def test_ngram_join_of_chains_and_groups(spark):
    """A chain whose ends aren't alike, many near copies, and a passage that most documents share."""
    from conftest import words  # tests/llm/conftest.py

    docs, step = [], 9
    long = words(9, 400, "c")
    for k in range(12):
        docs.append(" ".join(long[k * step : k * step + 150]))
    base = words(10, 80, "n")
    for k in range(150):
        docs.append(" ".join(base[: k % 80] + [f"edit{k}"] + base[k % 80 + 1 :]))
    passage = " ".join(words(11, 60, "p"))
    for k in range(200):
        docs.append(" ".join(words(1000 + k, 25 + k % 7)) + " " + passage)
    rows = list(enumerate(docs))
    found = sorted_rows(ngram_join.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)))
    assert found == sorted(brute.near_components(rows), key=repr)


def test_line_dedup(spark, corpus, empty):
    base = " ".join(f"word{k}" for k in range(12))
    lines = [base, base.replace("word3 ", "other "), base.replace("word11", "end"), base.replace("word0 ", ""), "new " + base, base + " new", base.replace("word5 word6", "a b"), "tiny line", "tiny lime", "", "  " + base + " "]
    more = [(i, "\n".join(lines[k] for k in ks)) for i, ks in enumerate([(1, 9, 7), (0, 2, 3, 4, 5), (6, 8, 7, 10), (5, 5), (), (9, 9)])]
    more.append((6, None))
    docs = spark.createDataFrame(more, "doc_id bigint, text string")
    gone = brute.lines_gone(more)
    found = {r["doc_id"]: (r.text, r.n_exact, r.n_near) for r in line_dedup.cleaned(docs).select("row.doc_id", "text", "n_exact", "n_near").collect()}
    for i, t in more:
        a, b = gone[i]
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in a | b)
        assert found[i] == (left, len(a), len(b))
    assert {r.doc_id for r in line_dedup.keep_lines(docs).collect()} == {0, 2, 4, 5, 6}
    odd = line_dedup.keep_lines(corpus)
    assert odd.columns == corpus.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in odd.collect()}
    assert 1 not in texts and texts[9] == ("the same line again and again and again\n\nshort", 46) and texts[4] == (None, None)
    assert line_dedup.report(empty).count() == 0


def test_lines_of_every_length(spark):
    """Edited lines of one to sixty words; every pair is compared in Python."""
    import random

    r = random.Random(5)

    def edited(w):
        w = list(w)
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice(([], ["q"], [w[i], "z"]))
        return w

    lines = []
    for n in (*range(1, 10), 11, 24, 25, 60):
        for _ in range(3):
            base = ["".join(r.choices("abcdé", k=r.randrange(1, 9))) for _ in range(n)]
            lines += [" ".join(edited(edited(base) or ["x"]) if two else edited(base)) for two in (0, 0, 1, 1)] + [" ".join(base)]
            lines += ["".join(edited(" ".join(base))) for _ in range(3)]
    lines += ["q" * n for n in (18, 19, 20, 21, 22, 999, 1000, 1001)] + ["x" * 40 + " " + "y" * k for k in (1, 2, 4)]
    r.shuffle(lines)
    docs = [(i, "\n".join(lines[i::20])) for i in range(20)]
    gone = brute.lines_gone(docs)
    assert sum(len(b) for _, b in gone.values()) > 60
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = {x.doc_id: x for x in line_dedup.cleaned(frame).select("row.doc_id", "text", "n_exact", "n_near").collect()}
    for i, t in docs:
        a, b = gone[i]
        assert (found[i].n_exact, found[i].n_near) == (len(a), len(b)), i
        assert found[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in a | b)


def nears(spark, lines):
    """Found near lines of a document of `lines`, and those that all pairs by characters say."""
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id bigint, text string").repartition(3)
    found = {x.doc_id for x in line_dedup.cleaned(frame).select("row.doc_id", "n_near").collect() if x.n_near}
    return found, {k for k, a in enumerate(lines) if any(a != b and brute.one_edit(a, b) for b in lines[:k])}


def test_lines_of_many_characters(spark):
    """One edit at the ends and around the edges of blocks of lines without spaces."""
    import random

    r = random.Random(6)
    lines = []
    for n, places in ((1000, (0, 999)), (1001, (0, 500, 1000)), (2000, (0, 1, 999, 1000, 1999)), (2001, (999, 1001, 2000)), (3500, (1234, 3499))):
        for p in places:
            base = "".join(r.choices("abé語😀", k=n))
            near = [base[:p] + base[p + 1 :], base[:p] + "x" + base[p + 1 :], base[:p] + "y" + base[p:], base + "z"]
            lines += [base, r.choice(near)] if p % 2 else [r.choice(near), base]
            lines += [base[:5] + "xx" + base[7:-2], base[:700] + "w" + base[701:-3] + "www"]
    lines += ["q" * n for n in (1001, 1003, 1002, 2500, 2502, 2501)] + ["a b " + "x" * 1500 + c for c in (" c", " d", " dd")]
    found, expected = nears(spark, lines)
    assert found == expected and len(found) > 18


def test_lines_of_many_small_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(line_dedup, "BLOCK", 7)
    r = random.Random(7)
    bases = ["".join(r.choices("ab", k=n)) for n in range(20, 40) for _ in range(2)]
    lines = list(dict.fromkeys(x for t in bases for p in (r.randrange(len(t)), r.randrange(len(t))) for x in (t, t[:p] + r.choice(("", "c", "cd", "c" + t[p])) + t[p + 1 :])))
    lines = [x for x in lines if len(x) >= 20]
    r.shuffle(lines)
    found, expected = nears(spark, lines)
    assert found == expected and len(found) > 30


def colliding(first, before):
    """Two strings of 64 characters after which Spark's xxhash64 of `before` (32 k bytes of ASCII) goes on alike, whatever follows.

    The hash is of the text after the columns `first` (None: of the text alone).
    """
    import random

    p1, p2, p3, p5, word = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, (1 << 64) - 1
    turn = lambda x, k: (x << k | x >> 64 - k) & word
    seed = 42
    if first is not None:  # the hash of an int
        h = turn(seed + p5 + 4 & word ^ first * p1 & word, 23) * p2 + p3 & word
        h = (h ^ h >> 33) * p2 & word
        h = (h ^ h >> 29) * p3 & word
        seed = h ^ h >> 32
    lane = lambda acc, x: turn(acc + int.from_bytes(x, "little") * p2 & word, 31) * p1 & word
    acc, r = seed + p1 + p2 & word, random.Random(9)
    for k in range(0, len(before), 32):
        acc = lane(acc, before[k : k + 8].encode())
    while True:
        x, y, z = ("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)).encode() for _ in range(3))
        w = (int.from_bytes(z, "little") + (lane(acc, x) - lane(acc, y)) * pow(p2, -1, 1 << 64) & word).to_bytes(8, "little")
        if all(33 <= c <= 126 for c in w):
            return tuple((p + b"-" * 24 + q + b"-" * 24).decode() for p, q in ((x, z), (y, w)))


@pytest.mark.parametrize("kind, before", [(0, "one two three " + "f" * 50), (1, "f" * 96), (1, "f" * 896)])
def test_lines_that_only_share_a_hash(spark, kind, before):
    """The first line meets the others by a hash alone, and mustn't hide that those are near; by words, characters and blocks."""
    a, b = colliding(kind, before)
    same = spark.range(1).select(*(line_dedup.F.xxhash64(line_dedup.F.lit(kind), line_dedup.F.lit(before + x + "end")) for x in (a, b))).first()
    assert same[0] == same[1] and a != b
    tail = "z" * 700 if len(before) > 800 else "" if kind else " five six "
    lines = [before + a + tail + "x", before + b + tail + "y", before + b + tail + "z", before + b + tail + "zz"]
    found = line_dedup.cleaned(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id bigint, text string"))
    expected = brute.lines_gone(list(enumerate(lines))) if len(before) < 800 else {2: ((), (0,)), 3: ((), (0,))}
    assert {x.doc_id for x in found.select("row.doc_id", "n_near").collect() if x.n_near} == {i for i, (_, near) in expected.items() if near} >= {2}


def test_near_lines_of_one_hash(spark):
    """Near lines that no half but their own shares, with the same first 64 bits."""
    before = "one two three " + "f" * 50
    lines = [before + x + " five six" for x in colliding(None, before)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id bigint, text string")
    assert docs.select(line_dedup.F.xxhash64("text")).distinct().count() == 1
    found = line_dedup.cleaned(docs).select("row.doc_id", "n_exact", "n_near").collect()
    assert sorted(map(tuple, found)) == [(0, 0, 0), (1, 0, 1)]
    assert [x.doc_id for x in line_dedup.keep_lines(docs).collect()] == [0]


def test_lines_at_one_place(spark):
    """Of repeated and null ids, lines at the same place are as early as each other."""
    base = " ".join(f"word{k}" for k in range(12))
    near = [base, base.replace("word3", "other"), base.replace("word7", "else")]
    rows = [(8, near[0]), (8, near[1]), (9, near[2]), (None, "a " + near[0]), (None, "b " + near[0])]
    rows += [(None, "\n" + t.replace("word", "name")) for t in near[:2]]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = line_dedup.cleaned(frame).select("row.doc_id", "row.text", "n_near").collect()
    assert {r.text: r.n_near for r in found} == {t: int(k in (2, 3, 4)) for k, (_, t) in enumerate(rows)}


def test_a_template_with_many_fillings(spark):
    base = " ".join(f"word{k}" for k in range(30))
    rows = [(i, f"{base} filling{i} {base}\n{base} {base} common\nfilling{i}") for i in range(300)]
    found = line_dedup.cleaned(spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr("sum(n_exact) as e", "sum(n_near) as n").first()
    assert (found.e, found.n) == (299, 299)


def test_word_edits(spark):
    import itertools

    every = [tuple(w) for n in range(4) for w in itertools.product("ab", repeat=n)]
    cases = spark.createDataFrame([(list(a), list(b)) for a in every for b in every], "a array<string>, b array<string>")
    for r in cases.select("a", "b", line_dedup.within_one_edit(line_dedup.F.col("a"), line_dedup.F.col("b")).alias("same")).collect():
        assert r.same == brute.one_edit(tuple(r.a), tuple(r.b)), r


LETTERS = {"aa": "abcdef", "bb": "uvwxyz", "cc": "éèàçô"}


@pytest.fixture(scope="module")
def languages(spark):
    import random

    r = random.Random(5)
    texts = [(i, " ".join("".join(r.choices(LETTERS[lang], k=r.randrange(2, 8))) for _ in range(r.randrange(3, 60))), lang) for i in range(400) for lang in [r.choice(list(LETTERS))]]
    return spark.createDataFrame(texts, "doc_id bigint, text string, lang string")


def test_langid(languages, corpus, empty):
    found = {r.doc_id: r for r in langid.report(languages).collect()}
    truth = {r.doc_id: r.lang for r in languages.collect()}
    held = [i for i, r in found.items() if r.held_out]
    from zlib import crc32

    assert set(held) == {i for i in truth if crc32(str(i).encode()) % 4 == 2}
    assert sum(found[i].lang_pred == truth[i] for i in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    odd = langid.report(corpus).collect()
    assert len(odd) == corpus.count()
    none = {r.doc_id for r in odd if r.lang_pred == "und"}
    assert {4, 5, 6, 14} <= none and 12 not in none and 15 not in none
    assert langid.keep_identified(corpus).columns == corpus.columns
    assert langid.report(empty).count() == 0
    assert {r.lang_pred for r in langid.report(languages.withColumn("lang", langid.F.lit(None).cast("string"))).collect()} == {"und"}


def test_rare_languages_are_learned(spark, languages):
    """A language of one row in forty has its part of a small sample."""
    rare = [(1000 + i, " ".join("мнопрст"[(i + k) % 7] * 3 for k in range(30)), "dd") for i in range(10)]
    docs = languages.unionByName(spark.createDataFrame(rare, "doc_id bigint, text string, lang string"))
    model = langid.fit(docs, langid.F.lit(True), train_rows=40, least=10)
    assert model.langs == ("aa", "bb", "cc", "dd")
    found = {r.doc_id: r.lang for r in langid.predict(docs, model).select("row.doc_id", "lang").collect()}
    assert all(found[1000 + i] == "dd" for i in range(10))


def test_langid_pieces_add_up():
    import numpy as np
    import pyarrow as pa

    table = np.random.default_rng(0).normal(size=(1 << langid.BITS, 3)).astype(np.float32)
    texts = pa.array(["Ab cd-éf " * 50, None, "", "x" * 300, "é"])
    flat, ends = langid._texts(texts)
    whole, n = langid._sums(flat, ends, table)
    old, langid.PIECE = langid.PIECE, 37
    try:
        parts, m = langid._sums(flat, ends, table)
    finally:
        langid.PIECE = old
    assert (n == m).all() and np.allclose(whole, parts) and n[1] == n[2] == 0


def test_licenses(spark, corpus, empty):
    filler = " ".join(f"filler{k}" for k in range(3000))
    mit = licenses.TEMPLATES["MIT"]
    texts = [
        (1, f"{filler}\nReleased under the MIT License.\n{filler}"),
        (2, mit),
        (3, f"{filler} {mit.replace('copyright', 'COPYRIGHT').replace('sublicense', 'relicense')} {filler}"),
        (4, "Licensed under CC BY-NC 4.0.\n" * 3),
        (5, "the license of the apache version is under the mit"),
        (6, filler),
        (7, "Released " + filler + " under " + filler + " the MIT License"),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert {i: r.license for i, r in found.items()} == {1: "MIT notice", 2: "MIT", 3: "MIT", 4: "CC-BY-NC-4.0 notice", 5: None, 6: None, 7: None}
    assert found[1].coverage == 1 and found[1].first_word == 3000 and 0.97 < found[3].coverage < 1
    assert licenses.report(corpus).count() == corpus.count() and licenses.report(empty).count() == 0


def test_repeated_licenses_inside_a_text():
    scanner, filler = licenses.Scanner(), " ".join(f"filler{k}" for k in range(400))
    mit = licenses.TEMPLATES["MIT"]
    spread = " x ".join(" ".join(mit.split()[k : k + 9]) for k in range(0, 200, 9))
    for name, copy in (("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0.\n"), ("MIT", mit), ("MIT", mit.replace("sublicense", "relicense")), ("MIT", spread)):
        for n in (1, 2, 3, 7):
            for between in (" ", " file two begins "):
                found = scanner.scan(f"{filler} {between.join([copy] * n)} {filler}".encode())
                assert found and found[0][1] == name and found[0][0] > 0.97 and 395 < found[0][2] < 410, (name, n, between, found)
    assert not scanner.scan(f"{filler} {' '.join(sorted(mit.split()))} {filler}".encode())


def test_licenses_that_contain_each_other():
    scanner, filler = licenses.Scanner(), " ".join(f"filler{k}" for k in range(200))
    for name, text in licenses.TEMPLATES.items():
        found = scanner.scan(f"{filler} {text} {filler} {text}".encode())
        assert [f[:2] for f in found] == [(1.0, name)], (name, found)
    both = scanner.scan(f"{filler} Licensed under CC BY 4.0 {filler} Licensed under CC BY-NC 4.0".encode())
    assert {f[1] for f in both} == {"CC-BY-4.0 notice", "CC-BY-NC-4.0 notice"}
    assert [f[1] for f in scanner.scan(b"a Licensed under CC BY-NC 4.0 hello Licensed under CC BY-NC 4.0 there")] == ["CC-BY-NC-4.0 notice"]


def test_licenses_against_all_spans():
    """One to five copies with words put in, left out and replaced; every span is aligned."""
    import random

    r, threshold = random.Random(11), 0.8
    for _ in range(150):
        size = r.randrange(5, 14)
        template = [f"t{r.randrange(size)}" for _ in range(size)]
        text: list[str] = []
        for _ in range(r.randrange(1, 6)):
            copy = list(template)
            for _ in range(r.randrange(3)):
                k = r.randrange(len(copy))
                copy[k : k + 1] = r.choice(([], ["new"], [copy[k], "more"]))
            text += [f"f{r.randrange(99)}" for _ in range(r.randrange(4))] + copy
        words, own = [w.encode() for w in text], [w.encode() for w in template]
        spans = [(len(licenses.align(words[a:b], own)) / size) for a in range(len(words)) for b in range(a + 1, min(len(words), a + size + 2) + 1)]
        found = licenses.Scanner({"x": " ".join(template)}, threshold).scan(" ".join(text).encode())
        assert bool(found) == (max(spans) >= threshold), (template, text)
        assert not found or found[0][0] >= max(spans) - 1 / size - 1e-9, (template, text, found, max(spans))


def test_all_rights_reserved():
    scanner = licenses.Scanner()
    assert [f[:2] for f in scanner.scan(b"one two\nAll rights reserved.\nthree")] == [(1.0, "All rights reserved")]
    assert not scanner.scan(b"all the rights that were reserved")
    bsd = licenses.TEMPLATES["BSD"].replace("materials", "things")
    assert [f[1] for f in scanner.scan(f"Copyright X. All rights reserved. {bsd}".encode())] == ["BSD", "All rights reserved"]


def test_patience_alignment():
    import random

    r = random.Random(3)
    for _ in range(200):
        a = [str(r.randrange(12)).encode() for _ in range(r.randrange(30))]
        b = [str(r.randrange(12)).encode() for _ in range(r.randrange(30))]
        found = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    assert licenses.align(b"a b c d".split(), b"a x c d".split()) == [(0, 0), (2, 2), (3, 3)]
