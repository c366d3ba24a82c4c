"""The pipeline against its stages done plainly, and the SQL of the corpus queries."""

import brute
import pytest
from oracle import compare, data_dir

import corpus_pipeline
from docloom.llm import langid
from docloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    ours, theirs = compare(spark, QUERIES[name], ORACLES[name], data_dir("sf0.001"))
    assert ours == theirs and ours


def test_quality_equals_sql_where_cutoffs_reject(spark, tmp_path):
    """Enough good labels for certified cutoffs, and documents above them."""
    rows = [(i, " ".join(f"word{i * 31 + k}" for k in range(12)) + (" # $" if i % 500 == 7 else ""), "en") for i in range(1500)]
    rows += [(i, " ".join(f"w#{i}{k}#" for k in range(12)), "en") for i in range(1500, 1600)]
    rows += [(i, f"zwei drei {i} vier #", None) for i in range(1600, 1650)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 1500), 0) for i in range(1600)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    ours, theirs = compare(spark, QUERIES["op4_quality"], ORACLES["op4_quality"], str(tmp_path))
    assert ours == theirs and sum("symbols" in map(str, r) for r in ours) == 103


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"]


def test_line_stage_compares_lines_of_any_length(spark):
    """The stage drops near copies of a long line without spaces, and the document that has no other."""
    base = "".join(chr(0x4E00 + k * k % 997) for k in range(2500))
    texts = [base, base[:1700] + "x" + base[1701:] + "\nother", base[1:], base[:900] + "xx" + base[902:]]
    frame = spark.createDataFrame([(i, t, "zh", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    left = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.deduplicate_lines(spark, frame, "").collect()}
    assert left == {0: (base, 2500), 1: ("other", 5), 3: (texts[3], 2500)}


def test_pipeline(spark, tmp_path):
    import random

    r = random.Random(8)

    def prose(n, letters="abcdefgh"):
        return " ".join("".join(r.choices(letters, k=r.randrange(3, 9))) for _ in range(n))

    texts = [prose(40) for _ in range(60)]
    texts[20] = texts[3]  # a copy
    near = texts[4].split()
    near[2] = "edited"
    texts[21] = " ".join(near[:20]) + "\n" + " ".join(near[20:])  # near, other lines
    passage = prose(15)
    texts[22] = f"{prose(10)} {passage} {prose(10)}"
    texts[23] = texts[5] + "\n" + prose(30)  # a repeated line
    texts[24], texts[25], texts[26] = None, "", "123 !!!"
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, prose(12))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    # Language ID rejects what has no letters; which others it rejects is asked of the model.
    stage = langid.keep_identified(spark.read.parquet(str(tmp_path / "documents.parquet")))
    left = sorted((x.doc_id, x.text, x.source) for x in stage.collect())
    assert {24, 25, 26}.isdisjoint(i for i, _, _ in left) and len(left) >= 55
    gone = brute.lines_gone([(i, t) for i, t, _ in left])
    cut = []
    for i, t, s in left:
        lines = t.split("\n")
        kept = [x for k, x in enumerate(lines) if k not in gone[i][0] | gone[i][1]]
        if any(x.split() for x in kept):
            cut.append((i, "\n".join(kept), s))
    assert 20 not in {i for i, _, _ in cut}
    groups = brute.near_components([(i, t) for i, t, _ in cut])
    cut = [x for x, (i, _, least) in zip(cut, groups) if i == least]
    assert 21 not in {i for i, _, _ in cut}
    dirty = {x[0] for x in brute.contamination([(i, t) for i, t, _ in cut], [(1, passage)]) if x[5]}
    assert dirty == {22}
    cut = [x for x in cut if x[0] not in dirty]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {i: len(brute.SPACED.findall(t)) for i, t, _ in cut}
    assert {x.doc_id: x.size for x in found} == sizes
    expected = brute.targets([(s, sizes[i]) for i, _, s in cut])
    assert all(x.target == pytest.approx(expected[x.source]) and x.taken <= 3 * x.size for x in found)
