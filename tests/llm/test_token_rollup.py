import pytest

from docloom.llm import token_rollup as t


def test_rollup(spark, corpus, tmp_path):
    rollup = t.TokenRollup(spark, (tmp_path / "rollup").as_uri())
    assert rollup.totals().count() == 0
    rows = t.counted(corpus, {"words-1": t.words})
    n = {r.source: (r.n, r.k) for r in rows.groupBy("source").agg(t.F.sum("tokens").alias("n"), t.F.count("*").alias("k")).collect()}
    assert rollup.commit("one", t.inserts(rows))
    assert not rollup.commit("one", t.inserts(rows))

    def totals():
        return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}

    got = totals()
    assert {s: (sum(v[1] for k, v in got.items() if k[0] == s), sum(v[0] for k, v in got.items() if k[0] == s)) for s in n} == n
    assert rollup.commit("two", t.deletes(rows.where("doc_id = 0")))
    assert totals()["a", "en"] == (got["a", "en"][0] - 1, got["a", "en"][1] - 120)
    new = t.counted(corpus.where("doc_id = 1").withColumn("text", t.F.lit("now three words")), {"words-1": t.words})
    assert rollup.commit("three", t.revisions(rows.where("doc_id = 1"), new))
    after = totals()
    assert after["a", "en"] == (got["a", "en"][0] - 1, got["a", "en"][1] - 120 - 120 + 3)
    assert rollup.commit("nothing", t.inserts(rows.limit(0)))
    rollup.compact()
    assert totals() == after and len(rollup._folders()[0]) == 1
    assert not rollup.commit("two", t.deletes(rows.where("doc_id = 0")))
    assert rollup.commit("four", t.inserts(rows.where("doc_id = 7")))
    rollup.compact()
    assert not rollup.commit("one", t.inserts(rows)) and totals()["c", "de"][1] == after["c", "de"][1] + 2
    with pytest.raises(ValueError):
        rollup.commit("a/b", t.inserts(rows))


def test_byte_pairs(spark, corpus):
    import base64

    import tiktoken

    pairs = (line.split() for line in open(t.VOCABULARY, "rb"))
    own = tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    small = corpus.where("doc_id is null or doc_id <> 11")
    found = t.counted(small, {"bpe": t.byte_pairs(spark, t.VOCABULARY)})
    expected = sorted(len(own.encode_ordinary(r.text or "")) for r in small.collect())
    assert sorted(r.tokens for r in found.collect()) == expected


def test_report_equals_a_recount(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * i, "en", f"s{i % 3}") for i in range(30)], "doc_id bigint, text string, lang string, source string")
    got = {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in t.report(docs, (tmp_path / "r").as_uri()).collect()}
    for s in range(3):
        kept = [i for i in range(30) if i % 3 == s and i % 10 != 3]
        assert got[f"s{s}", "words-1"] == (len(kept), sum(i + (i % 10 == 7) for i in kept))
