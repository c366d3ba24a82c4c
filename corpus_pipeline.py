"""From raw documents to a mix for training: five of the corpus operators in turn.

Every stage takes the documents that the stage before it kept and returns documents;
the last returns what the mix takes of each.  The language model that the first
stage uses is fitted on rows whose ids aren't in the held-out fold.

Defined cases.  Null, empty, word-less or letter-less texts: rejected by the first stage.
Very long texts, ties, repeated rows, null ids: as the stages' operators say.  Empty
tables: no rows.  Extra and clashing columns are kept by all stages but the last.
"""

from __future__ import annotations

from docloom.llm import decontaminate, langid, line_dedup, mixture, ngram_join
from docloom.llm.common import ship, table
from docloom.sources.shared import hadoop, passing_folder


def identify_language(spark, docs, sf_dir):
    """Documents whose language is rejected go."""
    ship(spark)
    return langid.keep_identified(docs)


def deduplicate_lines(spark, docs, sf_dir):
    """Repeated lines go, and documents of which nothing is left."""
    ship(spark)
    return line_dedup.keep_lines(docs)


def join_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    ship(spark)
    return ngram_join.keep_one(docs)


def remove_benchmarks(spark, docs, sf_dir):
    """Documents with a benchmark passage go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """What the mix takes of each document."""
    ship(spark)
    return mixture.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", deduplicate_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", remove_benchmarks),
    ("mixing sources", mix_sources),
]

#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The mix of `documents`; a stage's table goes when the next one is written, the last with the session."""
    folder = passing_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path, fs = hadoop(spark, f"{folder}/{k - 1}")
            fs.delete(path, True)
    return docs
