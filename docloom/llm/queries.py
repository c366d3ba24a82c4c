"""The queries and SQL of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from . import (
    decontaminate,
    html_extract,
    langid,
    licenses,
    line_dedup,
    mixture,
    ngram_join,
    quality,
    token_rollup,
    warc,
)
from ..sources.shared import passing_folder
from .common import table
from .oracles import ORACLES as ORACLES


def op1_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixture(spark, sf_dir):
    return mixture.report(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_langid(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op6_html(spark, sf_dir):
    return html_extract.report(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark, sf_dir):
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_rollup.report(table(spark, sf_dir, "documents"), passing_folder(spark, "rollup"))


def op5_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op9_licenses(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_mixture,
        op3_token_counts,
        op4_quality,
        op5_warc,
        op6_html,
        op7_ngram_join,
        op8_langid,
        op9_licenses,
        op10_line_dedup,
    )
}
