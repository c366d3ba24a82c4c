"""Readers of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOC_SCHEMA = "doc_id bigint, created timestamp_ntz, die timestamp_ntz"
POSTING_SCHEMA = "term string, rterm string, doc_id bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, paths: str | list[str], first_id: int = 0) -> DataFrame:
    """(doc_id, text, path): a document per file, numbered from `first_id` in order of path.

    Paths alone, from a listing that opens no file, are numbered in one place; texts are
    read once and stay where they are read.
    """
    path = F.col("_metadata.file_path").alias("path")
    files = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), path)
    names = spark.read.format("binaryFile").load(paths).select(path)
    ids = names.withColumn("doc_id", (F.row_number().over(Window.orderBy("path")) - 1 + first_id).cast("long"))
    return files.join(ids, "path").select("doc_id", "text", "path")


def empty_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOC_SCHEMA)


def empty_postings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POSTING_SCHEMA)


def order_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: created when ordered; finished ones die with their last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    o = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    die = F.when(F.col("o_orderstatus") == "F", F.col("last"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("created"), die.alias("die"))
