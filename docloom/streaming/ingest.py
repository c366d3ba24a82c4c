"""Documents that arrive as a stream, indexed batch by batch.

Every micro-batch becomes a segment of postings and a folder of documents named after
it, so a batch that is run again after a failure finds itself there and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import DocIndex
from ..operators.postings import postings
from ..sources.corpus import DOC_SCHEMA
from ..sources.segments import SegmentStore


class StreamingIndex:
    """An index in `folder` (segments/, docs/) that a stream of documents extends."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.store = SegmentStore(spark, f"{self.folder}/segments")

    def add(self, docs: DataFrame, batch: int) -> None:
        """Index a batch (doc_id, text and, if known, created and die); again is harmless."""
        for c in ("created", "die"):
            if c not in docs.columns:
                docs = docs.withColumn(c, F.lit(None).cast("timestamp_ntz"))
        kept = docs.select("doc_id", "created", "die")
        kept.write.mode("overwrite").parquet(f"{self.folder}/docs/batch={batch}")
        self.store.append(postings(docs), f"batch-{batch}")

    def start(self, stream: DataFrame, checkpoint: str, compact: bool = True) -> StreamingQuery:
        def sink(docs: DataFrame, batch: int) -> None:
            self.add(docs, batch)
            if compact:
                self.store.compact()

        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def index(self) -> DocIndex:
        docs = self.spark.read.schema(DOC_SCHEMA + ", batch long").parquet(f"{self.folder}/docs").drop("batch")
        return DocIndex.from_postings(self.store.postings(), docs)
