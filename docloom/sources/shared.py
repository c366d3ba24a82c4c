"""The folder that driver and executors share, and publishing folders in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return spark.sparkContext.getCheckpointDir()


def hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def passing_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that goes with the session."""
    path, fs = hadoop(spark, f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    fs.mkdirs(path)  # what isn't there yet can't be marked
    fs.deleteOnExit(path)
    return path.toString()


#: Bytes of stored input for a partition of a shuffle.
PART_BYTES = 32 << 20


def parts(rows: DataFrame) -> int | None:
    """Partitions to deal rows to, so that a task's share doesn't grow with the input; None if Spark's setting will do.

    What the plan reads is counted as stored, from its statistics; no job runs.
    """
    leaves, size = rows._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        size += int(leaves.apply(i).stats().sizeInBytes())
    found = -(-size // PART_BYTES)
    # A source of unknown size says 2^63 - 1.
    return found if int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) < found and size < 1 << 60 else None


def publish(spark: SparkSession, rows: DataFrame, target: str, work: str, writer=lambda w: w, note: tuple[str, str] | None = None) -> bool:
    """Write rows to a folder of their own below `work` and rename it to `target`; False if that is taken.

    Of writers that meet, the first rename wins.  A later one lands inside the target,
    under a hidden name that readers pass over, sees that and takes its folder away.
    """
    to, fs = hadoop(spark, target)
    if fs.exists(to):
        return False
    name = f"_{uuid.uuid4().hex}"
    own, _ = hadoop(spark, f"{work}/{name}")
    writer(rows.write).parquet(own.toString())
    if note:
        out = fs.create(hadoop(spark, f"{work}/{name}/{note[0]}")[0])
        out.write(bytearray(note[1].encode()))
        out.close()
    fs.mkdirs(to.getParent())
    inside, _ = hadoop(spark, f"{target}/{name}")
    if not fs.rename(own, to):
        fs.delete(own, True)
        return False
    if fs.exists(inside):
        fs.delete(inside, True)
        return False
    return True


def note_of(spark: SparkSession, path: str) -> str:
    """The text of a small file, empty if there is none."""
    p, fs = hadoop(spark, path)
    if not fs.exists(p):
        return ""
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
