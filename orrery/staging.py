"""Tables written to the shared folder of a session, to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch, where the session names none.
BATCH_BYTES = str(8 << 20)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only where the session names none and runs on this machine alone (tests) a
    folder of this machine is set, once per session; on a cluster executors
    would not see each other's files there, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("orrery.scratch", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="orrery-scratch-")
        spark.conf.set("orrery.scratch", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path for one written table."""
    return f"{scratch_root(spark)}/orrery/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage is cut and lost executors cost nothing done."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._orrery_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame, part: str = "") -> None:
    """Delete a staged table, or one partition folder of it, that no frame will read again."""
    _delete(df.sparkSession, f"{df._orrery_path}/{part}" if part else df._orrery_path)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once their frames are garbage on the driver."""
    gc.collect()
    spark._jvm.System.gc()


def cleanup(spark: SparkSession) -> None:
    """Delete what this application has staged; frames read from it are void then."""
    _delete(spark, f"{scratch_root(spark)}/orrery/{spark.sparkContext.applicationId}")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for a context, so that no worker needs it installed.

    Arrow batches are bounded by size as well: 10,000 long texts would not fit
    beside each other in a worker. A size that the session names stays.
    """
    sc = spark.sparkContext
    if sc.getConf().get("spark.sql.execution.arrow.maxBytesPerBatch") is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_orrery_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="orrery-", dir=sc._temp_dir), "orrery.zip")  # goes with the context
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.relpath(file, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._orrery_shipped = True
