"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20
PYTHON_BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder (spark.checkpoint.dir); on one machine alone a temporary one will do."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="foliant-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def state_of(spark: SparkSession, path: str) -> str:
    """A text that changes whenever a table's files do: their names, sizes and times, asked from the file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    told = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for one table in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bytes_a_row: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` broadcast if its rows, counted now, take ``most`` bytes at most; else joins shuffle it."""
    return F.broadcast(df) if df.count() * bytes_a_row <= most else df


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker of this session gets at a time by bytes, not by rows alone; a session that asks for less keeps that."""
    known, name = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < known(spark.conf.get(name)) <= PYTHON_BATCH_BYTES:
        spark.conf.set(name, str(PYTHON_BATCH_BYTES))
