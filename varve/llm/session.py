"""Shared storage for intermediate tables.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``, which every
executor and the driver can reach, so a lost executor never loses a stage.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch, unless the session sets its own: they bound what a worker holds of a table.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = tempfile.mkdtemp(prefix="varve-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/varve-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back with its own schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this worker has freed to the system, which else keeps it for as long as the worker lives."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(spark: SparkSession) -> None:
    """Let the driver drop the plans and broadcasts of what is done, which else fill its heap until it is full."""
    gc.collect()
    spark._jvm.System.gc()


def arrow_map(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with small batches, so that long texts and large sets stay within a worker's memory.

    The bounds are set in the session unless it has its own; a task's memory is
    given back at its end.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    conf = df.sparkSession.conf
    for key, value in BATCH_LIMITS.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return df.mapInArrow(run, schema)


def release(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete what this session has written to the shared folder, but for the paths ``keep``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = [p for p in _written if p not in keep]
    _written[:] = [p for p in _written if p in keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
