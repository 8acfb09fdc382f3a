"""Ordered export in numbered chunks, resumable at any address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..clock import whole
from ..model import FIRST_USER_KEYSPACE, FailedPrecondition, InvalidRequest
from .ordered import numbered

CHUNK = 10_000


def address_range(versions: DataFrame, start: tuple[int, object, int] | None = None) -> DataFrame:
    """Versions of user keyspaces from address (keyspace, key, commit_ts) on, that address included."""
    found = versions.filter(F.col("keyspace") >= FIRST_USER_KEYSPACE)
    if start is None:
        return found
    space, key, ts = F.col("keyspace"), F.col("key"), F.col("commit_ts")
    later_key = (key > F.lit(start[1])) | ((key == F.lit(start[1])) & (ts <= start[2]))
    return found.filter((space > start[0]) | ((space == start[0]) & later_key))


def chunks(versions: DataFrame, size: int = CHUNK, start: tuple[int, object, int] | None = None) -> DataFrame:
    """Versions in address order with ``chunk``, from 0, of ``size`` rows each.

    Rows are range-partitioned, sorted and written once, in parallel; only one
    count for each partition is summed up to number them.
    """
    rows = numbered(address_range(versions, start), ["keyspace", "key", F.desc("commit_ts")], "at")
    return rows.withColumn("chunk", whole(F.col("at"), size)).drop("at")


def stream(versions: DataFrame, index: int, min_index: int = 0, size: int = CHUNK, start: tuple[int, object, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunks of a partition, and one row for each that is sent: chunk, n, completed.

    ``index`` is the last applied one of the log and must have reached
    ``min_index``; ``start`` must lie in a user keyspace.  The last chunk is
    the one that is not full, empty if need be; it alone is completed.
    """
    if index < min_index:
        raise FailedPrecondition("the log has not reached the index")
    if start is not None and start[0] < FIRST_USER_KEYSPACE:
        raise InvalidRequest("the start lies in a system keyspace")
    rows = chunks(versions, size, start)
    sent = rows.groupBy("chunk").agg(F.count("*").alias("n"))
    last = sent.agg(F.coalesce(F.max(F.when(F.col("n") < size, F.col("chunk")).otherwise(F.col("chunk") + 1)), F.lit(0).cast("bigint")).alias("chunk"))
    index_rows = sent.join(last, "chunk", "full").select("chunk", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    return rows, index_rows.withColumn("completed", F.col("n") < size)
