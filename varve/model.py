"""Data model: the version log, keyspaces, status codes and graph types.

A version is a row (keyspace, key, commit_ts, value, is_deleted).  The total
order is keyspace, key (unsigned bytes or the key's own order) and commit_ts
descending, so that the newest version of a key comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keyspaces: 0 and 1 belong to the system, up to 15 are reserved, from 16 on users'.
FIRST_USER_KEYSPACE = 16
KV_KEYSPACE = 100

VERSION = T.StructType(
    [
        T.StructField("keyspace", T.IntegerType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("commit_ts", T.LongType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("is_deleted", T.BooleanType(), False),
    ]
)

SUCCESS, KEY_NOT_FOUND, KEY_EXISTS = "Success", "KeyNotFound", "KeyAlreadyExists"
LOCK_CHECK_FAILED, LOCK_FAILED, CORRUPTED = "LockCheckFailed", "LockFailed", "CorruptedData"
#: Error that a failed action's code becomes for the caller.
ERROR_OF_CODE = {
    KEY_NOT_FOUND: "NotFound",
    KEY_EXISTS: "AlreadyExists",
    LOCK_CHECK_FAILED: "FailedPrecondition",
    LOCK_FAILED: "TransactionAborted",
    CORRUPTED: "CorruptedData",
}
FINAL_STATES = ("Committed", "Aborted", "Failed", "Timedout")

#: Graph value arms and the Spark type that holds each.
VALUE_ARMS = {
    "bool": "boolean", "string": "string", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "bytes": "binary", "list": "variant", "map": "variant", "timestamp": "bigint",
}


class NotFound(Exception):
    """A key that must exist does not."""


class AlreadyExists(Exception):
    """A key that must not exist does."""


class InvalidRequest(ValueError):
    """A request that can be refused without reading any data."""


class FailedPrecondition(Exception):
    """A lock check or an expected version did not hold."""


def error_of(code: Column) -> Column:
    """Error that a result code becomes for the caller, null for Success; an unknown code is an internal error."""
    table = F.create_map(*[F.lit(x) for pair in ERROR_OF_CODE.items() for x in pair])
    return F.when(code != SUCCESS, F.coalesce(F.try_element_at(table, code), F.lit("Internal")))


def decoded(code: Column, value: Column) -> Column:
    """struct(value, error) of a point read's result: a missing key is a null value, any other failure an error."""
    return F.struct(F.when(code == SUCCESS, value).alias("value"), F.when(code != KEY_NOT_FOUND, error_of(code)).alias("error"))


def valid_keyspace(column: Column) -> Column:
    """True for keyspaces that users may write to."""
    return column >= FIRST_USER_KEYSPACE


def value_error(arm: Column, payload: Column) -> Column:
    """Null for a valid graph value, else why it is not: unknown arm or no payload."""
    return F.when(~arm.isin(*VALUE_ARMS) | arm.isNull(), F.lit("unknown type")).when(payload.isNull(), F.lit("no payload"))


def events_as_versions(events: DataFrame) -> DataFrame:
    """Every event as a version of its user's key: an ``error`` deletes, any other writes ``value``."""
    from .clock import nanos

    return events.select(
        F.lit(KV_KEYSPACE).alias("keyspace"),
        F.col("user_id").alias("key"),
        nanos(F.col("ts")).alias("commit_ts"),
        F.col("value"),
        (F.col("event_type") == "error").alias("is_deleted"),
    )


def events_as_actions(events: DataFrame) -> DataFrame:
    """Every event as a transaction of one action: signup inserts, click upserts, purchase updates, error deletes, view reads."""
    from .clock import nanos

    kinds = {"signup": "Insert", "click": "Upsert", "purchase": "Update", "error": "Delete", "view": "Read"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return events.select(
        F.col("event_id").alias("txn"),
        F.lit(KV_KEYSPACE).alias("keyspace"),
        F.col("user_id").alias("key"),
        nanos(F.col("ts")).alias("commit_ts"),
        kind[F.col("event_type")].alias("kind"),
        "value",
    )
