"""Transaction actions: outcome codes and the versions that they write.

Streams of single-action transactions need no replay.  Whether a key exists
before an action follows from the last earlier action on it that is neither a
Read nor an Update: after Insert or Upsert it exists, after Delete it does not,
whether they succeeded or not.  Transactions of several actions fold in order.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEY_EXISTS, KEY_NOT_FOUND, LOCK_CHECK_FAILED, SUCCESS
from .ordered import replayed
from .versions import as_of, exists_in_range

READS = ("Read", "ReadRange")
WRITES = ("Insert", "Update", "Upsert", "Delete")


def code(kind: Column, existed: Column) -> Column:
    """Outcome of an action on a key that existed, or not, just before."""
    return (
        F.when((kind == "Insert") & existed, F.lit(KEY_EXISTS))
        .when(kind.isin("Update", "Delete", "Read") & ~existed, F.lit(KEY_NOT_FOUND))
        .otherwise(F.lit(SUCCESS))
    )


def outcomes(actions: DataFrame, keys: tuple[str, ...] = ("keyspace", "key")) -> DataFrame:
    """Single-action transactions (kind, commit_ts) with their ``code``."""
    leaves = F.when(F.col("kind").isin("Insert", "Upsert"), True).when(F.col("kind") == "Delete", False)
    before = Window.partitionBy(*keys).orderBy("commit_ts").rowsBetween(Window.unboundedPreceding, -1)
    existed = F.coalesce(F.last(leaves, ignorenulls=True).over(before), F.lit(False))
    return actions.withColumn("code", code(F.col("kind"), existed))


def written_versions(resolved: DataFrame) -> DataFrame:
    """The versions that successful writes of ``outcomes`` append."""
    done = resolved.filter((F.col("code") == SUCCESS) & F.col("kind").isin(*WRITES))
    deletes = F.col("kind") == "Delete"
    return done.select("keyspace", "key", "commit_ts", F.when(~deletes, F.col("value")).alias("value"), deletes.alias("is_deleted"))


def read_only(actions: DataFrame) -> DataFrame:
    """txn, n_actions, read_only."""
    return actions.groupBy("txn").agg(F.count("*").alias("n_actions"), F.bool_and(F.col("kind").isin(*READS)).alias("read_only"))


def failure(kind: Column, check: Column, found: Column) -> Column:
    """Why an action fails, given whether its key (or any key of its range) is there just before; null if it does not."""
    return (
        F.when((kind == "Insert") & found, F.lit(KEY_EXISTS))
        .when(kind.isin("Update", "Delete") & ~found, F.lit(KEY_NOT_FOUND))
        .when(kind.isin("LockKey", "LockRange") & check.isin("MustExist", "MustNotBeEmpty") & ~found, F.lit(LOCK_CHECK_FAILED))
        .when(kind.isin("LockKey", "LockRange") & check.isin("MustNotExist", "MustBeEmpty") & found, F.lit(LOCK_CHECK_FAILED))
    )


def first_failures(failed: DataFrame) -> DataFrame:
    """txn, commit_ts, code, failed_action of actions (txn, commit_ts, action_id, failure): the first failing action decides."""
    first = F.min(F.when(F.col("failure").isNotNull(), F.struct("action_id", "failure"))).alias("first")
    out = failed.groupBy("txn", "commit_ts").agg(first)
    return out.select("txn", "commit_ts", F.coalesce("first.failure", F.lit(SUCCESS)).alias("code"), F.col("first.action_id").alias("failed_action"))


def validated(actions: DataFrame, versions: DataFrame) -> DataFrame:
    """What each transaction finds at ``commit_ts - 1`` in a log: txn, commit_ts, code, failed_action.

    Actions have txn, commit_ts, action_id, keyspace, kind, key, end and check
    (of LockKey: MustExist, MustNotExist; of LockRange: MustBeEmpty,
    MustNotBeEmpty; anything else is no check).  Each that can fail is looked
    up on its own, all in parallel; nothing is written.
    """
    kind, check = F.col("kind"), F.col("check")
    can_fail = F.coalesce(failure(kind, check, F.lit(True)), failure(kind, check, F.lit(False))).isNotNull()
    ranges = can_fail & (kind == "LockRange")
    before = actions.withColumn("as_of", F.col("commit_ts") - 1)
    asked = before.filter(can_fail & ~ranges).select("keyspace", "key", "as_of").distinct()
    seen = versions.filter("commit_ts is not null").select("keyspace", "key", "commit_ts", "is_deleted")
    live = as_of(seen, asked).select("keyspace", "key", "as_of", F.lit(True).alias("found"))
    keyed = before.filter(can_fail & ~ranges).join(live, ["keyspace", "key", "as_of"], "left")
    ranged = before.filter(ranges).withColumnRenamed("key", "lo").withColumnRenamed("end", "hi")
    ranged = exists_in_range(versions, ranged)
    others = before.filter(~can_fail).withColumn("found", F.lit(False))
    columns = ["txn", "commit_ts", "action_id", "kind", "check", "found"]
    both = keyed.select(*columns).unionByName(ranged.select(*columns)).unionByName(others.select(*columns)).withColumn("found", F.coalesce("found", F.lit(False)))
    return first_failures(both.withColumn("failure", failure(kind, check, F.col("found"))))


class _Scope:
    """Live keys of a scope, sorted, and the actions of its current transaction."""

    def __init__(self):
        self.live: list = []
        self.held: list[tuple] = []

    def has(self, key, end=None) -> bool:
        at = bisect_left(self.live, key)
        return at < len(self.live) and (self.live[at] == key if end is None else self.live[at] < end)

    def finish(self) -> tuple:
        """Outcome of the held transaction, whose writes then take effect."""
        verdict, failed = SUCCESS, None
        for _, _, a, kind, key, end, check in self.held:
            if kind in ("Insert", "Update", "Delete"):
                if self.has(key) == (kind == "Insert"):
                    verdict, failed = (KEY_EXISTS if kind == "Insert" else KEY_NOT_FOUND), int(a)
            elif kind in ("LockKey", "LockRange"):
                wanted = {"MustExist": True, "MustNotBeEmpty": True, "MustNotExist": False, "MustBeEmpty": False}.get(check)
                if wanted is not None and self.has(key, end if kind == "LockRange" else None) != wanted:
                    verdict, failed = LOCK_CHECK_FAILED, int(a)
            if failed is not None:
                break
        else:
            for _, _, _, kind, key, _, _ in self.held:
                there = self.has(key) if kind in WRITES else False
                if kind == "Delete" and there:
                    del self.live[bisect_left(self.live, key)]
                elif kind in WRITES and kind != "Delete" and not there:
                    insort(self.live, key)
        ts, txn = self.held[0][:2]
        self.held = []
        return (txn, ts, verdict, failed)


def _fold_step(state: _Scope | None, row: tuple | None, last: bool) -> list[tuple] | _Scope:
    if state is None:
        return _Scope()
    out = []
    if state.held and state.held[0][:2] != row[:2]:
        out.append(state.finish())
    state.held.append(row)
    if last:
        out.append(state.finish())
    return out


def fold(actions: DataFrame, scope: str = "keyspace") -> DataFrame:
    """Atomic transactions of several actions: txn, commit_ts, code, failed_action.

    The first failing action, in action order, decides its transaction, which
    then writes nothing.  Preconditions see the state before the transaction,
    never its own writes.  Reads report, but do not fail, a missing key.
    ``end`` and ``check`` are as in ``validated`` and may be left out where no
    action has them.  ``scope`` must put all transactions that share keys, or
    whose ranges hold another's keys, into one group: each is replayed in order
    by one task, which holds its live keys only, so pick the finest such column.
    """
    for c, kind in (("end", dict(actions.dtypes)["key"]), ("check", "string")):
        if c not in actions.columns:
            actions = actions.withColumn(c, F.lit(None).cast(kind))
    kind = actions.schema["txn"].dataType.simpleString()
    columns = ["commit_ts", "txn", "action_id", "kind", "key", "end", "check"]
    return replayed(actions, scope, columns[:3], columns, f"txn {kind}, commit_ts long, code string, failed_action long", _fold_step)
