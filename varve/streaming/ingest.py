"""Streams of actions into a version log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..clock import whole
from ..model import KEY_EXISTS, KEY_NOT_FOUND, SUCCESS, FailedPrecondition
from ..sources.store import VersionStore


def resolve(actions: DataFrame) -> DataFrame:
    """Streaming form of ``actions.outcomes``: the state of a key is whether it exists.

    Actions of one trigger are taken in commit_ts order; a trigger's actions
    must not precede those of an earlier one on the same key.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values("commit_ts", kind="stable")
        codes = []
        for kind in rows["kind"]:
            if kind == "Insert":
                codes.append(KEY_EXISTS if live else SUCCESS)
                live = True
            elif kind in ("Update", "Delete", "Read"):
                codes.append(SUCCESS if live else KEY_NOT_FOUND)
                live = live and kind != "Delete"
            else:
                codes.append(SUCCESS)
                live = True
        state.update((bool(live),))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "commit_ts": rows["commit_ts"].to_numpy(), "kind": rows["kind"].to_numpy(), "code": codes})

    kind = actions.schema["key"].dataType.simpleString()
    return actions.groupBy("key").applyInPandasWithState(step, f"key {kind}, commit_ts long, kind string, code string", "live boolean", "append", GroupStateTimeout.NoTimeout)


def sink(stream: DataFrame, store: VersionStore, checkpoint: str, writer: str = "sink"):
    """Append a stream of (keyspace, key, value, is_deleted) to a store, one commit a micro-batch, until what is there is done.

    A commit bears the micro-batch's id, so one that is tried again after a
    failure is not committed twice.
    """

    def commit(rows: DataFrame, batch: int) -> None:
        if not rows.isEmpty():
            store.append(rows, batch=(writer, str(batch)))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Restore:
    """Takes an exported log into a store, chunk by chunk, and goes on after a failure where it stopped.

    How far it has got (min_index, the number of chunks, whether completed) is
    part of each chunk's commit.  A source whose min_index is newer than that of
    the progress starts anew, and its first chunk replaces what was taken in.
    """

    WRITER = "restore"

    def __init__(self, store: VersionStore, min_index: int):
        self.store, self.min_index = store, min_index

    def progress(self) -> tuple[int, bool, bool]:
        """(chunks taken in, completed, stale): stale progress belongs to an older min_index and does not count."""
        mark = self.store.head().batches.get(self.WRITER)
        if mark is None:
            return 0, False, False
        index, done, completed = (int(x) for x in mark.split(":"))
        return (0, False, True) if index < self.min_index else (done, bool(completed), False)

    def take(self, rows: DataFrame, chunk: int, completed: bool) -> bool:
        """Commit a chunk's rows (with their commit_ts); false if it has been taken in before."""
        done, finished, stale = self.progress()
        if finished or chunk < done:
            return False
        if chunk > done:
            raise FailedPrecondition(f"chunk {done} is missing")
        self.store.append(rows, batch=(self.WRITER, f"{self.min_index}:{chunk + 1}:{int(completed)}"), index=self.min_index if completed else 0, replace=stale)
        return True

    def run(self, rows: DataFrame, index_rows: DataFrame) -> int:
        """Take in all chunks of an export (``export.stream``) that are left; how many."""
        done, finished, _ = self.progress()
        left = [] if finished else [r for r in index_rows.filter(F.col("chunk") >= done).orderBy("chunk").toLocalIterator()]
        return sum(self.take(rows.filter(F.col("chunk") == r.chunk).drop("chunk"), r.chunk, r.completed) for r in left)


def newest_counts(versions: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Versions per keyspace and window of commit time, late ones dropped after ``delay``."""
    timed = versions.withColumn("at", F.timestamp_micros(whole(F.col("commit_ts"), 1000))).withWatermark("at", delay)
    return timed.groupBy(F.window("at", window), "keyspace").agg(F.count("*").alias("n"))
