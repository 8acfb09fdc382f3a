"""Transaction-level operators: routing, decisions, the state machine, batches, collection, watch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import partition_id
from ..model import FINAL_STATES, error_of
from .locks import build_locks
from .ordered import replayed

#: Order in which a batch applies its commands, and in which it stamps those that bring no timestamp.
APPLY_ORDER = ("Abort", "MarkTimedout", "Commit", "Autocommit", "Prepare", "StoreDecision")
STAMP_ORDER = ("Autocommit", "Prepare", "Abort", "StoreDecision", "MarkTimedout")
BATCH_SIZE, BATCH_NS = 100, 10_000_000


def routed(actions: DataFrame, partitions: int) -> DataFrame:
    """Actions (txn, pos, key) with pid, action_id (from 0, in order), principal (the first action's partition) and participants."""
    own = Window.partitionBy("txn").orderBy("pos")
    placed = actions.withColumn("pid", partition_id(F.col("key"), partitions)).withColumn("action_id", F.row_number().over(own) - 1)
    shape = placed.groupBy("txn").agg(F.min_by("pid", "pos").alias("principal"), F.count_distinct("pid").alias("participants"))
    return placed.join(shape, "txn")


def decide(votes: DataFrame) -> DataFrame:
    """Votes (txn, state, ts) to txn, n_votes, commit, commit_ts: commit iff all prepared, at the largest timestamp."""
    prepared = F.col("state") == "Prepared"
    out = votes.groupBy("txn").agg(F.count("*").alias("n_votes"), F.bool_and(prepared).alias("commit"), F.max("ts").alias("commit_ts"))
    return out.withColumn("commit_ts", F.when(F.col("commit"), F.col("commit_ts")))


def read_timestamp(safe: DataFrame) -> DataFrame:
    """One row: the timestamp at which a read over several partitions takes place, the largest safe one."""
    return safe.agg(F.max("safe_ts").alias("read_ts"))


_STATE = "struct<state:string,ts:bigint,prepared:boolean,commit:boolean,commit_ts:bigint,released:boolean,out:array<struct<seq:bigint,command:string,state:string,error:string>>>"


def _failed(a: Column, x: Column) -> Column:
    """Error of a command ``x`` in the state ``a``, null if it is taken, the first time or again."""
    command, state = x["command"], a["state"]
    first = command.isin("Prepare", "Autocommit")
    principal = command.isin("StoreDecision", "MarkTimedout")
    again = (
        F.when(command == "Prepare", state.isin("Prepared", "Failed"))
        .when(command == "Autocommit", state.isin("Committed", "Failed"))
        .when(command == "Commit", state.isin("Committed", "Decided", "Prepared"))
        .when(command == "Abort", state.isin("Aborted", "Timedout", "Prepared"))
        .when(command == "StoreDecision", state.isin("Decided", "Timedout", "Prepared"))
        .when(command == "MarkTimedout", state.isin("Timedout", "Prepared"))
    )
    return (
        F.when(first & state.isNull(), F.lit(None).cast("string"))
        .when(state.isNull(), F.lit("NotFound"))
        .when(principal & ~x["principal"], F.lit("PermissionDenied"))
        .when(~first & ~a["prepared"], F.lit("NotFound"))
        .when(~F.coalesce(again, F.lit(False)), F.lit("FailedPrecondition"))
        .when((command == "StoreDecision") & (state == "Decided") & (x["commit"] != a["commit"]), F.lit("FailedPrecondition"))
        .when((command == "Commit") & (state == "Decided") & (x["ts"] != a["commit_ts"]), F.lit("InvalidRequest"))
        .when((command == "Commit") & (state == "Prepared") & (x["ts"] < a["ts"]), F.lit("InvalidRequest"))
        .when((command == "StoreDecision") & (state == "Prepared") & (x["commit_ts"] < a["ts"]), F.lit("InvalidRequest"))
    )


def _applied(a: Column, x: Column) -> Column:
    """The state after a command, with its result added to ``out``."""
    command, state, error = x["command"], a["state"], _failed(a, x)
    target = F.create_map(*[F.lit(v) for p in (("Prepare", "Prepared"), ("Autocommit", "Committed"), ("Commit", "Committed"), ("Abort", "Aborted"), ("StoreDecision", "Decided"), ("MarkTimedout", "Timedout")) for v in p])
    refused = state.isNull() & x["failure"].isNotNull()
    moves = error.isNull() & ~refused & (state.isNull() | ((state == "Prepared") & (command != "Prepare")) | ((state == "Decided") & (command == "Commit")))
    new = F.when(moves, target[command]).otherwise(state)
    result = F.struct(x["seq"].alias("seq"), command.alias("command"), F.when(error.isNull(), F.when(refused, F.lit("Failed")).otherwise(new)).alias("state"), error.alias("error"))
    decides = moves & (command == "StoreDecision")
    freed = moves & command.isin("Commit", "Abort", "Autocommit") | error.isNull() & (command == "MarkTimedout") & (state == "Timedout") & x["release"]
    return F.struct(
        new.alias("state"),
        F.when(moves, x["ts"]).otherwise(a["ts"]).alias("ts"),
        (a["prepared"] | (moves & (command == "Prepare"))).alias("prepared"),
        F.when(decides, x["commit"]).otherwise(a["commit"]).alias("commit"),
        F.when(decides, x["commit_ts"]).otherwise(a["commit_ts"]).alias("commit_ts"),
        (a["released"] | F.coalesce(freed, F.lit(False))).alias("released"),
        F.concat(a["out"], F.array(result)).alias("out"),
    ).cast(_STATE)


def apply_commands(commands: DataFrame) -> DataFrame:
    """Each transaction's commands, in ``seq`` order, through its state machine: txn, seq, command, state, error.

    Commands have txn, seq, command, ts, commit and commit_ts (of
    StoreDecision), release (of MarkTimedout: the second step, which releases
    locks), principal (whether this is the transaction's principal partition)
    and failure (why locks or checks refuse a Prepare or Autocommit; null if
    they do not).  A command that comes again returns the same state; one that
    the state forbids is an error and changes nothing; a refused one returns
    Failed, is not kept, and is decided anew when it comes again.
    """
    return _folded(commands).select("txn", F.explode("end.out").alias("r")).select("txn", "r.*")


def _folded(commands: DataFrame) -> DataFrame:
    row = F.struct("seq", "command", "ts", "commit", "commit_ts", "release", "principal", "failure")
    start = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("state", "string"), ("ts", "bigint"))], F.lit(False).alias("prepared"), F.lit(None).cast("boolean").alias("commit"), F.lit(None).cast("bigint").alias("commit_ts"), F.lit(False).alias("released"), F.array().alias("out")).cast(_STATE)
    return commands.groupBy("txn").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, _applied).alias("end"))


def final_status(commands: DataFrame) -> DataFrame:
    """txn, state, ts, commit, commit_ts, locks_released after all commands; transactions without a state are left out."""
    out = _folded(commands).select("txn", "end.state", "end.ts", "end.commit", "end.commit_ts", F.col("end.released").alias("locks_released"))
    return out.filter(F.col("state").isNotNull())


def saved(status: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A snapshot of transaction state: status as it is, prepared transactions (txn, locks_released) without their locks."""
    return status, prepared.drop("locks")


def restored(prepared: DataFrame, actions: DataFrame) -> DataFrame:
    """Locks of a snapshot's prepared transactions, built anew from their actions where they have not been released."""
    running = prepared.filter(~F.col("locks_released")).select("txn").distinct()
    return build_locks(actions.join(running, "txn", "left_semi"))


def collected(results: DataFrame) -> DataFrame:
    """Results of all partitions (txn, pid, action_id, code) as one row a transaction: n_actions, n_failed, codes in action order, errors.

    An action that several partitions report counts once, as its smallest code.
    """
    one = results.groupBy("txn", "action_id").agg(F.min("code").alias("code")).withColumn("error", error_of(F.col("code")))
    return one.groupBy("txn").agg(
        F.count("*").alias("n_actions"),
        F.count("error").alias("n_failed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("action_id", "code"))), lambda x: x["code"]), ",").alias("codes"),
        F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"),
    )


def apply_order(command: Column) -> Column:
    """Place of a command in its batch."""
    return F.array_position(F.array(*[F.lit(c) for c in APPLY_ORDER]), command)


def monotonic_max(batches: DataFrame) -> DataFrame:
    """The largest timestamp that any batch has seen; it never falls."""
    return batches.agg(F.max("max_timestamp").alias("max_timestamp"))


def collectable(status: DataFrame, now: int, keep_ns: int = 10_000_000_000) -> DataFrame:
    """Final transactions with released locks that are older than ``keep_ns``."""
    return status.filter(F.col("state").isin(*FINAL_STATES) & F.col("locks_released") & (F.col("ts") < now - keep_ns))


def watch(status: DataFrame, now: int, prepared_ns: int = 5_000_000_000, decided_ns: int = 2_000_000_000) -> DataFrame:
    """Running transactions in timestamp order with what a watchdog would do."""
    age = F.lit(now) - F.col("ts")
    todo = F.when((F.col("state") == "Prepared") & (age > prepared_ns), "abort").when((F.col("state") == "Decided") & (age > decided_ns), "finish").otherwise("wait")
    return status.filter(~F.col("state").isin(*FINAL_STATES)).withColumn("todo", todo).orderBy("ts", "txn")


def read_only_collectable(prepared: DataFrame, now: int, keep_ns: int = 5_000_000_000) -> DataFrame:
    """Read-only transactions (prepared_ts) that were prepared more than ``keep_ns`` ago."""
    return prepared.filter(F.col("prepared_ts") < now - keep_ns)


def meters(status: DataFrame, attempts: DataFrame | None = None, reads: DataFrame | None = None) -> DataFrame:
    """One row: tracked, running, timedout, locks_held; of attempts (code) locks_failed, validation_failed; of read-only ones prepared."""
    out = status.agg(
        F.count("*").alias("tracked"),
        F.count_if(~F.col("state").isin(*FINAL_STATES)).alias("running"),
        F.count_if(F.col("state") == "Timedout").alias("timedout"),
        F.count_if(~F.col("locks_released")).alias("locks_held"),
    )
    if attempts is not None:
        bad = attempts.agg(F.count_if(F.col("code") == "LockFailed").alias("locks_failed"), F.count_if(~F.col("code").isin("LockFailed", "Success")).alias("validation_failed"))
        out = out.join(bad)  # one row each
    return out if reads is None else out.join(reads.agg(F.count("*").alias("prepared_reads")))


def _batch_step(state: dict | None, row: tuple | None, last: bool) -> dict | list[tuple]:
    if state is None:
        return {"batch": -1, "n": BATCH_SIZE, "first": 0}
    partition, ts, seq = row
    if state["n"] >= BATCH_SIZE or ts - state["first"] >= BATCH_NS:
        state |= {"batch": state["batch"] + 1, "n": 0, "first": ts}
    state["n"] += 1
    return [(partition, seq, state["batch"])]


def batches(commands: DataFrame) -> DataFrame:
    """Commands (partition, seq, ts, command) with ``batch`` and ``apply``, their place in its order.

    A batch is closed by its BATCH_SIZE-th command or, whatever comes first,
    BATCH_NS after its first one.
    """
    kind = dict(commands.dtypes)["partition"]
    found = replayed(commands, "partition", ["ts", "seq"], ["partition", "ts", "seq"], f"partition {kind}, seq long, batch long", _batch_step)
    return commands.join(found, ["partition", "seq"]).withColumn("apply", apply_order(F.col("command")))


def stamped(commands: DataFrame) -> DataFrame:
    """Commands of batches (partition, batch, seq, command, ts) with ``stamp``: a Commit's own ts, else one after the other from the batch's first ts on."""
    place = F.array_position(F.array(*[F.lit(c) for c in STAMP_ORDER]), F.col("command"))
    own = Window.partitionBy("partition", "batch", F.col("command") == "Commit").orderBy(place, "seq")
    first = F.min("ts").over(Window.partitionBy("partition", "batch"))
    return commands.withColumn("stamp", F.when(F.col("command") == "Commit", F.col("ts")).otherwise(first + F.row_number().over(own)))
