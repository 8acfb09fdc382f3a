"""Queries: each operator applied to a projection of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock, model
from ..functions import keys as K
from ..functions import rules as R
from ..operators import actions, admin, export, graph, history, locks, placement, txns, versions

SNAPSHOT = 1_705_000_000_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.events_as_versions(_table(spark, sf_dir, "events"))


def kv_snapshot_read(spark, sf_dir):
    return versions.snapshot(_versions(spark, sf_dir), SNAPSHOT).select("key", "commit_ts", "value")


def kv_latest(spark, sf_dir):
    return versions.snapshot(_versions(spark, sf_dir)).select("key", "commit_ts", "value")


def kv_multiget(spark, sf_dir):
    asked = _table(spark, sf_dir, "customer").select(F.lit(100).alias("keyspace"), F.col("c_custkey").alias("key"), F.col("c_custkey").alias("pos"))
    return versions.multi_get(_versions(spark, sf_dir), asked, SNAPSHOT).select("key", "value")


def kv_range_read_limit(spark, sf_dir):
    return versions.range_read(_versions(spark, sf_dir), 100, 10, 60, SNAPSHOT, 20).select("key", "commit_ts", "value")


def kv_exists(spark, sf_dir):
    asked = _table(spark, sf_dir, "customer").select(F.lit(100).alias("keyspace"), F.col("c_custkey").alias("key"))
    return versions.exists(_versions(spark, sf_dir), asked, SNAPSHOT).select("key", "found")


def kv_exists_in_range(spark, sf_dir):
    ranges = _table(spark, sf_dir, "nation").select(F.lit(100).alias("keyspace"), (F.col("n_nationkey") * 8).cast("bigint").alias("lo"), (F.col("n_nationkey") * 8 + 3).cast("bigint").alias("hi"))
    return versions.exists_in_range(_versions(spark, sf_dir), ranges, SNAPSHOT).select("lo", "hi", "found")


def kv_exact_version(spark, sf_dir):
    log = _versions(spark, sf_dir)
    asked = _table(spark, sf_dir, "events").select(F.lit(100).alias("keyspace"), F.col("user_id").alias("key"), (clock.nanos(F.col("ts")) + (F.col("event_id") % 2) * 1000).alias("commit_ts"))
    return versions.exact(log, asked).select("key", "commit_ts", "value")


def kv_all_versions(spark, sf_dir):
    return versions.all_versions(_versions(spark, sf_dir), 100, (20, SNAPSHOT), (40, SNAPSHOT)).select("key", "commit_ts", "value", "is_deleted")


def kv_asof_batch(spark, sf_dir):
    asked = _table(spark, sf_dir, "orders").select(F.lit(100).alias("keyspace"), (F.col("o_orderkey") % 200).alias("key"), (F.lit(1_704_067_200_000_000_000) + F.col("o_custkey") * 1_000_000_000_000).alias("as_of"))
    return versions.as_of(_versions(spark, sf_dir), asked).select("key", "as_of", "commit_ts", "value")


def kv_version_history(spark, sf_dir):
    return versions.validity(_versions(spark, sf_dir)).select("key", "valid_from", F.coalesce("valid_to", F.lit(0)).alias("valid_to"), "value", "is_deleted")


def kv_vacuum(spark, sf_dir):
    return versions.vacuum(_versions(spark, sf_dir), SNAPSHOT).select("key", "commit_ts", "value", "is_deleted")


def kv_action_outcome(spark, sf_dir):
    return actions.outcomes(model.events_as_actions(_table(spark, sf_dir, "events"))).select("txn", "key", "commit_ts", "kind", "code")


def kv_written_versions(spark, sf_dir):
    done = actions.outcomes(model.events_as_actions(_table(spark, sf_dir, "events")))
    return actions.written_versions(done).select("key", "commit_ts", "value", "is_deleted")


def _grouped_actions(spark, sf_dir):
    """Events of a user within three hours as one transaction over ten keys of the user's; some lock a key or a range instead."""
    acts = model.events_as_actions(_table(spark, sf_dir, "events"))
    span, id_ = 3 * 3600 * 1_000_000_000, F.col("txn")
    slot, letter = clock.whole(F.col("commit_ts"), span), lambda x: F.concat_ws("/", F.col("key"), F.char(F.lit(97) + x))
    kind = F.when(id_ % 11 == 0, "LockKey").when(id_ % 13 == 0, "LockRange").otherwise(F.col("kind"))
    checks = F.when(id_ % 11 == 0, F.array(F.lit("MustExist"), F.lit("MustNotExist"), F.lit("None"))).when(id_ % 13 == 0, F.array(F.lit("MustBeEmpty"), F.lit("MustNotBeEmpty"), F.lit("None")))
    return acts.select(
        F.concat_ws("-", F.col("key"), slot).alias("txn"),
        F.col("key").alias("owner"),
        letter(id_ % 10).alias("key"),
        letter(id_ % 10 + 3).alias("end"),
        (slot * span).alias("commit_ts"),
        F.col("txn").alias("action_id"),
        kind.alias("kind"),
        F.get(checks, (clock.whole(id_, 7) % 3).cast("int")).alias("check"),
    )


def txn_fold(spark, sf_dir):
    return actions.fold(_grouped_actions(spark, sf_dir), "owner")


def txn_validate(spark, sf_dir):
    """Three actions of an order, each looked up in the log just before the order's time."""
    orders, id_ = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    each = orders.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    kinds = F.array(*[F.lit(k) for k in ("Insert", "Update", "Upsert", "Delete", "LockKey", "LockRange", "Read")])
    checks = F.when(F.col("kind") == "LockKey", F.array(F.lit("MustExist"), F.lit("MustNotExist"), F.lit("None"))).when(F.col("kind") == "LockRange", F.array(F.lit("MustNotBeEmpty"), F.lit("MustBeEmpty"), F.lit("None")))
    acts = each.select(
        F.col("o_orderkey").alias("txn"),
        F.col("i").cast("bigint").alias("action_id"),
        F.lit(100).alias("keyspace"),
        F.get(kinds, ((id_ + F.col("i") * 3) % 7).cast("int")).alias("kind"),
        ((F.col("o_custkey") + F.col("i") * 17) % 200).alias("key"),
        ((F.col("o_custkey") + F.col("i") * 17) % 200 + F.col("o_orderkey") % 3).alias("end"),
        (F.lit(1_704_067_200_000_000_000) + F.col("o_custkey") * 1_000_000_000_000).alias("commit_ts"),
    )
    acts = acts.withColumn("check", F.get(checks, (F.col("txn") % 3).cast("int")))
    return actions.validated(acts, _versions(spark, sf_dir))


def _commands(spark, sf_dir):
    """Lines of an order as its transaction's commands: a first one that may start it, then any."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    lines = _table(spark, sf_dir, "lineitem").withColumn("seq", seq.cast("bigint"))
    first = F.when(F.col("l_suppkey") % 8 == 0, "Abort").when(F.col("l_suppkey") % 8 == 1, "Autocommit").otherwise("Prepare")
    later = F.get(F.array(*[F.lit(c) for c in ("Commit", "Abort", "StoreDecision", "MarkTimedout", "Prepare", "Commit", "MarkTimedout", "StoreDecision")]), (F.col("l_partkey") % 8).cast("int"))
    return lines.select(
        F.col("l_orderkey").alias("txn"),
        "seq",
        F.when(F.col("seq") == 1, first).otherwise(later).alias("command"),
        (F.col("l_suppkey") + F.col("seq") * 4).alias("ts"),
        (F.col("l_linenumber") % 3 != 0).alias("commit"),
        (F.col("l_suppkey") + F.col("seq") * 4).alias("commit_ts"),
        (F.col("l_linenumber") % 2 == 0).alias("release"),
        (F.col("l_orderkey") % 5 != 0).alias("principal"),
        F.when(F.col("l_partkey") % 9 == 0, "LockFailed").alias("failure"),
    )


def txn_apply(spark, sf_dir):
    return txns.apply_commands(_commands(spark, sf_dir))


def txn_final_status(spark, sf_dir):
    return txns.final_status(_commands(spark, sf_dir)).select("txn", "state", "ts", "locks_released")


def txn_route(spark, sf_dir):
    acts = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("txn"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("key"))
    return txns.routed(acts, 16).select("txn", "pos", "pid", F.col("action_id").cast("bigint").alias("action_id"), "principal", "participants")


def txn_results(spark, sf_dir):
    done = actions.outcomes(model.events_as_actions(_table(spark, sf_dir, "events")))
    one = done.select(F.col("key").alias("txn"), (F.col("txn") % 4).alias("pid"), F.col("txn").alias("action_id"), "code")
    return txns.collected(one.unionByName(one.withColumn("pid", F.col("pid") + 1)))


def _arrivals(spark, sf_dir):
    commands = F.array(*[F.lit(c) for c in txns.APPLY_ORDER])
    ev = _table(spark, sf_dir, "events")
    return ev.select((F.col("user_id") % 16).alias("partition"), F.col("event_id").alias("seq"), clock.whole(clock.nanos(F.col("ts")), 1_000_000).alias("ts"), F.get(commands, (F.col("event_id") % 6).cast("int")).alias("command"))


def txn_batches(spark, sf_dir):
    return txns.batches(_arrivals(spark, sf_dir))


def txn_stamp(spark, sf_dir):
    return txns.stamped(txns.batches(_arrivals(spark, sf_dir))).select("partition", "seq", "stamp")


def txn_max_timestamp(spark, sf_dir):
    return txns.monotonic_max(_arrivals(spark, sf_dir).select(F.col("ts").alias("max_timestamp")))


def txn_read_only_collectable(spark, sf_dir):
    reads = _table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").alias("txn"), clock.nanos(F.col("ts")).alias("prepared_ts"))
    return txns.read_only_collectable(reads, SNAPSHOT)


def _locking_actions(spark, sf_dir):
    acts = _grouped_actions(spark, sf_dir)
    return acts.withColumn("keyspace", F.lit(100)).withColumn("exclusive", F.when(F.col("kind").isin("LockKey", "LockRange"), F.col("action_id") % 2 == 0))


def kv_locks(spark, sf_dir):
    return locks.build_locks(_locking_actions(spark, sf_dir)).select("txn", "action_id", "lo", F.replace("hi", F.lit("\0"), F.lit("+")).alias("hi"), "exclusive")


def txn_restore(spark, sf_dir):
    acts = _locking_actions(spark, sf_dir)
    prepared = acts.groupBy("txn").agg((F.min("action_id") % 3 == 0).alias("locks_released"), F.lit(1).alias("locks"))
    _, kept = txns.saved(prepared, prepared)
    return txns.restored(kept, acts).groupBy("txn").agg(F.count("*").alias("n_locks"), F.count_if("exclusive").alias("n_exclusive"))


def kv_binary_lock_conflicts(spark, sf_dir):
    """Key and range locks over binary keys: an owner's actions against those of the owner before, whose keys they share."""
    mine = locks.build_locks(_locking_actions(spark, sf_dir).withColumn("key", F.substring_index("key", "/", -1).cast("binary")).withColumn("end", F.substring_index("end", "/", -1).cast("binary")))
    mine = mine.withColumn("keyspace", F.floor(F.substring_index("txn", "-", 1).cast("bigint") / 2)).withColumn("id", F.col("action_id"))
    return locks.conflicts(mine.filter("action_id % 2 = 0"), mine.filter("action_id % 2 = 1"))


def kv_held_locks(spark, sf_dir):
    acts = _locking_actions(spark, sf_dir)
    prepared = acts.groupBy("txn").agg((F.min("action_id") % 3 == 0).alias("locks_released"))
    return locks.held(locks.build_locks(acts), prepared).agg(F.count("*").alias("locks_held"))


def kv_admission(spark, sf_dir):
    safe = kv_safe_timestamp(spark, sf_dir)
    asked = safe.withColumn("ts", F.lit(SNAPSHOT) + F.col("id") * 20_000_000_000_000)
    return asked.select("id", locks.admitted(F.col("ts"), F.col("safe_ts"), F.col("id") % 2 == 0, F.col("id") % 3 == 0).alias("admission"))


def kv_action_errors(spark, sf_dir):
    done = actions.outcomes(model.events_as_actions(_table(spark, sf_dir, "events")))
    read = model.decoded(F.col("code"), F.col("value"))
    return done.select("txn", model.error_of(F.col("code")).alias("error_code"), read["value"].alias("value"), read["error"].alias("read_error"))


def kv_range_read_corrupt(spark, sf_dir):
    """A range read that leaves out the values that its check finds corrupt, bounded by the engine's cap."""
    return versions.range_read(_versions(spark, sf_dir), 100, 10, 10_000_000, SNAPSHOT, 0, versions.MOST_RESULTS, F.col("value") < 20).select("key", "commit_ts", "value")


def kv_lock_conflicts(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_suppkey").cast("int").alias("keyspace"),
        F.col("l_partkey").alias("lo"),
        (F.col("l_partkey") + 5).alias("hi"),
        (F.col("l_linestatus") == "O").alias("exclusive"),
    ).distinct()
    return locks.conflicts(rows, rows).filter("requested_id < held_id")


def kv_safe_timestamp(spark, sf_dir):
    votes = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit(100).alias("keyspace"), F.col("user_id").alias("lo"), (F.col("user_id") + 1).alias("hi"), (F.col("event_type") != "view").alias("exclusive"), clock.nanos(F.col("ts")).alias("ts"))
    asked = votes.select(F.col("lo").alias("id"), "keyspace", "lo", "hi").distinct().withColumn("exclusive", F.lit(False))
    return locks.safe_timestamps(asked, votes.filter(F.col("ts") > SNAPSHOT), 1_800_000_000_000_000_000)


def _votes(spark, sf_dir):
    state = F.when(F.col("l_returnflag") != "R", "Prepared").otherwise("Aborted")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn"), state.alias("state"), F.col("l_partkey").alias("ts"))


def txn_decide(spark, sf_dir):
    return txns.decide(_votes(spark, sf_dir))


def txn_read_only(spark, sf_dir):
    acts = model.events_as_actions(_table(spark, sf_dir, "events")).withColumn("txn", F.col("key"))
    return actions.read_only(acts)


def _status(spark, sf_dir):
    states = F.create_map(*[F.lit(x) for p in (("F", "Committed"), ("O", "Prepared"), ("P", "Timedout")) for x in p])
    state = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 == 0), "Decided").otherwise(states[F.col("o_orderstatus")])
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn"), state.alias("state"), (F.col("o_custkey") % 2 == 0).alias("locks_released"), clock.nanos(F.col("o_orderdate")).alias("ts"))


def txn_status_counts(spark, sf_dir):
    attempts = _commands(spark, sf_dir).select(F.coalesce("failure", F.when(F.col("seq") == 2, "KeyNotFound"), F.lit("Success")).alias("code"))
    reads = _table(spark, sf_dir, "events").filter("event_type = 'view'")
    return txns.meters(_status(spark, sf_dir), attempts, reads)


def txn_watch(spark, sf_dir):
    return txns.watch(_status(spark, sf_dir), 820_454_400_000_000_000)


def txn_collectable(spark, sf_dir):
    return txns.collectable(_status(spark, sf_dir), 820_454_400_000_000_000).select("txn", "state", "ts")


def txn_read_timestamp(spark, sf_dir):
    return txns.read_timestamp(kv_safe_timestamp(spark, sf_dir))


def hlc_split(spark, sf_dir):
    ts = clock.nanos(F.col("ts"))
    return _table(spark, sf_dir, "events").select("event_id", ts.alias("hlc"), clock.physical(ts).alias("physical"), clock.logical(ts).alias("logical"))


def _vertices(spark, sf_dir):
    kinds = (("customer", "c_custkey", 1), ("supplier", "s_suppkey", 2), ("part", "p_partkey", 3), ("orders", "o_orderkey", 4))
    out = None
    for table, key, kind in kinds:
        rows = _table(spark, sf_dir, table).select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return graph.keyed_vertices(out)


def _edges(spark, sf_dir):
    ids = ("head_type", "head_value", "type", "tail_type", "tail_value")
    placed = _table(spark, sf_dir, "orders").select(F.lit(1), F.col("o_custkey").cast("string"), F.lit(1), F.lit(4), F.col("o_orderkey").cast("string")).toDF(*ids)
    lines = _table(spark, sf_dir, "lineitem").select(F.lit(4), F.col("l_orderkey").cast("string"), F.lit(2), F.lit(3), F.col("l_partkey").cast("string")).toDF(*ids)
    return graph.keyed_edges(placed.unionByName(lines).distinct())


def graph_vertex_keys(spark, sf_dir):
    return _vertices(spark, sf_dir).select("type", "value", F.hex("key").alias("key_hex"))


def graph_vertex_decode(spark, sf_dir):
    v = _vertices(spark, sf_dir).select(K.decode_vertex(F.col("key")).alias("v"))
    return v.select("v.type", F.col("v.value").cast("string").alias("value"))


def graph_edge_keys(spark, sf_dir):
    e = _edges(spark, sf_dir).select(F.hex("key").alias("key_hex"), K.decode_edge(F.col("key")).alias("e"))
    return e.select("key_hex", F.col("e.head.value").cast("string").alias("head"), "e.type", F.col("e.tail.value").cast("string").alias("tail"))


def _vertex_log(spark, sf_dir):
    """Customers created one after the other; every 7th is deleted later, and every 21st comes back."""
    id_ = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(K.vertex_key(F.lit(1), id_.cast("string")).alias("key"), id_.alias("id"), F.col("c_name").alias("payload"))
    made = rows.select("key", "id", (F.col("id") + 1000).alias("commit_ts"), "payload", F.lit(False).alias("is_deleted"))
    gone = rows.filter("id % 7 = 0").select("key", "id", F.lit(500_000).cast("bigint").alias("commit_ts"), F.lit(None).cast("string").alias("payload"), F.lit(True).alias("is_deleted"))
    back = rows.filter("id % 21 = 0").select("key", "id", F.lit(600_000).cast("bigint").alias("commit_ts"), F.concat("payload", F.lit("*")).alias("payload"), F.lit(False).alias("is_deleted"))
    return made.unionByName(gone).unionByName(back)


def _edge_log(spark, sf_dir):
    """Edges from customers to their orders; every third is deleted later."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("head"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("payload"))
    head = K.vertex_key(F.lit(1), F.col("head").cast("string"))
    rows = rows.select(K.edge_key(head, F.lit(1), K.vertex_key(F.lit(4), F.col("id").cast("string"))).alias("key"), head.alias("head_key"), "id", "payload")
    made = rows.withColumns({"commit_ts": F.col("id") + 2000, "is_deleted": F.lit(False)})
    gone = rows.filter("id % 3 = 0").withColumns({"payload": F.lit(None).cast("string"), "commit_ts": F.lit(500_000).cast("bigint"), "is_deleted": F.lit(True)})
    return made.unionByName(gone)


def graph_get_vertex(spark, sf_dir):
    """Users' vertices as of three times, one before the deletions, one between them and the returns, one at the end."""
    asked = _table(spark, sf_dir, "events").select(K.vertex_key(F.lit(1), F.col("user_id").cast("string")).alias("key")).distinct()
    log, out = _vertex_log(spark, sf_dir), None
    for ts in (400_000, 550_000, 650_000):
        own = graph.get(log, asked, ts).select(F.lit(ts).alias("snapshot"), "id", "payload")
        out = own if out is None else out.unionByName(own)
    return out


def graph_get_edge(spark, sf_dir):
    """Edges of users' orders as of two times, before and after the deletions."""
    log = _edge_log(spark, sf_dir)
    users = _table(spark, sf_dir, "events").select(K.vertex_key(F.lit(1), F.col("user_id").cast("string")).alias("head_key"))
    asked, out = graph.out_edges(log, users).select("key"), None
    for ts in (400_000, 550_000):
        own = graph.get(log, asked, ts).select(F.lit(ts).alias("snapshot"), "id", "payload")
        out = own if out is None else out.unionByName(own)
    return out


def _vertex_requests(spark, sf_dir, commit_ts):
    """A request for every second customer and as many that are not there; every tenth stands twice."""
    ids = _table(spark, sf_dir, "customer").select(F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array("c_custkey")).otherwise(F.array(F.col("c_custkey") + 1_000_000))).alias("id"))
    ids = ids.select("id", F.explode(F.when(F.col("id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("pos"))
    return ids.select("id", "pos", K.vertex_key(F.lit(1), F.col("id").cast("string")).alias("key"), F.lit(commit_ts).cast("bigint").alias("commit_ts"), F.concat(F.lit("new "), F.col("id").cast("string")).alias("payload"))


def graph_create_vertex(spark, sf_dir):
    return graph.created(_vertex_log(spark, sf_dir), _vertex_requests(spark, sf_dir, 550_000)).select("id", "pos", "code")


def graph_update_vertex(spark, sf_dir):
    """The versions that the successful updates append."""
    done = graph.updated(_vertex_log(spark, sf_dir), _vertex_requests(spark, sf_dir, 550_000))
    return graph.written_versions(done).select(F.hex("key").alias("key_hex"), "commit_ts", "payload", "is_deleted")


def graph_delete_vertex(spark, sf_dir):
    """Deletions after those of the edges: customers with an order that is left stay."""
    return graph.deleted_vertices(_vertex_log(spark, sf_dir), _edge_log(spark, sf_dir), _vertex_requests(spark, sf_dir, 550_000).drop("payload")).select("id", "pos", "code")


def _edge_requests(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("head"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 4 == 0, 1_000_000).otherwise(0)).cast("bigint").alias("id"))
    key = K.edge_key(K.vertex_key(F.lit(1), F.col("head").cast("string")), F.lit(1), K.vertex_key(F.lit(4), F.col("id").cast("string")))
    return rows.select("id", F.lit(0).alias("pos"), key.alias("key"), F.lit(550_000).cast("bigint").alias("commit_ts"), F.lit("new").alias("payload"))


def graph_create_edge(spark, sf_dir):
    return graph.created(_edge_log(spark, sf_dir).select("key", "commit_ts", "payload", "is_deleted"), _edge_requests(spark, sf_dir)).select("id", "code")


def graph_update_edge(spark, sf_dir):
    return graph.updated(_edge_log(spark, sf_dir).select("key", "commit_ts", "payload", "is_deleted"), _edge_requests(spark, sf_dir)).select("id", "code")


def graph_delete_edge(spark, sf_dir):
    """The tombstones that the successful deletions append."""
    done = graph.deleted(_edge_log(spark, sf_dir).select("key", "commit_ts", "payload", "is_deleted"), _edge_requests(spark, sf_dir).drop("payload"))
    return graph.written_versions(done).select(F.hex("key").alias("key_hex"), "commit_ts", "is_deleted")


def graph_undirected(spark, sf_dir):
    placed = _edges(spark, sf_dir).filter("head_type = 1").select("head_type", "head_value", "type", "tail_type", "tail_value")
    return graph.undirected(placed)


def graph_value_errors(spark, sf_dir):
    """Graph values of every event: a known arm or not, with a payload or without."""
    arm = F.create_map(*[F.lit(x) for p in (("signup", "int64"), ("click", "string"), ("purchase", "float64"), ("error", "int8")) for x in p])
    payload = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return _table(spark, sf_dir, "events").select("event_id", model.value_error(F.try_element_at(arm, F.col("event_type")), payload).alias("error"))


def graph_out_edges(spark, sf_dir):
    heads = _table(spark, sf_dir, "events").select(K.vertex_key(F.lit(1), F.col("user_id").cast("string")).alias("head_key"))
    return graph.out_edges(_edges(spark, sf_dir), heads).select("head_type", "head_value", "type", "tail_type", "tail_value")


def graph_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir)).select(F.hex("head_key").alias("head_hex"), "type", "n_edges")


def graph_delete_precheck(spark, sf_dir):
    return graph.deletable_vertices(_vertices(spark, sf_dir).filter("type = 4"), _edges(spark, sf_dir)).select("type", "value")


def placement_deal(spark, sf_dir):
    return placement.deal(spark, 100, 7, 3)


def _replicas(spark, sf_dir):
    states = F.create_map(*[F.lit(x) for p in ((0, "Voter"), (1, "NonVoter"), (2, "Joining"), (3, "Leaving"), (4, "Voter")) for x in p])
    return _table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("pid"),
        F.col("o_orderkey").alias("replica"),
        (F.col("o_orderkey") % 9).alias("server"),
        states[(F.col("o_orderkey") % 5).cast("int")].alias("state"),
        F.concat(F.lit("r"), F.col("o_orderkey")).alias("name"),
        F.concat(F.lit("r"), F.col("o_orderkey")).alias("leader"),
        F.col("o_orderkey").alias("term"),
        F.col("o_custkey").alias("applied"),
        (F.col("o_custkey") + F.col("o_orderkey") % 7).alias("committed"),
        clock.nanos(F.col("o_orderdate")).alias("created"),
    )


def placement_imbalance(spark, sf_dir):
    return placement.max_imbalance(_replicas(spark, sf_dir), spark.range(10).withColumnRenamed("id", "server"))


def placement_violations(spark, sf_dir):
    return placement.violations(_replicas(spark, sf_dir), spark.range(60).withColumnRenamed("id", "pid"))


def placement_changes(spark, sf_dir):
    rows = _replicas(spark, sf_dir)
    moved = rows.filter("replica % 3 != 0").withColumn("server", F.when(F.col("replica") % 4 == 0, F.col("server") + 1).otherwise(F.col("server")))
    return placement.state_changes(rows.filter("replica % 3 != 1"), moved).select("pid", "replica", "command", "server")


def _placed(spark, sf_dir):
    """Up to five replicas of each supplier's partition on 13 servers."""
    each = _table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 5).cast("int"))).alias("i"))
    states = F.array(*[F.lit(x) for x in ("Voter", "NonVoter", "Voter", "Joining", "Voter", "Leaving")])
    key, i = F.col("s_suppkey"), F.col("i")
    return each.select(key.alias("pid"), ((key * 7 + i * 3) % 13).alias("server"), F.get(states, ((key + i * 2) % 6).cast("int")).alias("state"), ((key + i) % 2 == 0).alias("ready"), (key * 10 + (i * 3) % 5).alias("created"))


def _servers(spark):
    return spark.range(14).withColumnRenamed("id", "server")


def _pids(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"))


def placement_settle(spark, sf_dir):
    return placement.settled(_placed(spark, sf_dir)).select("pid", "server", "state")


def placement_addable(spark, sf_dir):
    return placement.addable(_placed(spark, sf_dir), _pids(spark, sf_dir), _servers(spark), (1_000_000, 4, 1))


def placement_missing(spark, sf_dir):
    return placement.missing(_placed(spark, sf_dir), _pids(spark, sf_dir), _servers(spark), 3, (1_000_000, 1_000_000, 2))


def placement_extra(spark, sf_dir):
    return placement.extra(_placed(spark, sf_dir), 2)


def placement_command_errors(spark, sf_dir):
    """Commands for every supplier's partition, valid and not."""
    each = _table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    key, i = F.col("s_suppkey"), F.col("i")
    commands, states = F.array(*[F.lit(c) for c in ("Add", "Update", "Remove")]), F.array(*[F.lit(x) for x in ("Voter", "NonVoter", "Leaving", "Joining")])
    asked = each.select(F.get(commands, ((key + i) % 3).cast("int")).alias("command"), (key + F.when(i == 5, 1000).otherwise(0)).alias("pid"), ((key * 7 + i * 3) % 15).alias("server"), F.get(states, ((key + i) % 4).cast("int")).alias("state"))
    return placement.command_errors(asked, _placed(spark, sf_dir), 1000, _servers(spark))


def placement_transitions(spark, sf_dir):
    """All pairs of states, none included: which a replica may go through, and what its process becomes."""
    states = spark.createDataFrame([(s,) for s in ("Stopped", "Joining", "Voter", "NonVoter", "Leaving")], "state string")
    before = states.select(F.when(F.col("state") != "Stopped", F.col("state")).alias("before"), F.col("state").alias("process"))
    pairs = before.join(states.withColumnRenamed("state", "after"))
    b, a = F.col("before"), F.col("after")
    return pairs.select(F.col("process").alias("before"), "after", placement.valid_transition(b, a).alias("valid"), placement.lifecycle(F.col("process"), a).alias("becomes"))


def placement_availability(spark, sf_dir):
    probes = _table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("reachable"), (F.col("event_type") != "view").alias("connected"))
    return placement.availability(probes).select("ready", "failing")


def admin_cluster(spark, sf_dir):
    """Properties of the cluster, one a row."""
    one = _table(spark, sf_dir, "supplier").agg(F.count("*").alias("servers"), F.max("s_suppkey").alias("last_id")).withColumn("name", F.lit("main"))
    return admin.cluster(one)


def admin_replica_status(spark, sf_dir):
    """The last report of each partition's server."""
    reports = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("pid"), (F.col("o_orderkey") % 9).alias("name"), (F.col("o_orderkey") * 10).alias("ts"), F.col("o_custkey").alias("applied"))
    return admin.merged_status(reports)


def admin_register(spark, sf_dir):
    """Events as registrations whose token is the user: the first one counts, and a token holds for 48 hours."""
    asked = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("token"), F.lit("data").alias("type"), clock.nanos(F.col("ts")).alias("ts"))
    return admin.registered(asked, 5)


def admin_bootstrap(spark, sf_dir):
    """Partitions of a cluster that is set up for the first time, and of one that is there already."""
    none = spark.createDataFrame([], "name string, n_partitions int")
    there = _table(spark, sf_dir, "supplier").agg(F.lit("old").alias("name"), F.count("*").cast("int").alias("n_partitions"))
    out = None
    for present in (none, there):
        tables = admin.bootstrapped(spark, present, "new", 7, [(1, "control_1")])
        own = tables["cluster"].select("name").join(tables["partitions"])
        out = own if out is None else out.unionByName(own)
    return out


def admin_snapshot(spark, sf_dir):
    """The replicas, saved and restored."""
    from ..sources.shared import fresh_path

    path = fresh_path(spark)
    admin.save(path, {"replicas": _placed(spark, sf_dir), "servers": _servers(spark)})
    return admin.restore(spark, path, ["replicas", "servers"])["replicas"]


def admin_clock_skew(spark, sf_dir):
    ts = clock.nanos(F.col("ts"))
    readings = _table(spark, sf_dir, "events").select(clock.offset(ts, ts + F.col("event_id") * 1001, ts + F.col("user_id") * 13).alias("offset"))
    return admin.clock_skew(readings)


def rules_violations(spark, sf_dir):
    """Parts that break a rule, and which."""
    rules = {
        "size": [R.at_least(F.col("p_size"), 5), R.at_most(F.col("p_size"), 45)],
        "name": [R.required(F.col("p_name")), R.length_between(F.col("p_name"), 8, 9)],
        "price": [R.positive(F.col("p_retailprice") - 1000)],
        "port": [R.port(F.col("p_partkey") * 50)],
        "words": [R.items_between(F.split("p_type", " "), 1, 1), R.item_length_between(F.split("p_type", " "), 3, 6)],
        "brand": [R.one_of(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"])],
    }
    return R.violations(_table(spark, sf_dir, "part"), rules).select("p_partkey", F.array_join("errors", ";").alias("errors"))


def export_chunks(spark, sf_dir):
    out = export.chunks(_versions(spark, sf_dir), 1000)
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def export_stream(spark, sf_dir):
    return export.stream(_versions(spark, sf_dir), 7, 7, 1000)[1]


def export_stream_full(spark, sf_dir):
    """Chunks of which the last is full, so that an empty one completes the export."""
    return export.stream(_versions(spark, sf_dir), 7, 7, 500)[1]


def export_resume(spark, sf_dir):
    return export.address_range(_versions(spark, sf_dir), (100, 75, SNAPSHOT)).select("key", "commit_ts", "value")


def admin_partitions(spark, sf_dir):
    return admin.partitions(_replicas(spark, sf_dir))


def admin_replicas(spark, sf_dir):
    return admin.replicas(_replicas(spark, sf_dir)).select("pid", "name", "state", "is_leader", "lag")


def admin_servers(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").select(F.lit("data").alias("type"), F.col("s_suppkey").alias("id"), (F.col("s_nationkey").cast("bigint") * 1_000_000_000).alias("last_seen"))
    return admin.servers(rows, 20_000_000_000)


def admin_routing(spark, sf_dir):
    return admin.routing(_replicas(spark, sf_dir)).select("pid", F.array_join("servers", ",").alias("servers"))


def _ops(spark, sf_dir):
    """Events as operations: views read a version, the newest before them, the one before that, none, or the next one, by turns; all others write."""
    from pyspark.sql import Window

    ev = _table(spark, sf_dir, "events").select(F.col("event_id").alias("txn"), F.when(F.col("event_type") == "view", "r").otherwise("w").alias("op"), F.col("user_id").alias("key"), clock.nanos(F.col("ts")).alias("commit_ts"))
    order = Window.partitionBy("key").orderBy("commit_ts", "txn")
    write = F.when(F.col("op") == "w", F.col("txn"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    seen = ev.withColumn("last", F.last(write, True).over(before))
    older = F.last(F.when(F.col("op") == "w", F.col("last")), True).over(before)
    turn = F.col("txn") % 4
    value = F.when(F.col("op") == "w", F.col("txn")).when(turn == 0, F.col("last")).when(turn == 1, older).when(turn == 3, F.first(write, True).over(after))
    return seen.select("txn", "op", "key", value.alias("value"), "commit_ts")


def history_stale_reads(spark, sf_dir):
    return history.stale_reads(_ops(spark, sf_dir)).select("txn", "key", "value", "expected")


def history_dependencies(spark, sf_dir):
    return history.dependencies(_ops(spark, sf_dir)).select("src", "dst", "kind")


def history_realtime(spark, sf_dir):
    """Dependencies against real time; an operation takes up to four hours."""
    ops = _ops(spark, sf_dir)
    spans = ops.select("txn", F.col("commit_ts").alias("began"), (F.col("commit_ts") + F.col("txn") % 5 * 3_600_000_000_000).alias("ended"))
    return history.realtime_anomalies(history.dependencies(ops), spans)


def history_aborted_reads(spark, sf_dir):
    """Reads of versions whose writer, every fifth one, failed."""
    ops = _ops(spark, sf_dir)
    return history.aborted_reads(ops, ops.filter("op = 'w' and txn % 5 = 0")).select("txn", "key", "value")


def history_outcomes(spark, sf_dir):
    errors = F.create_map(*[F.lit(x) for p in (("error", "Internal error"), ("view", "context canceled"), ("click", "not found")) for x in p])
    return _table(spark, sf_dir, "events").select("event_id", history.outcome(F.try_element_at(errors, F.col("event_type"))).alias("outcome"))


def history_cycles(spark, sf_dir):
    """ww chains are acyclic; one edge back from the last to the first write of a key makes a cycle of each."""
    writes = _ops(spark, sf_dir).filter("op = 'w'")
    chain = history.dependencies(writes).select("src", "dst")
    at = F.struct("commit_ts", "txn")
    back = writes.groupBy("key").agg(F.max_by("txn", at).alias("src"), F.min_by("txn", at).alias("dst")).filter("src != dst").select("src", "dst")
    return history.cyclic(chain.unionByName(back)).agg(F.count("*").alias("n"))


def partition_ids(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", K.partition_id(F.col("user_id").cast("string"), 16).alias("pid"))


def etags(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    return rows.select("n_regionkey", K.etag(F.col("names")).alias("etag"))
