"""Clock, keys, actions, locks, placement, history, store and streaming."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from varve import model
from varve.clock import LOGICAL_MASK, Clock, ClockError
from varve.functions import keys as K
from varve.functions import rules as R
from varve.operators import actions, admin, export, graph, history, locks, ordered, placement, txns
from varve.sources.files import Conflict
from varve.sources.store import Graph, KeyValue, MemoryStore, Partitions, VersionStore
from varve.streaming import ingest


def test_clock_is_monotonic_and_bounded():
    wall = [1 << 40]
    clock = Clock(lambda: wall[0])
    first = [clock.now() for _ in range(3)]
    assert first == sorted(set(first)) and first[1] & LOGICAL_MASK == 1
    assert clock.update(first[-1] + 100_000_000) > first[-1] + 100_000_000
    with pytest.raises(ClockError):
        clock.update(wall[0] + 2_000_000_000)
    wall[0] -= 5_000_000_000
    with pytest.raises(ClockError):
        clock.now()


def test_graph_keys_round_trip_order_and_corruption(spark):
    ids = [(t, v) for t in (1, 3, 2**31 + 1, 2**32 - 1) for v in (b"\0", b"abc", b"abcef", b"b")]
    df = spark.createDataFrame([(t, bytearray(v)) for t, v in ids], "type long, value binary").withColumn("key", K.vertex_key(F.col("type"), F.col("value")))
    back = df.select("type", "value", K.decode_vertex(F.col("key")).alias("v")).collect()
    assert all((r.v.type, r.v.value) == (r.type, r.value) for r in back)
    assert [(r.type, bytes(r.value)) for r in df.orderBy("key").collect()] == sorted(ids, key=lambda x: (x[0], len(x[1]), x[1]))
    assert df.limit(1).select(F.hex(K.vertex_key(F.lit(7), F.lit("abc")))).collect()[0][0] == "0000000700000003616263"
    good = bytes.fromhex("0000000700000003616263")
    bad = [good[:-1], good + b"x", good[:8], b"", good[:7] + b"\0" + good[8:], good[:7] + b"\xff" + good[8:]]
    rows = spark.createDataFrame([(bytearray(b),) for b in bad], "key binary").select(K.decode_vertex(F.col("key")).alias("v"))
    assert all(r.v is None for r in rows.collect())
    e = spark.createDataFrame([(bytearray(good),)], "h binary").withColumn("key", K.edge_key(F.col("h"), F.lit(9), F.col("h")))
    assert e.select(K.decode_edge(F.col("key")).alias("e")).collect()[0].e.type == 9
    cut = e.select(K.decode_edge(F.expr("substr(key, 1, octet_length(key) - 1)")).alias("e"))
    assert cut.collect()[0].e is None


def test_partition_ids_and_rules(spark):
    df = spark.createDataFrame([(f"k{i}",) for i in range(20)], "k string")
    assert [r.p for r in df.select(K.partition_id(F.col("k"), 7).alias("p")).collect()] == [xxhash.xxh64_intdigest(f"k{i}".encode()) % 7 for i in range(20)]
    assert K.byte_size("128MB") == 128 << 20 and K.byte_size("10b") == 10
    t = spark.createDataFrame([("a", 70000), ("", 80)], "name string, port int")
    found = R.violations(t, {"name": [R.required(F.col("name"))], "port": [R.port(F.col("port"))]}).collect()
    assert [r.errors for r in found] == [["port: not a port"], ["name: required"]]


def test_single_actions_equal_a_replay(spark):
    rng, rows, live, want = random.Random(3), [], set(), {}
    for ts in range(400):
        k, kind = rng.randrange(12), rng.choice(["Insert", "Update", "Upsert", "Delete", "Read"])
        rows.append((ts, 100, k, ts, kind, float(ts)))
        code = "KeyAlreadyExists" if kind == "Insert" and k in live else "KeyNotFound" if kind in ("Update", "Delete", "Read") and k not in live else "Success"
        want[ts] = code
        if kind in ("Insert", "Upsert"):
            live.add(k)
        elif kind == "Delete":
            live.discard(k)
    df = spark.createDataFrame(rows, "txn long, keyspace int, key long, commit_ts long, kind string, value double")
    done = actions.outcomes(df)
    assert {r.txn: r.code for r in done.collect()} == want
    assert {r.key for r in actions.written_versions(done).groupBy("key").agg(F.max_by("is_deleted", "commit_ts").alias("d")).filter("not d").collect()} == live


def test_fold_is_atomic_and_blind_to_own_writes(spark):
    rows = [(1, 10, 0, "Insert", "a"), (1, 10, 1, "Insert", "b"), (2, 20, 0, "Insert", "c"), (2, 20, 1, "Delete", "c"), (3, 30, 0, "Update", "a"), (3, 30, 1, "Insert", "b"), (4, 40, 0, "LockMustExist", "b"), (4, 40, 1, "Delete", "b"), (5, 50, 0, "Insert", "b")]
    df = spark.createDataFrame([(100, *r) for r in rows], "keyspace int, txn long, commit_ts long, action_id long, kind string, key string")
    got = {r.txn: (r.code, r.failed_action) for r in actions.fold(df).collect()}
    assert got == {1: ("Success", None), 2: ("KeyNotFound", 1), 3: ("KeyAlreadyExists", 1), 4: ("Success", None), 5: ("Success", None)}


def test_lock_conflicts_by_buckets_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), a := rng.randrange(300), a + rng.choice([1, 5, 90]), rng.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, keyspace int, lo long, hi long, exclusive boolean")
    want = {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[3] > y[2] and x[2] < y[3] and (x[4] or y[4])}
    for _ in range(1):
        assert {(r.requested_id, r.held_id) for r in locks.conflicts(df, df).collect()} == want


def test_state_machine(spark):
    """Sequences of commands on one transaction each, and what each gives: a state, or an error after a !."""
    c = lambda command, ts=10, **rest: (command, ts, rest)
    cases = [
        ([c("Prepare"), c("Prepare"), c("Commit", 12), c("Commit", 12), c("Abort")], "Prepared Prepared Committed Committed !FailedPrecondition"),
        ([c("Abort"), c("Commit"), c("StoreDecision"), c("MarkTimedout")], "!NotFound !NotFound !NotFound !NotFound"),
        ([c("Prepare"), c("Commit", 9), c("Abort"), c("Abort"), c("Prepare"), c("Commit")], "Prepared !InvalidRequest Aborted Aborted !FailedPrecondition !FailedPrecondition"),
        ([c("Prepare"), c("StoreDecision", commit_ts=9), c("StoreDecision", commit_ts=14), c("StoreDecision", commit_ts=14), c("StoreDecision", commit=False), c("Commit", 13), c("Abort"), c("Commit", 14)], "Prepared !InvalidRequest Decided Decided !FailedPrecondition !InvalidRequest !FailedPrecondition Committed"),
        ([c("Prepare"), c("MarkTimedout"), c("Abort"), c("StoreDecision"), c("MarkTimedout", release=True), c("Commit")], "Prepared Timedout Timedout Timedout Timedout !FailedPrecondition"),
        ([c("Prepare", failure="LockFailed"), c("Prepare"), c("Autocommit")], "Failed Prepared !FailedPrecondition"),
        ([c("Autocommit"), c("Autocommit"), c("Commit"), c("Prepare")], "Committed Committed !NotFound !FailedPrecondition"),
        ([c("Prepare"), c("MarkTimedout", principal=False), c("StoreDecision", principal=False)], "Prepared !PermissionDenied !PermissionDenied"),
    ]
    rows = [(t, n, k, ts, o.get("commit", True), o.get("commit_ts", ts), o.get("release", False), o.get("principal", True), o.get("failure")) for t, (own, _) in enumerate(cases) for n, (k, ts, o) in enumerate(own)]
    df = spark.createDataFrame(rows, "txn long, seq long, command string, ts long, commit boolean, commit_ts long, release boolean, principal boolean, failure string")
    got = {}
    for r in txns.apply_commands(df).orderBy("txn", "seq").collect():
        got.setdefault(r.txn, []).append(f"!{r.error}" if r.error else r.state)
    assert {t: " ".join(v) for t, v in got.items()} == {t: want for t, (_, want) in enumerate(cases)}
    end = {r.txn: (r.state, r.locks_released) for r in txns.final_status(df).collect()}
    assert end[4] == ("Timedout", True) and end[0] == ("Committed", True) and end[7] == ("Prepared", False) and 1 not in end


def test_fold_of_locks_over_many_batches(spark):
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng, rows, live, want = random.Random(8), [], {0: set(), 1: set()}, {}
    for t in range(200):
        space, acts = t % 2, []
        for a in range(rng.randrange(1, 4)):
            kind = rng.choice(["Insert", "Update", "Upsert", "Delete", "Read", "LockKey", "LockRange"])
            k = rng.randrange(8)
            check = rng.choice({"LockKey": ["MustExist", "MustNotExist", "None"], "LockRange": ["MustBeEmpty", "MustNotBeEmpty", "None"]}.get(kind, [None]))
            acts.append((space, t, t, a, kind, k, k + rng.randrange(3), check))
        rows += acts
        before, verdict = set(live[space]), ("Success", None)
        for _, _, _, a, kind, k, end, check in acts:
            there = k in before if kind != "LockRange" else any(k <= x < end for x in before)
            bad = "KeyAlreadyExists" if kind == "Insert" and there else "KeyNotFound" if kind in ("Update", "Delete") and not there else "LockCheckFailed" if check in ("MustExist", "MustNotBeEmpty") and not there or check in ("MustNotExist", "MustBeEmpty") and there else None
            if bad:
                verdict = (bad, a)
                break
        else:
            for _, _, _, _, kind, k, _, _ in acts:
                if kind == "Delete":
                    live[space].discard(k)
                elif kind in ("Insert", "Update", "Upsert"):
                    live[space].add(k)
        want[t] = verdict
    df = spark.createDataFrame(rows, "keyspace int, txn long, commit_ts long, action_id long, kind string, key long, end long, check string")
    assert {r.txn: (r.code, r.failed_action) for r in actions.fold(df).collect()} == want
    assert actions.fold(df.filter("false")).isEmpty()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)


def test_numbering_and_cuts(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(50), rng.random() < 0.3) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, x long, f boolean").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r.id: r.n for r in ordered.numbered(df, ["x", "id"]).collect()} == {r[0]: n for n, r in enumerate(order)}
    assert {r.id: r.n for r in ordered.numbered(df, ["x", "id"], "n", F.col("f")).collect()} == {r[0]: sum(q[2] for q in order[:n]) for n, r in enumerate(order)}
    at = ordered.cuts(df, "x")
    assert at == sorted(set(at)) and len(at) <= ordered.CUTS
    assert all(r.p == sum(c <= r.x for c in at) for r in df.select("x", ordered.range_of(F.col("x"), at).alias("p")).collect())


def test_rebalancing_keeps_its_invariants():
    rng = random.Random(171)
    for _ in range(60):
        servers = list(range(rng.randint(1, 20)))
        state = {p: [rng.choice(servers + [99]) for _ in range(rng.randint(0, 6))] for p in range(rng.randint(1, 40))}
        out = placement.rebalanced(state, servers, 3)
        load = [sum(s in own for own in out.values()) for s in servers]
        assert all(len(set(own)) == len(own) == min(3, len(servers)) for own in out.values())
        assert max(load) - min(load) <= 1


def test_cluster_steps_keep_their_invariants():
    """Random states of many sizes; every step obeys the caps, and steps end in a balanced state with all replicas."""
    for seed in (171, 97):
        rng = random.Random(seed)
        for _ in range(12):
            servers = list(range(rng.randint(1, 14)))
            parts = rng.randint(1, 25)
            state = {}
            for p in range(parts):
                for s in rng.sample(servers, rng.randint(0, min(6, len(servers)) - 1) if len(servers) > 1 else 0):
                    kind = rng.choices(["Leaving", "Joining", "NonVoter", "Voter"], [5, 15, 40, 40])[0]
                    state[p, s] = [kind, kind in ("Leaving", "Joining") and rng.random() < 0.5, rng.randrange(100)]
            cluster = placement.Cluster(state, servers, parts, min(3, len(servers)))
            for now in range(400):
                new = cluster.step(now)
                commands = cluster.commands(new)
                joining = [k for k, v in new.replicas.items() if v[0] == "Joining"]
                added = [c[1:3] for c in commands if c[0] == "Add"]
                if added:
                    assert len(joining) <= placement.CAPS[0]
                    assert all(sum(k[1] == s for k in joining) <= placement.CAPS[1] for _, s in added) and all(sum(k[0] == p for k in joining) <= 1 for p, _ in added)
                assert all(c[0] != "Remove" or cluster.replicas[c[1:3]][0] == "Leaving" for c in commands)
                assert all(c[0] != "Update" or c[3] in ("Voter", "Leaving") for c in commands)
                if not commands and all(v[1] or v[0] in placement.SERVING for v in new.replicas.values()):
                    break
                for v in new.replicas.values():
                    v[1] = v[0] in ("Joining", "Leaving")
                cluster = new
            assert not commands and cluster.imbalance() <= 1
            assert all(cluster._count(placement.SERVING, pid=p) == min(3, len(servers)) for p in range(parts))


def test_registration_bootstrap_and_snapshots(spark, tmp_path):
    hour = 3600 * 10**9
    asked = spark.createDataFrame([("t1", "data", 10), ("t2", "api", 5), ("t1", "data", 20), ("t1", "data", 10 + 49 * hour)], "token string, type string, ts long")
    got = sorted((r.token, r.id, r.name, r.expired) for r in admin.registered(asked, 2).collect())
    assert got == [("t1", 4, "data_4", False), ("t1", 4, "data_4", False), ("t1", 4, "data_4", True), ("t2", 3, "api_3", False)]
    none = spark.createDataFrame([], "name string, n_partitions int")
    first = admin.bootstrapped(spark, none, "a", 3, [(1, "control_1")])
    again = admin.bootstrapped(spark, first["cluster"], "b", 9, [(1, "control_1")])
    assert again["cluster"].collect()[0].name == "a" and again["partitions"].count() == 3
    admin.save(str(tmp_path / "s"), first)
    assert {k: v.collect() for k, v in admin.restore(spark, str(tmp_path / "s"), list(first)).items()} == {k: v.collect() for k, v in first.items()}
    assert admin.guarded({"servers": 3, "partitions": 5}, {"servers": 3, "partitions": 4, "cluster": 0}) == ["partitions"]


def test_histories_are_written_read_and_generated(spark, tmp_path):
    rows = [("ok", "txn", "1", 2, 5, [["w", "k", "AQ"]], 7, None, None), ("invoke", "txn", "1", 1, 4, [["r", "k", None]], None, "t", None), ("info", "txn", "2", 3, 6, None, None, None, "context")]
    df = spark.createDataFrame(rows, history.SCHEMA)
    history.write(df, str(tmp_path / "h"))
    assert sorted(history.read_lines(spark, str(tmp_path / "h")).collect(), key=str) == sorted(df.collect(), key=str)
    made = history.workload(spark, 300, 10, 3).collect()
    by = {}
    for r in sorted(made, key=lambda r: r.txn):
        assert (r.value is None) == (r.op == "r")
        if r.op == "w":
            assert r.value == by.get(r.key, 0) + 1
            by[r.key] = r.value
    sizes = [sum(x.txn == t for x in made) for t in range(300)]
    assert min(sizes) == 1 and max(sizes) == 8 and all(len({x.op for x in made if x.txn == t}) == 1 for t in range(300))


def test_anomalies_of_each_class(spark):
    schema = "txn long, op string, key string, value long, commit_ts long"
    spans = spark.createDataFrame([(t, 10 * t, 10 * t + 5) for t in range(9)], "txn long, began long, ended long")
    cases = {
        "": [(1, "w", "x", 1, 1), (2, "r", "x", 1, 2), (3, "w", "x", 2, 3), (3, "r", "y", None, 3)],
        "G1a": [(1, "w", "x", 1, 1), (2, "r", "x", 9, 2)],
        "G1c G2 G1c-realtime": [(1, "w", "x", 1, 1), (2, "w", "y", 1, 2), (1, "r", "y", 1, 1), (2, "r", "x", 1, 2)],
        "G2 G2-realtime": [(1, "w", "x", 1, 1), (1, "r", "y", None, 1), (2, "w", "y", 1, 2), (2, "r", "x", None, 2)],
        "G2-realtime": [(1, "w", "x", 1, 1), (3, "r", "x", None, 3)],
        "G1c-realtime": [(1, "r", "x", 1, 1), (4, "w", "x", 1, 4)],
    }
    failed = spark.createDataFrame([(8, "w", "x", 9, 0)], schema)
    for want, ops in cases.items():
        got = {r["class"] for r in history.anomalies(spark.createDataFrame(ops, schema), failed, spans).collect()}
        assert got == set(want.split()), want


def test_history_cycles(spark):
    chain = [(i, i + 1) for i in range(8)]
    assert history.cyclic(spark.createDataFrame(chain, "src long, dst long")).isEmpty()
    ring = [(20, 21), (21, 22), (22, 20), (22, 30)]
    assert {tuple(r) for r in history.cyclic(spark.createDataFrame(chain + ring, "src long, dst long")).select("src", "dst").collect()} == set(ring[:3])


def trimmed(edges):
    edges = set(edges)
    while True:
        starts, ends = {a for a, _ in edges}, {b for _, b in edges}
        left = {(a, b) for a, b in edges if a in ends and b in starts}
        if left == edges:
            return left
        edges = left


def test_cycles_of_long_chains_and_random_graphs(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000)]
    ring = [(2000 + i, 2000 + (i + 1) % 301) for i in range(301)]
    ways = [(1000, 2000), (2007, 3000), (2100, 4000), *((3000 + i, 3001 + i) for i in range(400)), *((4000 + i, 4001 + i) for i in range(300)), (4300, 4299)]
    acyclic = chain + [(9000 + i, 9000 + i + d) for i in range(8) for d in (1, 2)]
    mixed = ring + ways + [(-1, -1), (-1, -2)] + [(10000 * k + rng.randrange(30), 10000 * k + rng.randrange(30)) for k in range(1, 20) for _ in range(10 + 2 * k)]
    for g in (acyclic, chain + mixed, []):
        got = history.cyclic(spark.createDataFrame(g, "src long, dst long")).collect()
        assert sorted(tuple(r) for r in got) == sorted(trimmed(g))


def test_history_cycles_takes_every_key(spark, tmp_path):
    from datetime import datetime, timedelta

    from varve.plans import queries

    rng, start = random.Random(5), datetime(2024, 1, 1)
    keys = [0] * 400 + [7] * 150 + [9] * 2 + [11] + [12] * 30
    rng.shuffle(keys)
    rows = [(i, k, "view" if k == 12 and i % 2 else "click", start + timedelta(seconds=rng.randrange(300))) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    writes = [k for _, k, kind, _ in rows if kind != "view"]
    want = sum(n for n in map(writes.count, set(writes)) if n > 1)
    assert queries.history_cycles(spark, str(tmp_path)).collect()[0].n == want


def test_store_commits_atomically(spark, tmp_path):
    kv = KeyValue(VersionStore(spark, str(tmp_path / "log")))
    first = kv.set({b"a": b"1", b"b": b"2"})
    second = kv.set({b"a": b"3"})
    assert second > first
    assert [r.value for r in kv.get([b"b", b"zz", b"a"]).collect()] == [b"2", None, b"3"]
    assert [r.value for r in kv.get([b"a"], first).collect()] == [b"1"]
    with pytest.raises(model.NotFound):
        kv.delete([b"a", b"missing"])
    kv.delete([b"a"])
    assert kv.get([b"a"]).collect()[0].value is None
    with pytest.raises(model.AlreadyExists):
        kv.insert({b"b": b"x"})
    for bad in ([], [b""]):
        with pytest.raises(model.InvalidRequest):
            kv.get(bad)
    with pytest.raises(model.InvalidRequest):
        kv.set([(b"k", b"1"), (b"k", b"2")])
    (tmp_path / "log" / "data" / "99").mkdir()  # a commit that never got its number
    assert kv.get([b"b"]).collect()[0].value == b"2"


RECORD = "keyspace int, key binary, value binary, is_deleted boolean"


def test_racing_writers_get_distinct_numbers(spark, tmp_path, monkeypatch):
    one, two = (VersionStore(spark, str(tmp_path / "log")) for _ in range(2))
    row = lambda v: spark.createDataFrame([(100, bytearray(b"k"), bytearray(v), False)], RECORD)
    first, done, publish = one.append(row(b"0")), [], one.files.publish

    def other_first(name, value):
        if not done:
            done.append(two.append(row(b"2")))
        publish(name, value)

    monkeypatch.setattr(one.files, "publish", other_first)
    ts = one.append(row(b"1"))
    assert ts > done[0] > first and one.read().count() == 3
    done.clear()
    with pytest.raises(model.FailedPrecondition):
        one.append(row(b"3"), expected=ts)
    assert two.read().count() == 4 and len(list((tmp_path / "log" / "data").iterdir())) == 4
    with pytest.raises(Conflict):
        two.files.publish("log/000000000001.json", {})
    two.files.save("log/x.tmp", {})
    with pytest.raises(Exception, match="(?i)exist"):
        two.files.rename("log/x.tmp", "log/000000000001.json")


def test_compaction_keeps_what_snapshots_see(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("varve.sources.store.SUMMARY", 3)
    store = VersionStore(spark, str(tmp_path / "log"))
    kv, times = KeyValue(store), []
    for i in range(7):
        times.append(kv.set({b"a": b"%d" % i, b"b%d" % i: b"x"}))
    times.append(kv.delete([b"b3"]))
    assert [n for n in store.files.names("log") if n.endswith(".sum")] and store.last() == times[-1]
    old = kv.get([b"a"], times[2]).collect()[0].value
    assert store.compact(files=2) == 8 and len(store.head().folders) == 1 and store.clean() == 8
    assert kv.get([b"a"], times[2]).collect()[0].value == old and store.read().count() == 15
    assert store.compact(before=times[5]) == 1
    assert kv.get([b"a", b"b0", b"b3"], times[5]).select("value").collect()[0].value == b"5" and store.read().count() < 15
    times.append(kv.set({b"z": b"1"}))
    assert kv.get([b"z", b"b1"]).filter("value is not null").count() == 2 and VersionStore(spark, store.path).last() == times[-1]


def test_memory_store_and_partitions(spark, tmp_path):
    kv = KeyValue(MemoryStore(spark))
    kv.set({b"a": b"1"})
    ts = kv.store.last()
    same = spark.createDataFrame([(100, bytearray(b"a"), ts, bytearray(b"1"), False)], "keyspace int, key binary, commit_ts long, value binary, is_deleted boolean")
    kv.store.append(same)
    assert kv.store.read().count() == 1
    with pytest.raises(model.AlreadyExists):
        kv.store.append(same.withColumn("value", F.lit(bytearray(b"2"))))
    parts = Partitions(spark, str(tmp_path / "p"), 4)
    rows = spark.createDataFrame([(100, bytearray(b"k%d" % i), bytearray(b"v"), False) for i in range(40)], RECORD)
    done = parts.append(rows)
    assert parts.ids() == sorted(done) and parts.read().count() == 40
    where = {bytes(r.key): xxhash.xxh64_intdigest(bytes(r.key)) % 4 for r in rows.collect()}
    assert {bytes(r.key) for r in parts.read([2]).collect()} == {k for k, p in where.items() if p == 2}
    assert parts.create(2).last() == done[2] and parts.drop(2) and not parts.drop(2) and 2 not in parts.ids() and parts.sync(1) == 0
    with pytest.raises(model.InvalidRequest):
        parts.create(4)


def test_graph_interface(spark, tmp_path):
    g = Graph(VersionStore(spark, str(tmp_path / "g")))
    a, b = (1, b"a"), (1, b"b")
    g.create_vertex(a, b"A")
    first = g.create_vertex(b, b"B")
    with pytest.raises(model.AlreadyExists):
        g.create_vertex(a, b"x")
    g.create_edge(a, 7, b, b"E")
    seen = g.update_edge(a, 7, b, b"F")
    with pytest.raises(model.FailedPrecondition):
        g.delete_vertex(a)
    g.delete_vertex(b)  # only an edge that comes in
    g.update_vertex(a, b"A2")
    g.delete_edge(a, 7, b)
    g.delete_vertex(a)
    assert g.get_vertex(a) is None is g.get_vertex(b) is g.get_edge(a, 7, b) is g.get_edge(b, 7, a)
    assert g.get_vertex(a, first) == b"A" and g.get_edge(a, 7, b, seen) == b"F" and g.get_edge(a, 7, b, first) is None
    for bad in (lambda: g.update_vertex(a, b"x"), lambda: g.delete_edge(a, 7, b), lambda: g.delete_vertex(b)):
        with pytest.raises(model.NotFound):
            bad()
    for bad in ((0, b"a"), (1, b"")):
        with pytest.raises(model.InvalidRequest):
            g.get_vertex(bad)


def test_restore_goes_on_and_starts_anew(spark, tmp_path):
    log = spark.createDataFrame([(100, bytearray(b"k%03d" % (i % 40)), i, bytearray(b"v"), False) for i in range(95)], "keyspace int, key binary, commit_ts long, value binary, is_deleted boolean")
    rows, index = export.stream(log, 5, 5, 20)
    store = VersionStore(spark, str(tmp_path / "s"))
    part = ingest.Restore(store, 5)
    chunk = lambda k: rows.filter(F.col("chunk") == k).drop("chunk")
    assert part.take(chunk(0), 0, False) and part.take(chunk(1), 1, False) and not part.take(chunk(1), 1, False)
    with pytest.raises(model.FailedPrecondition):
        part.take(chunk(3), 3, False)
    assert ingest.Restore(store, 5).run(rows, index) == 3 and ingest.Restore(store, 5).run(rows, index) == 0
    key = ["keyspace", "key", "commit_ts", "value", "is_deleted"]
    assert store.read().select(*key).exceptAll(log.select(*key)).isEmpty() and store.read().count() == 95 and store.index() == 5
    newer = log.filter("commit_ts < 30")
    again = ingest.Restore(store, 6)
    assert again.progress() == (0, False, True) and again.run(*export.stream(newer, 6, 6, 20)) == 2
    assert store.read().count() == 30 and store.index() == 6
    with pytest.raises(model.FailedPrecondition):
        export.stream(log, 4, 5)
    with pytest.raises(model.InvalidRequest):
        export.stream(log, 5, 5, 20, (1, bytearray(b"a"), 0))


def test_retried_micro_batches_commit_once(spark, tmp_path):
    rows = spark.createDataFrame([(100, bytearray(b"a"), bytearray(b"1"), False)], RECORD)
    rows.write.parquet(str(tmp_path / "in"))
    store = VersionStore(spark, str(tmp_path / "log"))
    for checkpoint in ("one", "two"):  # a second run without the first one's progress tries batch 0 again
        ingest.sink(spark.readStream.schema(RECORD).parquet(str(tmp_path / "in")), store, str(tmp_path / checkpoint)).awaitTermination(120)
    assert store.read().count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, ts, rng.choice(["Insert", "Update", "Upsert", "Delete", "Read"])) for ts in range(200) for k in [rng.randrange(6)]]
    schema = "key long, commit_ts long, kind string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.resolve(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("resolved").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    batch = actions.outcomes(df.withColumn("keyspace", F.lit(1)).withColumn("txn", F.col("commit_ts")))
    assert {(r.commit_ts, r.code) for r in spark.table("resolved").collect()} == {(r.commit_ts, r.code) for r in batch.collect()}
