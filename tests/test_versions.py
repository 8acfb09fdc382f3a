"""Point, range and history reads over a log of three keyspaces with tombstones."""

import random

import pytest
from pyspark.sql import functions as F

from varve.operators import versions as V
from varve.operators.actions import validated

KEYS = [b"777", b"ccc", b"kkk", b"ttt"]
#: (timestamp, deleted): live, tombstone, live, tombstone, live
STEPS = [(3000, False), (2500, True), (2000, False), (1500, True), (1000, False)]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(s, bytearray(k), t, bytearray(f"data_{s}_{k.decode()}_{t}".encode()), d) for s in (100, 107, 109) for k in KEYS for t, d in STEPS]
    return spark.createDataFrame(rows, "keyspace int, key binary, commit_ts long, value binary, is_deleted boolean").cache()


def got(spark, log, space, key, ts):
    asked = spark.createDataFrame([(space, bytearray(key), 0)], "keyspace int, key binary, pos int")
    value = V.multi_get(log, asked, ts).collect()[0].value
    return None if value is None else int(bytes(value).decode().split("_")[-1])


@pytest.mark.parametrize(
    ("space", "key", "ts", "want"),
    [(42, b"ccc", 0, None), (107, b"zzz", 0, None), (107, b"ccc", 999, None), (107, b"ccc", 0, 3000), (107, b"ccc", 3000, 3000), (107, b"ccc", 2999, None), (107, b"ccc", 2500, None), (107, b"ccc", 2499, 2000), (107, b"ccc", 2000, 2000), (107, b"ccc", 1999, None), (107, b"cc", 0, None), (107, b"cccc", 0, None)],
)
def test_point_reads(spark, log, space, key, ts, want):
    assert got(spark, log, space, key, ts) == want


@pytest.mark.parametrize(
    ("start", "end", "ts", "want"),
    [(b"ccc", b"ttt", 0, [b"ccc", b"kkk"]), (b"ccc", b"ccc", 0, []), (b"777", b"zzz", 0, KEYS), (b"777", b"zzz", 2001, KEYS), (b"777", b"zzz", 1999, []), (b"777", b"zzz", 2500, [])],
)
def test_range_reads(log, start, end, ts, want):
    assert [bytes(r.key) for r in V.range_read(log, 107, bytearray(start), bytearray(end), ts).collect()] == want


def test_limit_and_prefix_keys(spark):
    rows = [(100, bytearray(k), 1, bytearray(b"v"), False) for k in (b"ab", b"a", b"\xff\x01", b"b")]
    log = spark.createDataFrame(rows, "keyspace int, key binary, commit_ts long, value binary, is_deleted boolean")
    assert [bytes(r.key) for r in V.range_read(log, 100, bytearray(b"a"), bytearray(b"\xff\xff"), 0, 3).collect()] == [b"a", b"ab", b"b"]
    assert [bytes(r.key) for r in V.range_read(log, 100, bytearray(b"a"), bytearray(b"\xff\xff")).collect()][-1] == b"\xff\x01"


def test_address_ranges_hold_all_versions(log):
    rows = V.all_versions(log, 109, (bytearray(b"ccc"), 2000), (bytearray(b"kkk"), 2500)).collect()
    assert [(bytes(r.key), r.commit_ts) for r in rows] == [(b"ccc", 2000), (b"ccc", 1500), (b"ccc", 1000), (b"kkk", 3000)]


def test_exists_in_range_equals_brute_force(spark):
    rows = [(1, k, ts, 0.0, (k + ts) % 5 == 0) for k in range(0, 90, 3) for ts in (1, 4, 7)]
    log = spark.createDataFrame(rows, "keyspace int, key long, commit_ts long, value double, is_deleted boolean")
    asked = [(1, a, a + w, t) for a in range(0, 100, 7) for w in (0, 1, 2, 9) for t in (0, 3, 5, 9)]

    def live(k, t):
        own = [r for r in rows if r[1] == k and r[2] <= t]
        return bool(own) and not max(own, key=lambda r: r[2])[4]

    ranges = spark.createDataFrame(asked, "keyspace int, lo long, hi long, as_of long")
    want = {(lo, hi, t): any(live(k, t) for k in range(lo, hi)) for _, lo, hi, t in asked}
    assert {(r.lo, r.hi, r.as_of): r.found for r in V.exists_in_range(log, ranges).collect()} == want and len(set(want.values())) == 2
    binary = lambda df, *names: df.withColumns({n: F.encode(F.lpad(F.col(n).cast("string"), 4, "0"), "UTF-8") for n in names})
    same = V.exists_in_range(binary(log, "key"), binary(ranges, "lo", "hi"))
    assert {(int(bytes(r.lo)), int(bytes(r.hi)), r.as_of): r.found for r in same.collect()} == want
    last = V.exists_in_range(log, ranges.select("keyspace", "lo", "hi").distinct(), 5).collect()
    assert {(r.lo, r.hi): r.found for r in last} == {(lo, hi): f for (lo, hi, t), f in want.items() if t == 5}


def test_as_of_and_vacuum(spark, log):
    asked = spark.createDataFrame([(100, bytearray(b"ccc"), t) for t in (500, 1000, 1600, 2100, 9000)], "keyspace int, key binary, as_of long")
    assert [(r.as_of, r.commit_ts) for r in V.as_of(log, asked).orderBy("as_of").collect()] == [(1000, 1000), (2100, 2000), (9000, 3000)]
    kept = V.vacuum(log, 2600)
    assert kept.agg(F.min("commit_ts")).collect()[0][0] == 3000
    assert V.snapshot(kept, 2700).count() == V.snapshot(log, 2700).count() == 0


def test_empty_log(spark, log):
    none = log.filter("false")
    assert V.snapshot(none).isEmpty() and V.validity(none).isEmpty()
    asked = spark.createDataFrame([(100, bytearray(b"a"), 0)], "keyspace int, key binary, pos int")
    assert V.multi_get(none, asked).collect()[0].value is None


def test_ranges_as_of_meet_no_versions(spark):
    rng = random.Random(5)
    rows = [(s, rng.randrange(300), rng.choice([None, *range(60)]), rng.choice([True, True, False, None])) for s in (1, 2) for _ in range(900)]
    rows = list({r[:3]: r for r in rows}.values())
    asked = [(s, lo, lo + rng.choice([0, 1, 2, 40, 299]), t) for s in (1, 2, 3) for lo in range(-20, 310, 6) for t in (-1, 7, 30, 70, None)]

    def found(s, lo, hi, t):
        seen = {}
        for r in sorted((r for r in rows if None not in (r[2], t) and r[0] == s and lo <= r[1] < hi and r[2] <= t), key=lambda r: r[2]):
            seen[r[1]] = r[3] is False
        return any(seen.values())

    log = spark.createDataFrame(rows, "keyspace int, key long, commit_ts long, is_deleted boolean")
    out = V.exists_in_range(log, spark.createDataFrame(asked, "keyspace int, lo long, hi long, as_of long"))
    got = {(r.keyspace, r.lo, r.hi, r.as_of): r.found for r in out.collect()}
    assert got == {a: found(*a) for a in asked} and {*got.values()} == {True, False}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
    assert joins and not [x for x in joins if "<" in x or ">" in x]


def test_validation_of_odd_rows(spark):
    log = spark.createDataFrame([(1, 5, None, False), (1, 6, 10, False)], "keyspace int, key long, commit_ts long, is_deleted boolean")
    acts = [(1, 20, 0, "Insert", 5), (2, 20, 0, "Insert", 6), (3, 20, 0, None, 6), (4, None, 0, "Update", 6), (5, 20, 0, "Read", 7)]
    acts = spark.createDataFrame(acts, "txn long, commit_ts long, action_id long, kind string, key long").selectExpr("*", "1 as keyspace", "key + 1 as end", "cast(null as string) as check")
    assert {(r.txn, r.code) for r in validated(acts, log).collect()} == {(1, "Success"), (2, "KeyAlreadyExists"), (3, "Success"), (4, "KeyNotFound"), (5, "Success")}
