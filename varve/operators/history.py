"""Transaction histories: reading, classification and isolation anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordered import numbered

SCHEMA = "type string, f string, process string, index bigint, time bigint, value array<array<string>>, hlc bigint, trace string, error string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A history file (a JSON array of records)."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def write(history: DataFrame, path: str) -> None:
    """Records (of SCHEMA) in the order of ``index`` as files of JSON lines, which ``read_lines`` reads; empty fields are left out."""
    history.repartitionByRange("index").sortWithinPartitions("index").write.json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A history written by ``write``."""
    return spark.read.schema(SCHEMA).json(path)


def workload(spark: SparkSession, n: int, keys: int, writes_in: int = 6, seed: int = 1, most_keys: int = 8) -> DataFrame:
    """Generated operations (txn, op, key, value): transactions of 1 to ``most_keys`` distinct keys, all writes in one of ``writes_in``, else all reads.

    A write's value is its number among the key's writes, so that values rise
    and are unique for each key.
    """
    drawn = spark.range(n).select(
        F.col("id").alias("txn"),
        (F.floor(F.rand(seed) * most_keys) + 1).alias("size"),
        (F.floor(F.rand(seed + 1) * writes_in) == 0).alias("is_write"),
        F.floor(F.rand(seed + 2) * keys).alias("first"),
    )
    span = F.least("size", F.lit(keys))
    ops = drawn.select("txn", "is_write", F.explode(F.sequence(F.lit(0).cast("bigint"), span - 1)).alias("i"), "first")
    ops = ops.select("txn", F.when(F.col("is_write"), "w").otherwise("r").alias("op"), ((F.col("first") + F.col("i")) % keys).alias("key"))
    counted = numbered(ops, ["key", "txn"], "n", F.col("op") == "w")
    before = counted.groupBy("key").agg(F.min("n").alias("before"))
    return counted.join(before, "key").select("txn", "op", "key", F.when(F.col("op") == "w", F.col("n") - F.col("before") + 1).alias("value"))


def outcome(error):
    """ok without an error; info where the outcome is unknown; fail otherwise."""
    return F.when(error.isNull(), "ok").when(error.rlike("(?i)context|deadline|internal"), "info").otherwise("fail")


def _ordered_writes(ops: DataFrame) -> DataFrame:
    """Writes (key, txn, value, commit_ts) with ``next_txn``, the key's next writer: neighbours in one global order, so that no task holds a key."""
    writes = numbered(ops.filter("op = 'w'").select("key", "txn", "value", "commit_ts"), ["key", "commit_ts", "txn"], "n")
    after = writes.select(F.col("key").alias("next_key"), F.col("txn").alias("next_txn"), (F.col("n") - 1).alias("n"))
    joined = writes.join(after, "n", "left")
    return joined.select("key", "txn", "value", "commit_ts", F.when(F.col("next_key") == F.col("key"), F.col("next_txn")).alias("next_txn"))


def dependencies(ops: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) between transactions of ops (txn, op, key, value, commit_ts).

    ww: next version of a key; wr: a read of a written version; rw: a read of
    a version, or of none, that the other overwrites.
    """
    writes = written(_ordered_writes(ops))
    ww = writes.filter("next_txn is not null").select(F.col("txn").alias("src"), F.col("next_txn").alias("dst"), F.lit("ww").alias("kind"))
    reads = ops.filter("op = 'r' and value is not null").select("key", "value", F.col("txn").alias("reader"))
    seen = reads.join(writes, ["key", "value"])
    wr = seen.select(F.col("txn").alias("src"), F.col("reader").alias("dst"), F.lit("wr").alias("kind"))
    rw = seen.filter("next_txn is not null").select(F.col("reader").alias("src"), F.col("next_txn").alias("dst"), F.lit("rw").alias("kind"))
    first = ops.filter("op = 'w'").groupBy("key").agg(F.min_by("txn", F.struct("commit_ts", "txn")).alias("dst"))
    empty = ops.filter("op = 'r' and value is null").join(first, "key").select(F.col("txn").alias("src"), "dst", F.lit("rw").alias("kind"))
    return ww.unionByName(wr).unionByName(rw).unionByName(empty).filter("src != dst").distinct()


def realtime_anomalies(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """Dependencies (src, dst, kind) that real time closes to a cycle: dst had ended (spans: txn, began, ended) before src began.

    The class is G1c-realtime for what was written or read, G2-realtime for
    what was overwritten.
    """
    own = lambda c: spans.select(F.col("txn").alias(c), F.col("began").alias(f"{c}_began"), F.col("ended").alias(f"{c}_ended"))
    found = edges.join(own("src"), "src").join(own("dst"), "dst").filter("dst_ended < src_began")
    return found.select("src", "dst", "kind", F.when(F.col("kind") == "rw", "G2-realtime").otherwise("G1c-realtime").alias("class"))


def anomalies(ops: DataFrame, failed: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """How many of each class a history shows (class, n): G1a reads of failed writes; G1c and G2 edges left by ``cyclic``; the realtime ones.

    G1c takes ww and wr edges, G2 all three kinds; without rows of a class the
    history is free of it.  Real time is held against single dependencies.
    """
    edges = written(dependencies(ops))
    out = aborted_reads(ops, failed).agg(F.lit("G1a").alias("class"), F.count("*").alias("n"))
    out = out.unionByName(cyclic(edges.filter("kind != 'rw'")).agg(F.lit("G1c").alias("class"), F.count("*").alias("n")))
    out = out.unionByName(cyclic(edges).agg(F.lit("G2").alias("class"), F.count("*").alias("n")))
    if spans is not None:
        out = out.unionByName(realtime_anomalies(edges, spans).groupBy("class").agg(F.count("*").alias("n")))
    return out.filter("n > 0")


def _pointers(preds: DataFrame) -> DataFrame:
    """(node, up, rooted) of the nodes with one way in: the end of their way back, or rooted = false where it runs into a ring.

    Pointers double.  The way of 2^k steps from a node and the one that goes on
    from it share their smallest node only if they meet it twice, on a ring.
    """
    live = written(preds.filter("lo = hi and lo != head").select(F.col("head").alias("node"), F.col("lo").alias("up"), F.col("head").alias("low")))
    ready = None
    while not live.isEmpty():
        known = live.withColumn("rooted", F.lit(None).cast("boolean"))
        known = known if ready is None else known.unionByName(ready)
        ahead = known.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("low").alias("far_low"), "rooted", F.lit(True).alias("more"))
        rooted = F.when(F.col("more").isNull(), True).when(F.col("rooted").isNotNull(), F.col("rooted")).when(F.col("low") == F.col("far_low"), False)
        step = written(live.join(ahead, "up", "left").select("node", F.coalesce("far", "up").alias("up"), F.least("low", "far_low").alias("low"), rooted.alias("rooted")))
        done = step.filter("rooted is not null")
        ready = done if ready is None else ready.unionByName(done)
        live = step.filter("rooted is null").drop("rooted")
    return preds.sparkSession.createDataFrame([], live.select("node", "up", F.lit(True).alias("rooted")).schema) if ready is None else ready.select("node", "up", "rooted")


def _fed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) whose src lies on a cycle or behind one.

    Nodes without a way in go; a node with one way in is merged into the start
    of that way, whole chains at once; one that a ring feeds gets a loop, so
    that it stays.  Ends when neither finds a node.
    """
    # tail: what src is merged into; head: dst while it is not merged
    active = edges.select("src", "dst", F.col("src").alias("tail"), F.col("dst").alias("head"))
    merged = edges.select("src", "dst", F.col("src").alias("tail")).filter("false")
    count = -1
    while True:
        fed = active.select(F.col("head").alias("tail")).distinct()
        active, merged = written(active.join(fed, "tail", "left_semi")), written(merged.join(fed, "tail", "left_semi"))
        preds = active.groupBy("head").agg(F.min("tail").alias("lo"), F.max("tail").alias("hi"))
        pointers = _pointers(preds)
        left = active.count() + merged.count()
        if left == 0 or (left == count and pointers.isEmpty()):
            return active.select("src", "dst").unionByName(merged.select("src", "dst"))
        count = left
        at_head = pointers.select(F.col("node").alias("head"), "rooted")
        at_tail = pointers.filter("rooted").select(F.col("node").alias("tail"), "up")
        active = active.join(at_head, "head", "left").join(at_tail, "tail", "left")
        tail = F.when(F.col("rooted") == F.lit(False), F.col("head")).otherwise(F.coalesce("up", "tail"))
        active = written(active.select("src", "dst", tail.alias("tail"), "head", "rooted"))
        merged = merged.join(at_tail, "tail", "left").select("src", "dst", F.coalesce("up", "tail").alias("tail"))
        merged = merged.unionByName(active.filter("rooted").select("src", "dst", "tail"))
        active = active.filter("rooted is null or not rooted").drop("rooted")


def cyclic(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) that remain when transactions without a way in or out are trimmed again and again.

    Empty if, and only if, the graph has no cycle; what remains lies on a cycle
    or on a way from one to another.  Chains are trimmed at once, in a number
    of steps that grows with the logarithm of their length; a part in which
    each transaction has several ways in and out takes a round a layer.
    """
    found = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    for _ in range(2):
        found = _fed(found).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return found


def aborted_reads(ops: DataFrame, failed: DataFrame) -> DataFrame:
    """Reads of a value that only a failed transaction wrote."""
    return ops.filter("op = 'r'").join(failed.filter("op = 'w'").select("key", "value").distinct(), ["key", "value"], "left_semi")


def stale_reads(ops: DataFrame) -> DataFrame:
    """Reads (txn, key, value) at commit_ts that do not return the newest version before it, with that version (null: none).

    Writes are numbered in one global order of keys and times, and a read meets
    the last one before it by number, so that no task holds a key.
    """
    is_write = F.col("op") == "w"
    rows = numbered(ops.withColumn("side", (~is_write).cast("int")), ["key", "commit_ts", "side", "txn"], "n", is_write)
    newest = rows.filter(is_write).select((F.col("n") + 1).alias("n"), F.col("key").alias("w_key"), F.col("value").alias("w_value"))
    seen = rows.filter("op = 'r'").join(newest, "n", "left").withColumn("expected", F.when(F.col("w_key") == F.col("key"), F.col("w_value")))
    return seen.filter(~F.col("value").eqNullSafe(F.col("expected"))).select(*ops.columns, "expected")
