"""Reads of a version log at a snapshot.

``keys`` names the columns that address a record.  The newest version of each
key comes from one aggregation with map-side combine, not from a sort, and
range and timestamp bounds are plain comparisons that reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ordered import numbered

KEYS = ("keyspace", "key")
#: Records of a range read that is asked for by a transaction, at most.
MOST_RESULTS = 1000


def at(versions: DataFrame, snapshot: int | None) -> DataFrame:
    """Versions that a snapshot can see; None or 0 is the latest."""
    return versions.filter(F.col("commit_ts") <= snapshot) if snapshot else versions


def newest(versions: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The newest version of each key, tombstones included."""
    rest = [c for c in versions.columns if c not in keys and c != "commit_ts"]
    best = F.max_by(F.struct("commit_ts", *rest), "commit_ts").alias("v")
    return versions.groupBy(*keys).agg(best).select(*keys, "v.*")


def snapshot(versions: DataFrame, ts: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Live records at ``ts``: the newest version of each key that is not a tombstone."""
    return newest(at(versions, ts), keys).filter(~F.col("is_deleted")).drop("is_deleted")


def multi_get(versions: DataFrame, requests: DataFrame, ts: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Requested keys (with ``pos``) in request order; value and commit_ts are null where nothing is live.

    Only versions of requested keys are aggregated: the requests filter the
    log by a semi join first.
    """
    wanted = at(versions, ts).join(requests.select(*keys).distinct(), list(keys), "left_semi")
    return requests.join(snapshot(wanted, None, keys), list(keys), "left").orderBy("pos")


def in_range(key: Column, start: object, end: object | None = None) -> Column:
    """Half-open key range; no end is open."""
    return (key >= F.lit(start)) if end is None else (key >= F.lit(start)) & (key < F.lit(end))


def range_read(versions: DataFrame, keyspace: int, start: object, end: object, ts: int | None = None, limit: int = 0, most: int = 0, corrupt: Column | None = None, skip_corrupt: bool = True) -> DataFrame:
    """Live records with keys in [start, end), in key order.

    At most ``limit`` of them, and never more than ``most``; 0 is no bound.
    Records for which ``corrupt`` holds are left out before the bound, or, with
    ``skip_corrupt`` false, kept and marked in a column ``corrupt``.
    """
    found = versions.filter((F.col("keyspace") == keyspace) & in_range(F.col("key"), start, end))
    live = snapshot(found, ts)
    if corrupt is not None:
        bad = F.coalesce(corrupt, F.lit(True))
        live = live.filter(~bad) if skip_corrupt else live.withColumn("corrupt", bad)
    bound = min([n for n in (limit, most) if n], default=0)
    return live.orderBy("key").limit(bound) if bound else live.orderBy("key")


def exists(versions: DataFrame, requests: DataFrame, ts: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Requests with ``found``: whether the key is live."""
    live = snapshot(at(versions, ts).join(requests.select(*keys).distinct(), list(keys), "left_semi"), None, keys)
    return requests.join(live.select(*keys, F.lit(True).alias("found")), list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exists_in_range(versions: DataFrame, ranges: DataFrame, ts: int | None = None) -> DataFrame:
    """Ranges (keyspace, lo, hi) with ``found``: whether any live key is in [lo, hi).

    With a column ``as_of``, each range is looked at as of its own timestamp.
    Keys of any type that orders are numbered, and ranges meet only the numbers
    of their bounds.
    """
    own = ["keyspace", "lo", "hi"]
    if "as_of" in ranges.columns:
        own, hit = [*own, "as_of"], _found_as_of(versions, ranges)
    else:
        hit = _placed(snapshot(versions, ts), ranges)[1].filter("a < b").select(*own)
    return ranges.join(hit.withColumn("found", F.lit(True)), own, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _placed(log: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct keys of a log with ``place``, their number in order; the distinct ranges (keyspace, lo, hi) with the places [a, b) of the keys they hold."""
    spans = ranges.filter("keyspace is not null and lo < hi").select("keyspace", "lo", "hi").distinct()
    bounds = spans.select("keyspace", F.explode(F.array("lo", "hi")).alias("key"), F.lit(0).alias("own"))
    keys = log.filter("keyspace is not null and key is not null").select("keyspace", "key").distinct().withColumn("own", F.lit(1))
    places = keys.unionByName(bounds).groupBy("keyspace", "key").agg(F.max("own").alias("own"))
    places = numbered(places, ["keyspace", "key"], "place", F.col("own") == 1)
    lows, highs = (places.select("keyspace", F.col("key").alias(c), F.col("place").alias(n)) for c, n in (("lo", "a"), ("hi", "b")))
    return places.filter("own = 1").drop("own"), spans.join(lows, ["keyspace", "lo"]).join(highs, ["keyspace", "hi"])


def _blocks(a: Column, b: Column) -> Column:
    """The fewest blocks (level, block), of 2^level numbers from block * 2^level on, that make up the numbers [a, b)."""

    def at(level: Column) -> Column:
        shifted = lambda x: F.call_function("shiftright", x, level)
        first, end = shifted(a + F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1), shifted(b)
        ends = ((first % 2 == 1, first), (end % 2 == 1, end - 1))
        return F.array(*[F.when((first < end) & odd, F.struct(level.alias("level"), block.alias("block"))) for odd, block in ends])

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(b))), at)))


def _found_as_of(versions: DataFrame, ranges: DataFrame) -> DataFrame:
    """The distinct (keyspace, lo, hi, as_of) of ``ranges`` that hold a key which is live at as_of.

    Keys are numbered in order, and a range is made up of blocks of their
    numbers, at most two of each size.  Of each block that is asked for, one
    running sum over the times at which its keys come and go tells how many
    are live.  No version meets a range, so the work grows as the rows and the
    number of levels, not as their product.
    """
    log = versions.filter("keyspace is not null and key is not null and commit_ts is not null")
    places, spans = _placed(log, ranges)
    blocks = written(spans.select("keyspace", "lo", "hi", F.inline(_blocks(F.col("a"), F.col("b")))))
    levels = sorted(r[0] for r in blocks.select("level").distinct().collect())
    each = F.explode(F.array(*[F.lit(n) for n in levels])) if levels else F.explode(F.lit(None).cast("array<int>"))
    held = places.withColumn("level", each).withColumn("block", F.call_function("shiftright", F.col("place"), F.col("level")))
    held = held.join(blocks.select("level", "block").distinct(), ["level", "block"], "left_semi").select("keyspace", "key", "level", "block")
    live = F.coalesce(~F.col("is_deleted"), F.lit(False)).cast("long")
    before = F.coalesce(F.lag(live).over(Window.partitionBy(*KEYS).orderBy("commit_ts")), F.lit(0))
    changes = log.join(held.select(*KEYS).distinct(), list(KEYS), "left_semi").select(*KEYS, F.col("commit_ts").alias("t"), (live - before).alias("change"))
    changes = changes.filter("change != 0").join(held, list(KEYS)).select("level", "block", "t", "change")
    asked = ranges.filter("as_of is not null").select("keyspace", "lo", "hi", "as_of").distinct().join(blocks, ["keyspace", "lo", "hi"])
    asked = asked.select("level", "block", F.col("as_of").alias("t"), F.struct("keyspace", "lo", "hi", "as_of").alias("asked"))
    # a change counts from its own time on
    order = Window.partitionBy("level", "block").orderBy("t", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(changes, allowMissingColumns=True).withColumn("n", F.sum("change").over(order))
    return both.filter("asked is not null and n > 0").select("asked.*").distinct()


def exact(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """The versions at exactly the requested (keyspace, key, commit_ts)."""
    return requests.join(versions, [*KEYS, "commit_ts"], "left")


def all_versions(versions: DataFrame, keyspace: int, first: tuple[object, int] | None = None, last: tuple[object, int] | None = None) -> DataFrame:
    """All versions from address ``first`` (inclusive) to ``last`` (exclusive) in address order.

    An address is (key, commit_ts); newer versions of a key come first.
    """
    found, key, ts = versions.filter(F.col("keyspace") == keyspace), F.col("key"), F.col("commit_ts")
    if first is not None:
        found = found.filter((key >= F.lit(first[0])) & ((key > F.lit(first[0])) | (ts <= first[1])))
    if last is not None:
        found = found.filter((key <= F.lit(last[0])) & ((key < F.lit(last[0])) | (ts > last[1])))
    return found.orderBy("key", F.desc("commit_ts"))


def validity(versions: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every version with valid_to, the timestamp of the next one (null: still valid)."""
    order = Window.partitionBy(*keys).orderBy("commit_ts")
    return versions.withColumn("valid_to", F.lead("commit_ts").over(order)).withColumnRenamed("commit_ts", "valid_from")


def as_of(versions: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS, live_only: bool = True) -> DataFrame:
    """Requests (keys, as_of) with the version of each key that is newest at its own timestamp.

    One union and one running window per key: no row of the log meets more
    than the requests that follow it.
    """
    rest = [c for c in versions.columns if c not in (*keys, "commit_ts")]
    log = versions.select(*keys, F.col("commit_ts").alias("t"), F.lit(0).alias("side"), F.struct("commit_ts", *rest).alias("v"), F.lit(None).cast("long").alias("req"))
    kind = log.schema["v"].dataType
    asked = requests.withColumn("req", F.monotonically_increasing_id())
    ask = asked.select(*keys, F.col("as_of").alias("t"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("v"), "req")
    order = Window.partitionBy(*keys).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.unionByName(ask).withColumn("v", F.last("v", ignorenulls=True).over(order)).filter("side = 1")
    out = seen.select(*keys, F.col("t").alias("as_of"), "v.*")
    if live_only and "is_deleted" in rest:
        out = out.filter(~F.col("is_deleted")).drop("is_deleted")
    return out


def vacuum(versions: DataFrame, before: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The log without versions that no snapshot from ``before`` on can see."""
    order = Window.partitionBy(*keys).orderBy("commit_ts")
    marked = versions.withColumn("next_ts", F.lead("commit_ts").over(order))
    superseded = F.coalesce(F.col("next_ts") <= before, F.lit(False))
    dead = F.col("is_deleted") & (F.col("commit_ts") <= before)
    return marked.filter(~superseded & ~dead).drop("next_ts")
