"""Property graph: vertices and directed edges as version logs.

vertices (type, value, props) and edges (head, tail, type, props) are addressed
by their order-preserving keys (``functions.keys``), so that a vertex's edges
directly follow it.  Creation, update and deletion follow the Insert, Update and
Delete actions: a bulk of requests is as many requests of one record each, at
their own commit_ts, and gives a code for each and the versions that the
successful ones append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import edge_key, vertex_key
from ..model import KEY_EXISTS, KEY_NOT_FOUND, LOCK_CHECK_FAILED, LOCK_FAILED, SUCCESS
from .versions import as_of, snapshot


def keyed_vertices(vertices: DataFrame) -> DataFrame:
    """Vertices with ``key``; ids need a non-zero type and a non-empty value."""
    valid = (F.col("type") > 0) & (F.octet_length(F.col("value").cast("binary")) > 0)
    return vertices.filter(valid).withColumn("key", vertex_key(F.col("type"), F.col("value")))


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Edges (head_type, head_value, type, tail_type, tail_value) with head_key, tail_key and ``key``."""
    keyed = edges.withColumn("head_key", vertex_key(F.col("head_type"), F.col("head_value")))
    keyed = keyed.withColumn("tail_key", vertex_key(F.col("tail_type"), F.col("tail_value")))
    return keyed.withColumn("key", edge_key(F.col("head_key"), F.col("type"), F.col("tail_key")))


def get(log: DataFrame, requests: DataFrame, ts: int | None = None) -> DataFrame:
    """Requested keys that are live at ``ts``, for vertices and edges alike."""
    return snapshot(log.join(requests.select("key").distinct(), "key", "left_semi"), ts, ("key",))


def out_edges(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges of the given vertices (head_key)."""
    return edges.join(heads.select("head_key").distinct(), "head_key", "left_semi")


def _looked_up(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (key, commit_ts, ...) with ``found``, whether the key is live just before, and ``turn``, their place among requests for the key."""
    asked = requests.select("key", (F.col("commit_ts") - 1).alias("as_of")).distinct()
    live = as_of(log, asked, ("key",)).select("key", (F.col("as_of") + 1).alias("commit_ts"), F.lit(True).alias("found"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("commit_ts", "pos"))
    return requests.join(live, ["key", "commit_ts"], "left").withColumns({"found": F.coalesce("found", F.lit(False)), "turn": turn})


def _coded(looked: DataFrame, failure) -> DataFrame:
    code = F.when(F.col("turn") > 1, F.lit(LOCK_FAILED)).when(failure.isNotNull(), failure).otherwise(F.lit(SUCCESS))
    return looked.withColumn("code", code).drop("found", "turn")


def created(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (key, pos, commit_ts, payload) to create records, with ``code``: the key must not be live.

    A key that stands in several requests is locked by the first.
    """
    return _coded(_looked_up(log, requests), F.when(F.col("found"), F.lit(KEY_EXISTS)))


def updated(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests to set records anew, with ``code``: the key must be live."""
    return _coded(_looked_up(log, requests), F.when(~F.col("found"), F.lit(KEY_NOT_FOUND)))


def deleted(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (key, pos, commit_ts) to delete records, with ``code``: the key must be live."""
    return updated(log, requests.withColumn("payload", F.lit(None).cast("string")))


def deleted_vertices(vertices: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests to delete vertices, with ``code``: the vertex must be live and no edge (head_key in ``edges``) may leave it just before."""
    own = edges.join(requests.select(F.col("key").alias("head_key")).distinct(), "head_key", "left_semi")
    asked = own.select("key", "head_key").distinct().join(requests.select(F.col("key").alias("head_key"), "commit_ts").distinct(), "head_key")
    live = as_of(own, asked.select("key", (F.col("commit_ts") - 1).alias("as_of")).distinct(), ("key",))
    leaving = live.select(F.col("head_key").alias("key"), (F.col("as_of") + 1).alias("commit_ts"), F.lit(True).alias("leaves")).distinct()
    looked = _looked_up(vertices, requests.withColumn("payload", F.lit(None).cast("string"))).join(leaving, ["key", "commit_ts"], "left")
    return _coded(looked, F.when(~F.col("found"), F.lit(KEY_NOT_FOUND)).when(F.col("leaves"), F.lit(LOCK_CHECK_FAILED))).drop("leaves")


def written_versions(resolved: DataFrame) -> DataFrame:
    """The versions (key, commit_ts, payload, is_deleted) that successful requests append; a deletion has no payload."""
    return resolved.filter(F.col("code") == SUCCESS).select("key", "commit_ts", "payload", F.col("payload").isNull().alias("is_deleted"))


def deletable_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices without out-edges, the only ones that may be deleted."""
    return vertices.join(edges.select(F.col("head_key").alias("key")).distinct(), "key", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    turned = {"head_type": "tail_type", "head_value": "tail_value", "tail_type": "head_type", "tail_value": "head_value"}
    return edges.unionByName(edges.select(*[F.col(turned.get(c, c)).alias(c) for c in edges.columns])).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """head_key, type, n_edges."""
    return edges.groupBy("head_key", "type").agg(F.count("*").alias("n_edges"))
