"""Cluster reports and control-plane state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import numbered

SEEN_NS = 10_000_000_000
#: How long a token may be used to register again.
TOKEN_NS = 48 * 3600 * 1_000_000_000


def cluster(properties: DataFrame) -> DataFrame:
    """A one-row table as rows of (property, value)."""
    text = properties.select([F.col(c).cast("string") for c in properties.columns])
    return text.unpivot([], properties.columns, "property", "value")


def servers(table: DataFrame, now: int) -> DataFrame:
    """Servers by type and id, with ``stale``: not seen for ten seconds."""
    return table.withColumn("stale", F.lit(now) - F.col("last_seen") > SEEN_NS).orderBy("type", "id")


def partitions(replicas: DataFrame) -> DataFrame:
    """Counts by state, leader, term and log positions of each partition."""
    state = F.col("state")
    return replicas.groupBy("pid").agg(
        F.count("*").alias("total"),
        F.count_if(state.isin("Voter", "NonVoter")).alias("serving"),
        F.count_if(state == "Joining").alias("joining"),
        F.count_if(state == "Leaving").alias("leaving"),
        F.max_by("leader", "term").alias("leader"),
        F.max("term").alias("term"),
        F.max("applied").alias("applied"),
        F.max("committed").alias("committed"),
    )


def replicas(table: DataFrame) -> DataFrame:
    """Replicas in (pid, created, name) order with is_leader and lag behind the partition's committed position."""
    top = partitions(table).select("pid", F.col("leader").alias("top_leader"), F.col("committed").alias("top_committed"))
    out = table.join(top, "pid").withColumn("is_leader", F.col("name") == F.col("top_leader")).withColumn("lag", F.col("top_committed") - F.col("applied"))
    return out.drop("top_leader", "top_committed").orderBy("pid", "created", "name")


def merged_status(reports: DataFrame) -> DataFrame:
    """Last report of each replica (pid, name) by ts."""
    rest = [c for c in reports.columns if c not in ("pid", "name")]
    return reports.groupBy("pid", "name").agg(F.max_by(F.struct(*rest), "ts").alias("r")).select("pid", "name", "r.*")


def bootstrapped(spark: SparkSession, present: DataFrame, name: str, partitions: int, servers: list[tuple[int, str]]) -> dict[str, DataFrame]:
    """First tables of a cluster: cluster, servers, partitions; the cluster that is ``present`` (name, n_partitions) already stays as it is."""
    old = present.select("name", F.col("n_partitions").cast("int").alias("n_partitions")).limit(1)
    new = spark.createDataFrame([(name, partitions)], "name string, n_partitions int")
    cluster_ = old.unionByName(new.join(old.select(F.lit(1).alias("one")), how="left").filter("one is null").drop("one"))
    own = spark.createDataFrame(servers, "id bigint, name string").withColumn("type", F.lit("control"))
    parts = cluster_.select(F.explode(F.sequence(F.lit(0), F.col("n_partitions") - 1)).alias("pid"))
    return {"cluster": cluster_, "servers": own, "partitions": parts}


def registered(requests: DataFrame, last_id: int = 0) -> DataFrame:
    """Registrations (token, type, ts) by token: id (in order of first arrival, from ``last_id`` on), name (``type_id``) and, of each request, whether the token had expired."""
    first = requests.groupBy("token").agg(F.min_by(F.struct("type", "ts"), "ts").alias("r")).select("token", "r.type", F.col("r.ts").alias("since"))
    first = numbered(first, ["since", "token"], "id").withColumn("id", F.col("id") + last_id + 1)
    out = requests.select("token", "ts").join(first, "token")
    return out.select("token", "ts", "id", F.concat_ws("_", "type", F.col("id").cast("string")).alias("name"), (F.col("ts") - F.col("since") > TOKEN_NS).alias("expired"))


def guarded(tables: dict[str, int], command: dict[str, int]) -> list[str]:
    """Names of tables whose version is not the one that a command expects (0 expects none)."""
    return [name for name, version in command.items() if version and tables.get(name, 0) != version]


def save(path: str, tables: dict[str, DataFrame]) -> None:
    """Write a snapshot of the control plane's tables, each as Parquet in a folder that must not be there."""
    for name, table in tables.items():
        table.write.parquet(f"{path.rstrip('/')}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a snapshot."""
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}


def routing(replicas_: DataFrame) -> DataFrame:
    """Sorted serving replicas of each partition."""
    serving = replicas_.filter(F.col("state").isin("Voter", "NonVoter"))
    return serving.groupBy("pid").agg(F.array_sort(F.collect_list("server")).alias("servers"))


def clock_skew(readings: DataFrame) -> DataFrame:
    """One row: largest minus smallest clock offset."""
    return readings.agg((F.max("offset") - F.min("offset")).alias("skew"))
