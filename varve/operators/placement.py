"""Replica placement: dealing, balance, rebalancing and checks.

Reports are DataFrame plans.  Rebalancing works on the control plane's state,
a few rows per partition, on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERVING = ("Voter", "NonVoter")
#: Replicas that may be joining at once: in all, for a server, for a partition.
CAPS = (16, 2, 1)
REPLICAS = 3
#: States from which a replica may go to each; Joining is for new replicas only, and whoever is there may leave.
FROM = {"Voter": ("Joining", "NonVoter"), "NonVoter": ("Joining", "Voter"), "Leaving": ("Joining", "Voter", "NonVoter", "Leaving")}
#: What a replica's process becomes when it is told a state, by the one it is in.
LIFECYCLE = {
    "Stopped": {"Joining": "joining", "Voter": "serving", "NonVoter": "serving", "Leaving": "leaving"},
    "Joining": {"Voter": "serving", "NonVoter": "serving", "Leaving": "leaving", "Stopped": "stopped"},
    "Voter": {"NonVoter": "serving", "Leaving": "leaving", "Stopped": "stopped"},
    "NonVoter": {"Voter": "serving", "Leaving": "leaving", "Stopped": "stopped"},
    "Leaving": {"Stopped": "stopped"},
}


def deal(spark: SparkSession, partitions: int, servers: int, factor: int) -> DataFrame:
    """Initial placement (pid, replica, server): slot k goes to server (k + 1) mod servers."""
    factor = min(factor, servers)
    slots = spark.range(partitions * factor).withColumnRenamed("id", "slot")
    return slots.select(F.floor(F.col("slot") / factor).alias("pid"), (F.col("slot") % factor).alias("replica"), ((F.col("slot") + 1) % servers).alias("server"))


def per_server(replicas: DataFrame, servers: DataFrame) -> DataFrame:
    """Servers with the number of their replicas that are joining or serving."""
    counts = replicas.filter(F.col("state").isin("Joining", *SERVING)).groupBy("server").agg(F.count("*").alias("n_replicas"))
    return servers.select("server").join(counts, "server", "left").withColumn("n_replicas", F.coalesce("n_replicas", F.lit(0)))


def max_imbalance(replicas: DataFrame, servers: DataFrame) -> DataFrame:
    """One row: largest minus smallest number of replicas of a server."""
    return per_server(replicas, servers).agg((F.max("n_replicas") - F.min("n_replicas")).alias("imbalance"))


def settled(replicas: DataFrame) -> DataFrame:
    """Replicas (pid, server, state, ready) after those that are ready have gone on: joining ones serve, leaving ones are gone."""
    ready = F.col("ready")
    kept = replicas.filter(~((F.col("state") == "Leaving") & ready))
    return kept.withColumn("state", F.when((F.col("state") == "Joining") & ready, "Voter").otherwise(F.col("state")))


def _loads(replicas: DataFrame, by: str) -> DataFrame:
    counted = F.col("state").isin("Joining", *SERVING)
    return replicas.groupBy(by).agg(F.count_if(counted).alias("total"), F.count_if(F.col("state") == "Joining").alias("joining"), F.count_if(F.col("state").isin(*SERVING)).alias("serving"))


def addable(replicas: DataFrame, partitions: DataFrame, servers: DataFrame, caps: tuple[int, int, int] = CAPS) -> DataFrame:
    """(pid, server) where a replica may be added: neither has too many that are joining, nor has the cluster, and the server has none of the partition."""
    all_joining = replicas.agg(F.count_if(F.col("state") == "Joining").alias("all_joining"))
    free_servers = servers.select("server").join(_loads(replicas, "server"), "server", "left").filter(F.coalesce("joining", F.lit(0)) < caps[1])
    free_parts = partitions.select("pid").join(_loads(replicas, "pid"), "pid", "left").filter(F.coalesce("joining", F.lit(0)) < caps[2])
    # a cluster's servers are few: they are one array beside each partition
    listed = free_servers.agg(F.array_sort(F.collect_list("server")).alias("list")).join(all_joining).filter(F.col("all_joining") < caps[0])
    pairs = free_parts.select("pid").join(listed.select("list")).select("pid", F.explode("list").alias("server"))
    return pairs.join(replicas.select("pid", "server"), ["pid", "server"], "left_anti")


def missing(replicas: DataFrame, partitions: DataFrame, servers: DataFrame, factor: int = REPLICAS, caps: tuple[int, int, int] = CAPS) -> DataFrame:
    """(pid, server) to add next: partitions with fewer than ``factor`` replicas get servers with the fewest of them, then the fewest joining."""
    load, own = _loads(replicas, "server").withColumnsRenamed({"total": "s_total", "joining": "s_joining"}), _loads(replicas, "pid")
    want = partitions.select("pid").join(own, "pid", "left").fillna(0, ["total", "joining"])
    want = want.select("pid", F.least(F.lit(factor) - F.col("total"), F.lit(caps[2]) - F.col("joining")).alias("want")).filter("want > 0")
    ranked = addable(replicas, partitions, servers, caps).join(want, "pid").join(load.select("server", "s_total", "s_joining"), "server", "left").fillna(0, ["s_total", "s_joining"])
    place = Window.partitionBy("pid").orderBy("s_total", "s_joining", "server")
    return ranked.withColumn("place", F.row_number().over(place)).filter("place <= want").select("pid", "server")


def extra(replicas: DataFrame, factor: int = REPLICAS) -> DataFrame:
    """(pid, server) to leave next: of partitions with more than ``factor`` serving replicas, on the most loaded servers, then the oldest."""
    load = _loads(replicas, "server").select("server", F.col("total").alias("s_total"))
    serving = replicas.filter(F.col("state").isin(*SERVING)).join(load, "server")
    place = Window.partitionBy("pid").orderBy(F.desc("s_total"), "created", "server")
    over = F.count("*").over(Window.partitionBy("pid")) - factor
    return serving.withColumns({"place": F.row_number().over(place), "over": over}).filter("place <= over").select("pid", "server")


class Cluster:
    """The control plane's state, a few rows a partition, on the driver: {(pid, server): [state, ready, created]}."""

    def __init__(self, replicas: dict[tuple[int, int], list], servers: list[int], partitions: int, factor: int = REPLICAS, caps: tuple[int, int, int] = CAPS):
        self.replicas = {k: list(v) for k, v in replicas.items()}
        self.servers, self.partitions, self.factor, self.caps = sorted(servers), partitions, factor, caps

    def _count(self, states: tuple[str, ...], pid: int | None = None, server: int | None = None) -> int:
        return sum(v[0] in states and (pid is None or p == pid) and (server is None or s == server) for (p, s), v in self.replicas.items())

    def load(self, server: int) -> int:
        """Replicas of a server that are joining or serving."""
        return self._count(("Joining", *SERVING), server=server)

    def imbalance(self) -> int:
        """Largest minus smallest load."""
        loads = [self.load(s) for s in self.servers]
        return max(loads, default=0) - min(loads, default=0)

    def can_add(self, pid: int, server: int) -> bool:
        """Whether the caps allow a new replica there."""
        own = [self._count(("Joining",)), self._count(("Joining",), server=server), self._count(("Joining",), pid=pid)]
        return (pid, server) not in self.replicas and all(n < cap for n, cap in zip(own, self.caps))

    def step(self, now: int) -> "Cluster":
        """The state wanted next: ready replicas go on, missing ones are added, extra ones leave, and loads are evened out."""
        out = Cluster(self.replicas, self.servers, self.partitions, self.factor, self.caps)
        for key, (state, ready, created) in list(out.replicas.items()):
            if ready and state == "Leaving":
                del out.replicas[key]
            elif ready and state == "Joining":
                out.replicas[key] = ["Voter", False, created]
        for pid in range(out.partitions):
            out._add(pid, now)
        for pid in range(out.partitions):
            out._remove(pid)
        while out.imbalance() > 1 and out._even(now):
            pass
        return out

    def _add(self, pid: int, now: int) -> None:
        want = min(self.factor - self._count(("Joining", *SERVING), pid=pid), self.caps[2] - self._count(("Joining",), pid=pid))
        for server in sorted(self.servers, key=lambda s: (self.load(s), self._count(("Joining",), server=s), s)):
            if want > 0 and self.can_add(pid, server):
                self.replicas[pid, server] = ["Joining", False, now]
                want -= 1

    def _remove(self, pid: int) -> None:
        serving = [s for (p, s), v in self.replicas.items() if p == pid and v[0] in SERVING]
        over = len(serving) - self.factor
        for server in sorted(serving, key=lambda s: (-self.load(s), self.replicas[pid, s][2], s))[: max(over, 0)]:
            self.replicas[pid, server][0] = "Leaving"

    def _even(self, now: int) -> bool:
        """Add one replica of a loaded server's partition on one with less; a later step takes the surplus one away."""
        ranked = sorted(self.servers, key=lambda s: (-self.load(s), s))
        for source in ranked:
            for target in reversed(ranked):
                if self.load(source) - self.load(target) <= 1:
                    break
                for (pid, server), v in sorted(self.replicas.items()):
                    if server == source and v[0] in SERVING and self.can_add(pid, target):
                        self.replicas[pid, target] = ["Joining", False, now]
                        return True
        return False

    def commands(self, new: "Cluster") -> list[tuple[str, int, int, str | None]]:
        """(command, pid, server, state) that lead from this state to ``new``, in the order to apply them: Remove, Update, Add.

        A replica that has left and comes back to its server is removed and added.
        """
        back = {k for k, v in new.replicas.items() if v[0] == "Joining" and self.replicas.get(k, ["Joining"])[0] != "Joining"}
        out = [("Remove", *k, None) for k in sorted(self.replicas) if k not in new.replicas or k in back]
        out += [("Update", *k, v[0]) for k, v in sorted(new.replicas.items()) if k in self.replicas and k not in back and v[0] != self.replicas[k][0]]
        return out + [("Add", *k, "Joining") for k in sorted(new.replicas) if k not in self.replicas or k in back]


def rebalanced(assignment: dict[int, list[int]], servers: list[int], factor: int) -> dict[int, list[int]]:
    """An assignment {partition: servers} with ``factor`` replicas each and a balance within one: steps until none changes it."""
    known = {(p, s): ["Voter", False, 0] for p, own in assignment.items() for s in own if s in set(servers)}
    pids = sorted(assignment)
    index = {p: i for i, p in enumerate(pids)}
    cluster = Cluster({(index[p], s): v for (p, s), v in known.items()}, servers, len(pids), min(factor, len(servers)))
    for now in range(1, 100 * (len(pids) + 1)):
        new = cluster.step(now)
        if not cluster.commands(new):
            break
        for v in new.replicas.values():
            v[1] = True  # what joins or leaves is ready by the next step
        cluster = new
    return {p: [s for (i, s), v in sorted(cluster.replicas.items()) if i == index[p] and v[0] in SERVING] for p in pids}


def state_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Commands that lead from one set of replicas (pid, replica, server, state) to another: Add, Update, Remove."""
    a = old.select("pid", "replica", F.struct("server", "state").alias("before"))
    b = new.select("pid", "replica", F.struct("server", "state").alias("after"))
    both = a.join(b, ["pid", "replica"], "full")
    change = F.when(F.col("before").isNull(), "Add").when(F.col("after").isNull(), "Remove").when(F.col("before") != F.col("after"), "Update")
    return both.withColumn("command", change).filter("command is not null").select("pid", "replica", "command", F.coalesce("after.server", "before.server").alias("server"), "after.state")


def violations(replicas: DataFrame, partitions: DataFrame) -> DataFrame:
    """(pid, problem): two replicas on one server, or a partition that nothing serves."""
    twice = replicas.groupBy("pid", "server").agg(F.count("*").alias("n")).filter("n > 1").select("pid", F.lit("duplicate server").alias("problem")).distinct()
    served = replicas.filter(F.col("state").isin(*SERVING)).select("pid").distinct()
    return twice.unionByName(partitions.select("pid").distinct().join(served, "pid", "left_anti").withColumn("problem", F.lit("not served")))


def valid_transition(before, after):
    """Whether a replica may go from one state (null: there is none) to the other."""
    table = F.create_map(*[x for k, v in FROM.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.when(after == "Joining", before.isNull()).otherwise(F.coalesce(F.array_contains(F.try_element_at(table, after), before), F.lit(False)))


def lifecycle(before, told):
    """What a replica's process becomes (joining, serving, leaving, stopped) when it is told a state; null where it stays or can't."""
    table = F.create_map(*[x for k, v in LIFECYCLE.items() for t, to in v.items() for x in (F.lit(f"{k}>{t}"), F.lit(to))])
    return F.try_element_at(table, F.concat_ws(">", before, told))


def command_errors(commands: DataFrame, replicas: DataFrame, partitions: int, servers: DataFrame) -> DataFrame:
    """Assignment commands (command, pid, server, state) with ``error``, null where they may be applied.

    Add needs a partition, a server and no replica there; Update a replica and
    a valid transition that does not take a partition's last serving replica;
    Remove a replica that is leaving.
    """
    own = replicas.groupBy("pid", "server").agg(F.max("state").alias("before"))
    serving = replicas.groupBy("pid").agg(F.count_if(F.col("state").isin(*SERVING)).alias("serving"))
    all_ = commands.join(own, ["pid", "server"], "left").join(serving, "pid", "left").join(servers.select("server", F.lit(True).alias("is_server")), "server", "left")
    command, before, state = F.col("command"), F.col("before"), F.col("state")
    known = F.col("pid").between(0, partitions - 1)
    last = (F.coalesce("serving", F.lit(0)) == 1) & before.isin(*SERVING) & ~state.isin(*SERVING)
    error = (
        F.when((command == "Add") & ~(known & F.coalesce("is_server", F.lit(False))), "invalid Add")
        .when((command == "Add") & before.isNotNull(), "same server")
        .when((command == "Update") & ~(known & before.isNotNull()), "invalid Update")
        .when((command == "Update") & ~valid_transition(before, state), "invalid transition")
        .when((command == "Update") & last, "last serving replica")
        .when((command == "Remove") & ~(known & before.isNotNull()), "invalid Remove")
        .when((command == "Remove") & (before != "Leaving"), "not leaving")
    )
    return all_.withColumn("error", error).select(*commands.columns, "error")


def availability(probes: DataFrame) -> DataFrame:
    """Probes (reachable, connected): ready from 80 % reachable leaders, failing from 20 % failed connections."""
    rates = probes.agg(F.avg(F.col("reachable").cast("int")).alias("reachable"), F.avg((~F.col("connected")).cast("int")).alias("failed"))
    return rates.select(*rates.columns, (F.col("reachable") >= 0.8).alias("ready"), (F.col("failed") >= 0.2).alias("failing"))
