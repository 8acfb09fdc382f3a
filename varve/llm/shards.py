"""Sharding with size-tiered compaction, native operators only.

Every arrival is appended as small immutable shards (Parquet files) and never
changed.  Compaction puts shards into tiers by size; runs of similar shards are
merged, without a shuffle of rows, into files of a target size.  What readers
see is a manifest, versioned and committed atomically.

A manifest version is a small file that names segments, each an immutable list
of shards, and the schema of all rows.  A commit writes the segments that it
adds and one version file, so its size follows the arrival and not the store;
segments are merged like shards.  A version file is published under its number
by an operation that refuses to replace a file (a hard link on a local file
system, an exclusive rename elsewhere), so of two writers one gets the number
and the other takes its changes to the next.

Rows keep all their columns whatever they hold; an arrival may add columns,
which are null in older rows, and lack some, which are null in its own.  A
column whose type differs from the store's is an error, and nothing is written.
Names are compared as Spark compares them, without case.  Repeated rows, nulls,
empty and very long texts are rows like others; an arrival without rows adds its
columns only.  A store without arrivals has no columns.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import Conflict, Folder
from .session import fresh_path

TARGET_BYTES = 128 << 20
#: Shards of a tier from which it is merged, and the growth from tier to tier; segments likewise.
FAN_IN = 4
#: Merges planned into one job.
WAVE = 64


class SchemaConflict(ValueError):
    """An arrival's column has another type than the store's."""


@dataclass(frozen=True)
class Shard:
    """One immutable file."""

    path: str
    bytes: int
    rows: int
    tier: int


@dataclass(frozen=True)
class Manifest:
    """A version: segments as (path, number of shards), and the schema as JSON (None: no arrival yet)."""

    segments: tuple[tuple[str, int], ...] = ()
    schema: str | None = None


def merged_schema(known: T.StructType | None, new: T.StructType) -> T.StructType:
    """All columns of both, nullable; the known order and case first."""
    fields = {f.name.lower(): f for f in known} if known else {}
    for f in new:
        old = fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True))
        if old.dataType.simpleString() != f.dataType.simpleString():
            raise SchemaConflict(f"column {f.name} is {f.dataType.simpleString()} and not {old.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


class ShardStore:
    """A folder of shards with its manifests."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.target, self.fan_in, self.files = spark, target, fan_in, Folder(spark, path)
        self.path = self.files.path
        for d in ("manifests", "segments"):
            self.files.make(d)

    def versions(self) -> list[int]:
        """Numbers of the committed versions that are kept, rising."""
        return [int(n[1:-5]) for n in self.files.names("manifests") if n.startswith("v") and n.endswith(".json")]

    def version(self) -> int:
        """The newest committed version; 0 is the empty store."""
        return max(self.versions(), default=0)

    def _name(self, version: int) -> str:
        return f"manifests/v{version:010d}.json"

    def head(self, version: int | None = None) -> Manifest:
        """A version's manifest, or the newest."""
        version = self.version() if version is None else version
        if not version:
            return Manifest()
        found = self.files.load(self._name(version))
        return Manifest(tuple((p, n) for p, n in found["segments"]), found["schema"])

    def _shards(self, segments) -> list[Shard]:
        return [Shard(**s) for path, _ in segments for s in self.files.load(path)]

    def manifest(self, version: int | None = None) -> list[Shard]:
        """Shards of a version, or of the newest."""
        return self._shards(self.head(version).segments)

    def schema(self, version: int | None = None) -> T.StructType:
        """Columns of a version."""
        found = self.head(version).schema
        return T.StructType.fromJson(json.loads(found)) if found else T.StructType()

    def _commit(self, manifest: Manifest, after: int) -> int:
        """Make ``manifest`` the version that follows ``after``; Conflict if another writer made it first."""
        self.files.publish(self._name(after + 1), {"segments": manifest.segments, "schema": manifest.schema})
        return after + 1

    def _update(self, change: Callable[[Manifest], Manifest | None]) -> int:
        """Commit what ``change`` makes of the newest version, anew for each version that another writer puts in between; None is no change."""
        while True:
            after = self.version()
            new = change(self.head(after))
            if new is None:
                return after
            try:
                return self._commit(new, after)
            except Conflict:
                continue

    def _segment(self, shards: list[Shard]) -> tuple[tuple[str, int], ...]:
        if not shards:
            return ()
        path = f"segments/{uuid.uuid4().hex}.json"
        self.files.save(path, [asdict(s) for s in shards])
        return ((path, len(shards)),)

    def _joined(self, segments: tuple[tuple[str, int], ...]) -> tuple[tuple[str, int], ...]:
        """Segments of like length merged once there are ``fan_in`` of them."""
        tiers: dict[int, list[tuple[str, int]]] = {}
        for s in segments:
            tiers.setdefault(int(math.log(max(s[1], 1), self.fan_in)), []).append(s)
        for own in tiers.values():
            if len(own) >= self.fan_in:
                return self._joined(tuple(s for s in segments if s not in own) + self._segment(self._shards(own)))
        return segments

    def tier_of(self, size: int) -> int:
        """Tier of a shard of so many bytes; each is ``fan_in`` times the one before."""
        return max(0, math.floor(math.log(max(size, 1) / (64 << 10), self.fan_in)))

    def _folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def _listed(self, folder: str, schema: T.StructType) -> list[Shard]:
        """One shard a file of a folder just written; as many rows as its job had tasks with rows."""
        rows = self.spark.read.schema(schema).parquet(folder)
        files = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))
        return [Shard(r.path, r.size, r.rows, self.tier_of(r.size)) for r in files.orderBy("path").collect()]

    def append(self, arrival: DataFrame) -> int:
        """Write an arrival as shards of its own, as it is partitioned, and commit them."""
        merged_schema(self.schema(), arrival.schema)
        folder = self._folder()
        arrival.write.parquet(folder)
        own = self._segment(self._listed(folder, arrival.schema))

        def change(old: Manifest) -> Manifest:
            known = T.StructType.fromJson(json.loads(old.schema)) if old.schema else None
            return Manifest(self._joined(old.segments + own), merged_schema(known, arrival.schema).json())

        return self._update(change)

    def _groups(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: of each tier with ``fan_in`` shards or more, as many as fill the target."""
        out, tiers = [], {}
        for s in shards:
            if s.bytes < self.target * 3 // 4:
                tiers.setdefault(s.tier, []).append(s)
        for _, own in sorted(tiers.items()):
            if len(own) < self.fan_in:
                continue
            run, size = [], 0
            for s in sorted(own, key=lambda s: (s.bytes, s.path)):
                if run and size + s.bytes > self.target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            out.append(run)
        return [g for g in out if len(g) > 1]

    def compact(self) -> int:
        """Merge until no tier has a run to merge; every wave of merges is a version."""
        while groups := self._groups(self.manifest())[:WAVE]:
            schema, folder = self.schema(), self._folder()
            merged = None
            for own in groups:
                one = self.spark.read.schema(schema).parquet(*[s.path for s in own]).coalesce(1)
                merged = one if merged is None else merged.unionByName(one)
            merged.write.parquet(folder)
            gone, new = {s.path for own in groups for s in own}, self._listed(folder, schema)

            def change(old: Manifest) -> Manifest | None:
                held = [(s, self._shards([s])) for s in old.segments]
                if not gone <= {x.path for _, own in held for x in own}:
                    return None  # another writer has merged some of them: what was written here is not used
                kept = tuple(s for s, own in held if not any(x.path in gone for x in own))
                rest = [x for s, own in held if s not in kept for x in own if x.path not in gone]
                return Manifest(self._joined(kept + self._segment(rest + new)), old.schema)

            self._update(change)
        return self.version()

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions before the newest ``keep``, and the shards and segments that only they name; how many shards were deleted.

        Files that no version ever named, of a writer that failed or is still
        at work, stay.
        """
        every = self.versions()
        old, new = every[:-keep], every[-keep:]
        heads = {v: self.head(v) for v in every}
        kept = {s for v in new for s in heads[v].segments}
        gone = {s for v in old for s in heads[v].segments} - kept
        paths = {s.path for s in self._shards(gone)} - ({s.path for s in self._shards(kept)} if gone else set())
        done = sum(bool(self.files.fs.delete(self.files.at(p, whole=True), False)) for p in paths)
        for p in [self._name(v) for v in old] + [p for p, _ in gone]:
            self.files.delete(p)
        return done

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """All rows of a version; with ``shard``, a column of that name has the path of each row's shard."""
        shards, schema = self.manifest(version), self.schema(version)
        if shard and shard.lower() in (n.lower() for n in schema.names):
            raise ValueError(f"rows have a column {shard} of their own")
        if not shards:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn(shard, F.lit(None).cast("string")) if shard else rows
        rows = self.spark.read.schema(schema).parquet(*[s.path for s in shards])
        return rows.withColumn(shard, F.col("_metadata.file_path")) if shard else rows


def ingest(docs: DataFrame, path: str, arrivals: int = 3, target: int = TARGET_BYTES) -> ShardStore:
    """Append ``docs`` in ``arrivals`` rounds of unequal size, compacting after each."""
    store = ShardStore(docs.sparkSession, path, target)
    place = F.pmod(F.xxhash64(*docs.columns), F.lit(1 << arrivals))
    for k in range(arrivals):  # a half, a quarter, ... and the rest
        low, high = (1 << arrivals) - (1 << (arrivals - k)), (1 << arrivals) - (1 << (arrivals - k - 1))
        last = k == arrivals - 1
        store.append(docs.filter((place >= low) & (F.lit(last) | (place < high))))
        store.compact()
        store.vacuum()
    return store


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ingested, compacted and read back through the manifest: doc_id, n_bytes, text_md5."""
    store = ingest(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "shards"))
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


ORACLE = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents"
