"""Exact top-k inner-product search by pivot-table elimination.

Distances to ``PIVOTS`` fixed pivots are computed once for every vector and
stored beside it.  For a query, the largest difference of its own and a
vector's pivot distances is a lower bound of their distance, and so an upper
bound of their inner product, (|q|^2 + |x|^2 - bound^2) / 2.  Vectors are
evaluated in the order of their bounds until no bound reaches the k-th best
score found, which is exact.

Queries come in blocks of at most ``BLOCK`` vectors, and each block meets all
vectors in parallel.  A task keeps the k best that it has seen of each query
of the block, whose scores eliminate later vectors, and gives them at its end.

Components are floor(1024 x) as integers.  Vectors that are null, or hold a
null or non-finite component, take no part; shorter ones count as padded with
zeros.  Every row is a query or candidate of its own: repeated ids and repeated
rows count each, and only the query's own row is not its candidate.  A query's
ties go to the smaller vec_id.  An empty table gives no rows; other columns are
ignored.  Components have no bound of their own; one that is no 64-bit integer
is an error, and so is such a score among a query's best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import arrow_map, fresh_path, written

PIVOTS = 24
#: Queries that are sent to all tasks at once; their bytes are bounded by this and the dimension.
BLOCK = 4096
_TASK_ROWS = 8192


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as arrays of long."""
    def scaled_up(x: Column) -> Column:
        y = x.cast("double") * 1024
        return F.when((y >= -(2.0**63)) & (y < 2.0**63), F.floor(y)).otherwise(F.raise_error(F.lit("embedding component out of 64 bits")).cast("long"))

    scaled = F.transform("embedding", scaled_up)
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return table.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<long>").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _pivots(width: int) -> np.ndarray:
    """Fixed directions, scaled to the size of unit vectors."""
    p = np.random.default_rng(11).normal(size=(PIVOTS, width))
    return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9) * 1024


def distances(x: np.ndarray) -> np.ndarray:
    """The pivot table: distance of each row to each pivot."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in _pivots(x.shape[1])], axis=1)


class Best:
    """The k best of each of a block of queries among all vectors offered so far."""

    def __init__(self, q: np.ndarray, q_rows: np.ndarray, q_table: np.ndarray, k: int):
        self.q, self.q_rows, self.table, self.k = q, q_rows, q_table, k
        self.integers, self.norm, self.most = q.astype(np.int64), (q**2).sum(1), np.abs(q).max(axis=1, initial=0.0)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        self.evaluated = 0

    def offer(self, x: np.ndarray, x_ids: np.ndarray, x_rows: np.ndarray, x_table: np.ndarray, step: int = 256) -> None:
        """Values are integers in float64; products are summed in int64, or as Python's integers where that could overflow."""
        x_norm, xi, x_most = (x**2).sum(1), x.astype(np.int64), np.abs(x).max(axis=1, initial=0.0)
        for j in range(len(self.q)):
            lower = np.abs(x_table[:, 0] - self.table[j, 0])
            for p in range(1, x_table.shape[1]):
                np.maximum(lower, np.abs(x_table[:, p] - self.table[j, p]), out=lower)
            lower = np.maximum(lower * (1 - 1e-9) - 1e-6, 0)
            upper = (self.norm[j] + x_norm - lower**2) / 2
            upper += 1 + 1e-9 * (self.norm[j] + x_norm)
            upper[x_rows == self.q_rows[j]] = -np.inf
            scores, ids = self.scores[j], self.ids[j]
            worst = float(scores[-1]) if len(scores) == self.k else -np.inf
            left = np.flatnonzero((upper >= worst) & (upper > -np.inf))
            if not len(left):
                continue
            order = left[np.argsort(-upper[left], kind="stable")]
            wide = x_most * self.most[j] * x.shape[1] >= 2.0**62
            if wide[left].any():
                scores = scores.astype(object)
            exact = scores.dtype
            for at in range(0, len(order), step):
                some = order[at : at + step]
                some = some[upper[some] >= worst]
                if not len(some):
                    break
                self.evaluated += len(some)
                products = (xi[some] @ self.integers[j]).astype(exact)
                for i in np.flatnonzero(wide[some]):
                    products[i] = sum(a * b for a, b in zip(xi[some[i]].tolist(), self.integers[j].tolist()))
                scores, ids = np.concatenate([scores, products]), np.concatenate([ids, x_ids[some]])
                top = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]) if exact == object else np.lexsort((ids, -scores))[: self.k]
                scores, ids = scores[top], ids[top]
                if len(top) == self.k:
                    worst = float(scores[-1])
            self.scores[j], self.ids[j] = scores, ids


def pivot_table(table: DataFrame) -> DataFrame:
    """Written once: vec_id, slot (a distinct number of the row), v and far, its distances to the pivots."""
    vectors = integer_vectors(table).withColumn("slot", F.monotonically_increasing_id())
    width = integer_vectors(table).agg(F.max(F.size("v"))).collect()[0][0] or 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(_matrix(batch.column(2), width)) if len(batch) else np.zeros((0, PIVOTS))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), PIVOTS).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, lists], names=["vec_id", "slot", "v", "far"])

    return written(vectors.select("vec_id", "slot", "v").transform(arrow_map, measure, "vec_id long, slot long, v array<long>, far array<double>"), "pivot-table")


def _against(vectors: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """The k best of each query of a block in each task: query_id, query_slot, vec_id, score."""
    ids, slots = (queries.column(c).to_numpy() for c in ("vec_id", "slot"))
    lists = queries.column("v").combine_chunks()
    own_width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
    block, far = _matrix(lists, own_width), _matrix(queries.column("far").combine_chunks(), PIVOTS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        held: list[pa.RecordBatch] = []

        def take() -> None:
            nonlocal best
            rows = pa.Table.from_batches(held).combine_chunks()
            v = rows.column("v").combine_chunks()
            width = max(own_width, int(np.diff(v.offsets.to_numpy()).max(initial=0)))
            if best is None or best.q.shape[1] < width:
                q = np.pad(block, ((0, 0), (0, width - own_width)))
                fresh = Best(q, slots, far, k)
                if best is not None:
                    fresh.scores, fresh.ids = best.scores, best.ids
                best = fresh
            best.offer(_matrix(v, best.q.shape[1]), rows.column("vec_id").to_numpy(), rows.column("slot").to_numpy(), _matrix(rows.column("far").combine_chunks(), PIVOTS))

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= _TASK_ROWS:
                take()
                held = []
        if sum(len(b) for b in held):
            take()
        if best is not None:
            n = [len(s) for s in best.scores]
            yield pa.record_batch(
                [
                    pa.array(np.repeat(ids, n), pa.int64()),
                    pa.array(np.repeat(slots, n), pa.int64()),
                    pa.array(np.concatenate(best.ids), pa.int64()),
                    pa.array([s for own in best.scores for s in own.tolist()], pa.int64()),
                ],
                names=["query_id", "query_slot", "vec_id", "score"],
            )

    return vectors.transform(arrow_map, search, "query_id long, query_slot long, vec_id long, score long")


def top_k(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row that is a query."""
    spark = table.sparkSession
    vectors = pivot_table(table)
    asked = vectors.filter(is_query)
    blocks = max(1, -(-asked.count() // (BLOCK // 2)))
    path = fresh_path(spark, "queries")  # a folder a block, so that a block is read alone
    asked.withColumn("block", F.pmod(F.xxhash64("slot"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in vectors.schema)}, block int"
    queries = spark.read.schema(schema).parquet(path)
    parts = []
    for b in range(blocks):  # half the bound on average; a larger block is cut
        own = queries.filter(F.col("block") == b).drop("block").toArrow()
        for at in range(0, max(own.num_rows, 1), BLOCK):
            parts.append(written(_best(_against(vectors, own.slice(at, BLOCK), k), k), "found"))
    return _best(reduce(DataFrame.unionByName, parts), k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_slot").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "query_slot", "vec_id", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS slot, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.slot, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.slot <> c.slot WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
