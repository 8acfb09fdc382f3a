"""Work in a global or per-scope order without gathering it in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Values that cut a column into ranges, at most, and how many are sampled for each.
CUTS, SAMPLED = 256, 8


def numbered(df: DataFrame, order: list[Column | str], name: str = "n", count: Column | None = None) -> DataFrame:
    """``df`` with ``name``: how many rows (for which ``count`` holds) come before in the order ``order``.

    Rows are range-partitioned, sorted and written once; only one total for
    each partition is summed up.  ``order`` must tell rows apart as far as the
    numbers matter.
    """
    flag = F.lit(1) if count is None else count.cast("int")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_flag", flag)
    ranged = written(ranged).withColumn("_part", F.shiftright("_id", 33))
    totals = ranged.groupBy("_part").agg(F.sum("_flag").alias("_sum"))
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    if count is None:
        within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    else:
        within = F.coalesce(F.sum("_flag").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(before, "_part").withColumn(name, (F.col("_before") + F.col("_within")).cast("bigint")).select(*df.columns, name)


def replayed(df: DataFrame, scope: str, order: list[str], columns: list[str], schema: str, step: Callable) -> DataFrame:
    """A fold in order within each scope, streamed: a task holds a batch and its scope's state, never a scope's rows.

    ``step(None)`` gives a scope's first state; ``step(state, row, last)``
    returns rows of ``schema`` for a row (a tuple of ``columns``), ``last``
    being true for the scope's last one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [p.split()[0] for p in schema.split(",")]
        waiting, own, state = None, None, None
        for rows in batches:
            out: list[tuple] = []
            for key, *row in zip(rows[scope], *[rows[c] for c in columns]):
                if waiting is not None:
                    out += step(state, waiting, key != own)
                if waiting is None or key != own:
                    own, state = key, step(None, None, False)
                waiting = tuple(row)
            yield pd.DataFrame(out, columns=names, dtype=object)
        if waiting is not None:
            yield pd.DataFrame(step(state, waiting, True), columns=names, dtype=object)

    picked = df.select(*dict.fromkeys([scope, *order, *columns]))
    return picked.repartition(scope).sortWithinPartitions(scope, *order).mapInPandas(run, schema)


def cuts(df: DataFrame, column: str) -> list:
    """At most CUTS values, sorted, that cut a column into ranges of about as many rows; any type that orders."""
    sample = df.select(column).filter(F.col(column).isNotNull()).orderBy(F.xxhash64(column), column).limit(CUTS * SAMPLED)
    values = sorted(r[0] for r in sample.collect())
    return [bytearray(v) if isinstance(v, (bytes, bytearray)) else v for v in dict.fromkeys(bytes(v) if isinstance(v, bytearray) else v for v in values[::SAMPLED])]


def range_of(column: Column, at: list) -> Column:
    """Number of the range that a value lies in: how many of the sorted cuts ``at`` are not above it."""
    return F.lit(0) if not at else F.size(F.filter(F.array(*[F.lit(x) for x in at]), lambda x: x <= column))
