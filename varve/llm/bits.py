"""A set of 64-bit tokens as a table of fixed size, to drop rows before a shuffle.

The table has at most ``FILTER_ROWS`` rows of 64 bits (16 bytes a row with its
number), whatever the size of the set, so it may always be broadcast.  It lets
all members through and some others, which the join that follows drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_ROWS = 1 << 18


def bit_table(tokens: DataFrame) -> DataFrame:
    """The set of ``token`` as (row, bits)."""
    bit = F.expr("shiftleft(1L, cast(shiftright(token, 40) & 63 as int))")
    return tokens.groupBy(F.col("token").bitwiseAND(F.lit(FILTER_ROWS - 1)).alias("row")).agg(F.bit_or(bit).alias("bits"))


def filtered(places: DataFrame, bits: DataFrame, marked: bool = False) -> DataFrame:
    """Rows whose ``token`` may be in the table; with ``marked``, those with at < 0 too."""
    row = F.col("token").bitwiseAND(F.lit(FILTER_ROWS - 1))
    if marked:
        row = F.when(F.col("at") >= 0, row)
    joined = places.withColumn("row", row).join(F.broadcast(bits), "row", "left" if marked else "inner")
    hit = F.getbit("bits", F.expr("cast(shiftright(token, 40) & 63 as int)")) == 1
    return joined.filter((F.col("at") < 0) | F.coalesce(hit, F.lit(False)) if marked else hit).drop("row", "bits")
