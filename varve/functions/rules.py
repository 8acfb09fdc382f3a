"""Declarative validation: rules as Columns that are null where a value is valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(c: Column) -> Column:
    """Neither null nor empty."""
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit("required"))


def at_least(c: Column, n: float) -> Column:
    """A number of n or more."""
    return F.when(c < n, F.lit(f"less than {n}"))


def at_most(c: Column, n: float) -> Column:
    """A number of n or less."""
    return F.when(c > n, F.lit(f"more than {n}"))


def positive(c: Column) -> Column:
    """A number above 0."""
    return F.when(c <= 0, F.lit("not positive"))


def length_between(c: Column, least: int, most: int | None = None) -> Column:
    """A string of so many characters."""
    n = F.length(c)
    return F.when(n < least, F.lit("too short")).when((n > most) if most is not None else F.lit(False), F.lit("too long"))


def item_length_between(c: Column, least: int, most: int) -> Column:
    """An array whose strings have so many characters each."""
    return F.when(F.exists(c, lambda x: (F.length(x) < least) | (F.length(x) > most)), F.lit("item of wrong length"))


def items_between(c: Column, least: int, most: int | None = None) -> Column:
    """An array or map of so many items."""
    n = F.size(c)
    return F.when(n < least, F.lit("too few items")).when((n > most) if most is not None else F.lit(False), F.lit("too many items"))


def one_of(c: Column, values: list) -> Column:
    """One of a set of values."""
    return F.when(~c.isin(*values), F.lit("unknown value"))


def path_exists(path: str, wanted: bool = True) -> str | None:
    """Why a path on the driver is not valid, None if it is: it must be there, or must not."""
    import os

    return None if os.path.exists(path) == wanted else ("does not exist" if wanted else "exists")


def port(c: Column) -> Column:
    """A port number."""
    return F.when(~c.between(1, 65535), F.lit("not a port"))


def violations(df: DataFrame, rules: dict[str, list[Column]]) -> DataFrame:
    """Rows that break a rule, with ``errors``: ``name: why`` for each."""
    found = [F.concat(F.lit(f"{name}: "), rule) for name, own in rules.items() for rule in own]
    return df.withColumn("errors", F.array_compact(F.array(*found))).filter(F.size("errors") > 0)


def all_valid(rules: list[Column]) -> Column:
    """True where every rule holds."""
    return reduce(lambda a, b: a & b, [r.isNull() for r in rules], F.lit(True))
