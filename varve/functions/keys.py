"""Key encodings, hashes and renderings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be32(x: Column) -> Column:
    """An unsigned 32-bit integer, big-endian."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 8, "0"))


def _from_be32(x: Column) -> Column:
    return F.conv(F.hex(x), 16, 10).cast("bigint")


def vertex_key(kind: Column, value: Column) -> Column:
    """type, length of value, value: orders by type, then length, then bytes."""
    value = value.cast("binary")
    return F.concat(be32(kind), be32(F.octet_length(value)), value)


def edge_key(head: Column, kind: Column, tail: Column) -> Column:
    """head's vertex key, edge type, tail's vertex key: a vertex's edges directly follow it."""
    return F.concat(head, be32(kind), tail)


def _sub(key: Column, at: Column, n: Column) -> Column:
    return F.substr(key, (at + 1).cast("int"), n.cast("int"))


def _vertex_at(key: Column, at: Column) -> tuple[Column, Column, Column]:
    """(type, value, end) of the vertex key that begins at ``at``; the length is null where it can't be."""
    size = _from_be32(_sub(key, at + 4, F.lit(4)))
    size = F.when((F.octet_length(key) - at >= 9) & (size > 0) & (at + 8 + size <= F.octet_length(key)), size)
    return _from_be32(_sub(key, at, F.lit(4))), _sub(key, at + 8, size), at + 8 + size


def decode_vertex(key: Column) -> Column:
    """struct(type, value), or null for a key that is short, padded or has a wrong length."""
    kind, value, end = _vertex_at(key, F.lit(0))
    return F.when(end == F.octet_length(key), F.struct(kind.alias("type"), value.alias("value")))


def decode_edge(key: Column) -> Column:
    """struct(head, type, tail), or null for a corrupt key."""
    head, head_value, middle = _vertex_at(key, F.lit(0))
    tail, tail_value, end = _vertex_at(key, middle + 4)
    return F.when(
        end == F.octet_length(key),
        F.struct(
            F.struct(head.alias("type"), head_value.alias("value")).alias("head"),
            _from_be32(_sub(key, middle, F.lit(4))).alias("type"),
            F.struct(tail.alias("type"), tail_value.alias("value")).alias("tail"),
        ),
    )


def base64_url(x: Column) -> Column:
    """Base64 in the URL alphabet, without padding."""
    return F.translate(F.rtrim(F.regexp_replace(F.base64(x), r"[=\s]", "")), "+/", "-_")


def etag(items: Column) -> Column:
    """Order-free tag of an array of strings: SHA-256 of its sorted items."""
    return base64_url(F.unhex(F.sha2(F.array_join(F.array_sort(items), "").cast("binary"), 256)))


def bucket(key: Column, n: int) -> Column:
    """Layout bucket of a key by the engine's own hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


#: The value whose XXH64 with the engine's own seed is 0, so that what is hashed after it is hashed with seed 0.
_TO_SEED_0 = -365884300664092260


def xxh64(key: Column) -> Column:
    """XXH64 of bytes with seed 0, as a signed long."""
    return F.xxhash64(F.lit(_TO_SEED_0).cast("bigint"), key.cast("binary"))


def partition_id(key: Column, n: int) -> Column:
    """``xxh64(key, seed 0) mod n``, the hash taken as unsigned; null for a null key."""
    h = xxh64(key)
    half = F.shiftrightunsigned(h, 1)
    return F.when(key.isNotNull(), ((half % n) * 2 + h.bitwiseAND(F.lit(1).cast("bigint"))) % n)


def byte_size(text: str) -> int:
    """``128MB`` as bytes."""
    text = text.strip().upper()
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        if text.endswith(unit):
            return int(float(text[:-2]) * 1024**k)
    return int(text.removesuffix("B"))
