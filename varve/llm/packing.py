"""Best-two-fit packing of documents into fixed-length training sequences.

A sequence is filled greedily with the longest piece that fits.  If a gap
stays, its smallest piece is replaced by the two unpacked pieces whose sum fits
the gap so widened most tightly, and that is repeated while it helps.  A piece
that is alone in its sequence is never replaced: it is the longest that is left
and would have to lie alone, or with what fits beside it, all the same.

Documents longer than a sequence are cut; the first piece takes the remainder
and the others fill a sequence each, however long the text is.  Null texts are
empty texts; repeated rows are packed as often as they stand, ties go in any
order; an empty table gives no rows; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHE_CHUNKS, encoder
from .session import arrow_map, written

#: Pieces packed together by one task; each group leaves at most a few sequences with a gap.
GROUP = 40_000


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths from 1 to ``size``."""
    stacks: dict[int, list[int]] = {}
    for k in np.argsort(lengths, kind="stable")[::-1].tolist():
        stacks.setdefault(int(lengths[k]), []).append(k)
    bits = back = 0  # lengths that are left, as bits; and reversed
    for n in stacks:
        bits |= 1 << n
        back |= 1 << (size - n)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> tuple[int, int]:
        nonlocal bits, back
        own = stacks[n]
        k = own.pop()
        if not own:
            bits &= ~(1 << n)
            back &= ~(1 << (size - n))
        return n, k

    def give(n: int, k: int) -> None:
        nonlocal bits, back
        stacks[n].append(k)
        bits |= 1 << n
        back |= 1 << (size - n)

    def pair(most: int, least: int) -> tuple[int, int] | None:
        for total in range(most, least, -1):
            found = bits & (back >> (size - total))
            if total % 2 == 0 and found >> (total // 2) & 1 and len(stacks[total // 2]) < 2:
                found &= ~(1 << (total // 2))
            if found:
                a = found.bit_length() - 1
                return a, total - a
        return None

    count = 0
    while bits:
        bin_, gap = [], size
        while fit := (bits & ((1 << (gap + 1)) - 1)).bit_length():
            bin_.append(take(fit - 1))
            gap -= fit - 1
        while gap and len(bin_) > 1:
            n, k = bin_[-1]  # pieces went in longest first
            if (two := pair(gap + n, n)) is None:
                break
            bin_.pop()
            bin_ += [take(two[0]), take(two[1])]
            give(n, k)
            gap += n - sum(two)
            bin_.sort(reverse=True)
        at = 0
        for n, k in bin_:
            sequence[k], offset[k] = count, at
            at += n
        count += 1
    return sequence, offset


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, keep: int = CACHE_CHUNKS) -> DataFrame:
    """One row per piece: doc_id, slot (any distinct number), piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary, keep)
        end, slot = np.array([end_id], "<u4"), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids_of, rows = batch.column(0).to_pylist(), []
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 16):  # few enough for their chunks to stay in the cache
                for doc, ids in zip(ids_of[k : k + 16], enc.many(texts[k : k + 16])):
                    all_ids = np.concatenate([np.frombuffer(ids, enc.dtype).astype("<u4"), end])
                    first = len(all_ids) % size or size
                    starts = [0, *range(first, len(all_ids), size)]
                    for p, (s, e) in enumerate(zip(starts, [*starts[1:], len(all_ids)])):
                        rows.append((doc, slot, p, s, e - s, zlib.crc32(all_ids[s:e].tobytes())))
                        slot += 1
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "slot", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.transform(arrow_map, cut, "doc_id long, slot long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """Rows with distinct ``slot`` and ``length``, with sequence_id and offset added.

    Rows go to groups of about ``group`` by a hash of their slot, so that no
    task sees more however long the table is.
    """
    groups = max(1, -(-rows.count() // group))
    columns = [c for c in rows.columns if c != "slot"]

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("slot", ignore_index=True)
        sequence, offset = best_two_fit(part["length"].to_numpy(), size)
        return part[columns].assign(sequence_id=(int(part["bucket"].iloc[0]) << 36) + sequence, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "slot")
    bucket = F.pmod(F.xxhash64("slot"), F.lit(groups)).alias("bucket")
    return rows.select("*", bucket).groupBy("bucket").applyInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, keep: int = CACHE_CHUNKS) -> DataFrame:
    """Cut, encode and pack whole documents; one row per piece.  ``keep`` bounds what a worker's encoder remembers."""
    return pack(written(pieces(docs, vocabulary, size, keep=keep), "pieces"), size)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
