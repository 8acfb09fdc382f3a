"""Token ids as equal-length sequences in Arrow stream files.

Each file is an Arrow IPC stream of record batches with two fixed-size-list
columns, ``ids`` and ``mask`` (true where an id belongs to a document).  Every
batch but a file's last has ``BATCH`` sequences, so sequence ``k`` of a file is
row ``k % BATCH`` of batch ``k // BATCH`` without any search, and a
memory-mapped file is read without copying (``TokenFile``).  A file ends with
the document that takes it to ``FILE_TOKENS`` ids or ``FILE_DOCUMENTS``
documents, so files stay of one size however the table is partitioned.  A
Parquet index has one row per document.

Null texts are empty texts (one end id), very long ones are encoded whole.
Documents are ordered by doc_id, null ids first, repeated ids by a hash of the
text, repeated rows in any order; an empty table gives no files and no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .session import arrow_map, fresh_path, written

#: Sequences in a record batch.
BATCH = 256
#: A file ends with the document that takes it to so many ids or documents.
FILE_TOKENS, FILE_DOCUMENTS = 1 << 26, 1 << 19


def file_system(path: str):
    """(file system, path in it) of a local path or URI, as pyarrow opens it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str, vocabulary: str, length: int, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        kind = pa.from_numpy_dtype(enc.dtype)
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        part, end = TaskContext.get().partitionId() << 24, np.array([end_id], enc.dtype).tobytes()
        system, inside = file_system(folder)
        step, width = BATCH * length * enc.dtype.itemsize, enc.dtype.itemsize
        full_mask = pa.FixedSizeListArray.from_arrays(pa.array(np.ones(BATCH * length, bool)), length)
        name = sink = out = None
        held, at, documents = bytearray(), 0, 0

        def put(data: bytes) -> None:
            n = len(data) // width
            rows = -(-n // length)
            ids = np.frombuffer(data, enc.dtype)
            if n < rows * length:
                ids = np.concatenate([ids, np.zeros(rows * length - n, enc.dtype)])
            mask = full_mask if n == BATCH * length else pa.FixedSizeListArray.from_arrays(pa.array(np.arange(rows * length) < n), length)
            out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), mask], schema=schema))

        def finish() -> None:
            nonlocal part, name, held, at, documents
            if held:
                put(bytes(held))
            out.close()
            sink.close()
            part, name, held, at, documents = part + 1, None, bytearray(), 0, 0

        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for k in range(0, len(texts), 16):  # few enough for their chunks to stay in the cache
                for ids in enc.many(texts[k : k + 16]):
                    if name is None:
                        name = f"part-{part:012d}-{uuid.uuid4().hex}.arrows"
                        system.create_dir(inside, recursive=True)
                        sink = system.open_output_stream(f"{inside}/{name}")
                        out = pa.ipc.new_stream(sink, schema)
                    n = len(ids) // width + 1
                    rows.append((part, name, at, n))
                    held += ids
                    held += end
                    at, documents = at + n, documents + 1
                    if len(held) >= step:
                        full = len(held) // step * step
                        for s in range(0, full, step):
                            put(bytes(held[s : s + step]))
                        del held[:full]
                    if at >= FILE_TOKENS or documents >= FILE_DOCUMENTS:
                        finish()
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "part", "file", "at", "n_tokens"])
        if name is not None:
            finish()

    return write


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into ``folder``; the index of what was written.

    The index has doc_id, file, at (first token in the file), n_tokens and
    start (ids of all documents before).  A retried task writes another file;
    the index names only the files of the tasks that counted.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    index = written(ordered.transform(arrow_map, _writer(folder, vocabulary, length, end_id), "doc_id long, part long, file string, at long, n_tokens long"), "token-index")
    # one row per file: a task's, and one more for each FILE_TOKENS ids or FILE_DOCUMENTS documents
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return index.join(files, "file").select("doc_id", "file", "at", "n_tokens", (F.col("before") + F.col("at")).alias("start"))


def _reader(folder: str, name: str) -> pa.RecordBatchReader:
    """A file's batches, mapped where the file is local and streamed where it is not."""
    from pyarrow import fs

    system, inside = file_system(folder)
    path = f"{inside}/{name}"
    return pa.ipc.open_stream(pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_stream(path))


class TokenFile:
    """Random access to the sequences and documents of one file; nothing is copied from a mapped file."""

    def __init__(self, folder: str, name: str):
        self.batches = list(_reader(folder, name))

    def __len__(self) -> int:
        return sum(map(len, self.batches))

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``k``, as views of the file (the mask's bits are packed, so it stays an Arrow array)."""
        batch, row = self.batches[k // BATCH], k % BATCH
        ids, mask = batch.column(0), batch.column(1)
        length = ids.type.list_size
        return ids.flatten()[row * length : (row + 1) * length].to_numpy(), mask.flatten()[row * length : (row + 1) * length]

    def document(self, at: int, n: int) -> np.ndarray:
        """Ids ``at`` to ``at + n`` of the file; a view where one batch has them all."""
        return read_ids([b.column(0).flatten().to_numpy() for b in self.batches], at, n)


def read_ids(chunks: list[np.ndarray], at: int, n: int) -> np.ndarray:
    """Ids ``at`` to ``at + n`` of a file's flattened batches; a view where one batch has them all."""
    size = len(chunks[0])
    first, last = at // size, (at + n - 1) // size
    found = [c[max(0, at - k * size) : at + n - k * size] for k, c in enumerate(chunks[first : last + 1], first)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def crc32s(batches: Iterator[np.ndarray], ends: np.ndarray) -> list[int]:
    """crc32 of each document's ids (as 32-bit integers), the documents ending at ``ends``; batches are taken one at a time."""
    out, crc, at, k = [], 0, 0, 0
    for ids in batches:
        wide, base = ids.astype("<u4"), at
        while k < len(ends) and ends[k] <= base + len(wide):
            out.append(zlib.crc32(wide[at - base : ends[k] - base], crc))
            crc, at, k = 0, int(ends[k]), k + 1
        if at < base + len(wide):
            crc, at = zlib.crc32(wide[at - base :], crc), base + len(wide)
    return out


def read_digests(index: DataFrame, folder: str) -> DataFrame:
    """Each document's ids read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        ids = (b.column(0).flatten().to_numpy() for b in _reader(folder, rows["file"].iloc[0]))
        return rows[["doc_id", "start", "n_tokens"]].assign(ids_crc32=crc32s(ids, (rows["at"] + rows["n_tokens"]).to_numpy()))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return index.groupBy("file").applyInPandas(read, schema)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(index, folder)
