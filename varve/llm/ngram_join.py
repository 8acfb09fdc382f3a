"""N-gram Jaccard join: grouped prefix join over word-shingle sets.

1.  Every document becomes its set of distinct 5-word shingles; equal sets are
    one class.  Counts of all shingles over all documents, folded into a fixed
    number of cells, order shingles from rare to common.
2.  Classes with the same prefix and the same size form a group.  Groups that
    share a prefix shingle and pass the size and positional bounds are
    candidate pairs.
3.  Group pairs are expanded to their classes; bounds by size and by parity
    signatures drop most that do not link, and whole sets verify the rest.

Candidates are taken in two rounds, so that a large group of near copies never
makes all its pairs.  The first links, under each shingle, neighbours by size
and all with a hub; the second takes every pair whose sides are still in
different components, met by shingle and size range.  A pair inside a component
cannot change it, so components are exact.

No task holds all places of a shingle or all members of a component: hubs,
counts and smallest ids are aggregates with map-side combine, and neighbours are
taken within splits of about ``SPLIT`` places.

Null and empty texts have no shingles and link with nothing; very long ones are
hashed whole.  Rows with equal sets link whatever their ids; a null id never
becomes a component id unless no other is there.  Repeated rows get a row each;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bits import bit_table, filtered
from .session import arrow_map, tidy, written
from .shingles import CELLS, least_difference, set_key, shingle_sets, signature

#: Bits of the fixed-size filter that keeps documents without candidates out of verification.
FILTER_BITS = 1 << 24
_CHUNKS = 64
#: Places of a shingle, or classes of a group, that are sorted together at most, about; larger ones are split by a hash.
SPLIT = 1024


def _fold(df: DataFrame, parts: Callable, combine: Callable, size: int) -> bytes:
    """A fixed-size byte string: ``parts`` gives each task's, in _CHUNKS pieces, and ``combine`` adds two."""
    step = size // _CHUNKS

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = parts(batches)
        if data is not None:
            yield pa.record_batch([pa.array(range(_CHUNKS), pa.int32()), pa.array([data[k * step : (k + 1) * step] for k in range(_CHUNKS)], pa.binary())], names=["chunk", "data"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in rows["data"]:
            total = data if total is None else combine(total, data)
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "data": [total]})

    schema = "chunk int, data binary"
    found = {r.chunk: bytes(r.data) for r in df.transform(arrow_map, local, schema).groupBy("chunk").applyInPandas(merge, schema).collect()}
    return b"".join(found.get(k, bytes(step)) for k in range(_CHUNKS))


def _cell_ranks(docs: DataFrame) -> np.ndarray:
    """Rank (12 bits, logarithmic) of each cell by the count of its shingles in all documents."""

    def parts(batches):
        counts = None
        for batch in batches:
            for tokens in _grouped(batch.column(0).to_pylist(), None):
                counts = np.zeros(CELLS, np.int64) if counts is None else counts
                np.add.at(counts, (tokens & np.uint64(CELLS - 1)).astype(np.int64), 1)
        return None if counts is None else counts.astype("<i8").tobytes()

    add = lambda a, b: (np.frombuffer(a, "<i8") + np.frombuffer(b, "<i8")).tobytes()
    counts = np.frombuffer(_fold(docs.select("text"), parts, add, CELLS * 8), "<i8")
    return np.minimum(4095, np.log2(1 + counts) * 170).astype(np.uint16)


def _grouped(texts: list[str | None], ranks: np.ndarray | None) -> Iterator[np.ndarray]:
    for k in range(0, len(texts), 512):
        yield from shingle_sets(texts[k : k + 512], ranks)


def _as_long(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64) ^ np.int64(-(1 << 63))  # keeps the order


def text_hash(docs: DataFrame) -> Column:
    """Hash of a row's text, null being empty."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _sets(docs: DataFrame, ranks: np.ndarray, tenths: int) -> DataFrame:
    """Per row: doc_id, h (hash of the text), n, class_key, group_key, the prefix and the signature (both only the first time a task sees the class)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, classes, groups, prefixes, signatures = [], [], [], [], []
            for tokens in _grouped(batch.column(1).to_pylist(), ranks):
                n = len(tokens)
                key = set_key(tokens) if n else 0
                prefix = tokens[: n - (n * tenths + 9) // 10 + 1] if n else tokens
                sizes.append(n)
                classes.append(key)
                groups.append(set_key(np.append(prefix, np.uint64(n))) if n else 0)
                if n and key not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    prefixes.append(_as_long(prefix))
                    signatures.append(signature(tokens))
                else:
                    prefixes.append(None)
                    signatures.append(None)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["doc_id", "h", "n", "class_key", "group_key", "prefix", "signature"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash(docs).alias("h"))
    return plain.transform(arrow_map, build, "doc_id long, h long, n long, class_key long, group_key long, prefix array<long>, signature binary")


def _plausible(pairs: DataFrame, classes: DataFrame, tenths: int) -> DataFrame:
    """Pairs whose sizes and signatures allow a link: sets that link differ in at most (10 - t) / (10 + t) of both sizes."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, n, x, m, y = (c.to_pylist() for c in batch.columns)
            ok = [(10 + tenths) * max(abs(i - j), least_difference(a, b)) <= (10 - tenths) * (i + j) for i, a, j, b in zip(n, x, m, y)]
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    for side in ("a", "b"):
        own = classes.select(F.col("class_key").alias(side), F.col("n").alias(f"n_{side}"), F.col("signature").alias(f"signature_{side}"))
        pairs = pairs.join(own, side)
    return pairs.select("a", "b", "n_a", "signature_a", "n_b", "signature_b").transform(arrow_map, keep, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, ranks: np.ndarray, tenths: int) -> DataFrame:
    """The pairs (a, b) of class keys whose whole sets link."""
    pairs = written(_plausible(pairs.distinct(), classes, tenths), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class_key")).distinct().join(classes, "class_key")
    needed = written(needed.select("class_key", "rep"), "needed")

    def parts(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            bits[ids.astype(np.int64) % FILTER_BITS] = True
        return np.packbits(bits).tobytes()

    either = lambda a, b: (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()
    folded = _fold(needed.filter(F.col("rep").isNotNull()).select("rep"), parts, either, FILTER_BITS // 8)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(folded, np.uint8)).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            keep = bits[ids.fill_null(0).to_numpy(zero_copy_only=False) % FILTER_BITS] | ids.is_null().to_numpy(zero_copy_only=False)
            texts = batch.column(1).filter(pa.array(keep)).to_pylist()
            out = {}
            for tokens in _grouped(texts, ranks):
                if len(tokens) and (key := set_key(tokens)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    out[key] = tokens.tobytes()
            yield pa.record_batch([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["class_key", "tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = plain.transform(arrow_map, gather, "class_key long, tokens binary").join(needed.select("class_key"), "class_key", "left_semi")
    sets = written(found.groupBy("class_key").agg(F.first("tokens").alias("tokens")), "sets")
    left = sets.select(F.col("class_key").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("class_key").alias("b"), F.col("tokens").alias("right"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(10 * shared >= tenths * (len(both) - shared))
            ok = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return written(joined.transform(arrow_map, verify, "a long, b long"), "links")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with one label for each connected component of ``edges`` (a, b).

    Every round gives a node the smallest of itself and its neighbours and
    contracts the edges; the nodes with edges at least halve.
    """
    labels = nodes.select("node", F.col("node").alias("label"))
    edges = edges.filter(F.col("a") != F.col("b"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("old"), F.least("a", "b").alias("new")), "parents")
        again = least.select(F.col("old").alias("new"), F.col("new").alias("newer"))
        least = least.join(again, "new", "left").select("old", F.coalesce("newer", "new").alias("new"))
        least = written(least, "parents")
        labels = labels.join(least, labels["label"] == least["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
        labels = written(labels, "labels")
        one = least.select(F.col("old").alias("a"), F.col("new").alias("x"))
        two = least.select(F.col("old").alias("b"), F.col("new").alias("y"))
        edges = edges.join(one, "a").join(two, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = written(edges, "edges")
    return labels


def _bounded(n1: Column, at1: Column, n2: Column, at2: Column, tenths: int) -> Column:
    """Size and positional bounds at the first prefix shingle that two sets share.

    Sets that link meet them there: they share nothing in front of that
    shingle, so at most what follows it in either.  A pair need not meet them
    at its other shared shingles, being found once is enough.
    """
    sizes = (F.least(n1, n2) * 10) >= (F.greatest(n1, n2) * tenths)
    # shared >= t / (1 + t) * (n1 + n2)
    return sizes & (F.least(n1 - at1, n2 - at2) * (10 + tenths) >= (n1 + n2) * tenths)


def _neighbours(shared: DataFrame, tenths: int) -> DataFrame:
    """Pairs (group_key, other) that share a shingle and meet the bounds there: each place with the one before it by size, and with its hub.

    The hub of a shingle and size class is the place nearest the front of its
    set: a set with few rare shingles of its own, that links with nearly all
    near copies that link with anything.
    """
    early = (F.col("n") - F.col("at")) * (10 + tenths) >= F.col("n") * (2 * tenths)
    place = F.struct("at", "n", "group_key")
    placed = shared.withColumns({"early": early, "class": F.floor(F.log(F.col("n")) * 9), "split": _split("places")})
    by_size = Window.partitionBy("token", "early", "split").orderBy("n", "group_key")
    hubs = placed.groupBy("token", "class").agg(F.min(place).alias("other"), F.first("places").alias("places"))
    hubs = hubs.select("token", "class", "other", F.explode(F.sequence(F.lit(0).cast("long"), _splits("places") - 1)).alias("split"))
    found = None
    for near in (placed.withColumn("other", F.lag(place).over(by_size)), placed.join(hubs, ["token", "class", "split"])):
        near = near.filter((F.col("other.group_key") != F.col("group_key")) & _bounded(F.col("n"), F.col("at"), F.col("other.n"), F.col("other.at"), tenths))
        near = near.select("group_key", F.col("other.group_key").alias("other"))
        found = near if found is None else found.union(near)
    return found.distinct()


def _split(count: str) -> Column:
    """Part of a shingle's places, or of a group's classes, that a group or class is sorted in."""
    key = "group_key" if count == "places" else "class_key"
    return F.pmod(F.xxhash64(key), _splits(count))


def _splits(count: str) -> Column:
    return F.ceil(F.col(count) / SPLIT).cast("long")


def _inside(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of one group: each with the one before it in its split, and with the group's smallest."""
    groups = classes.groupBy("group_key").agg(F.min("class_key").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    own = classes.select("group_key", "class_key").join(groups, "group_key").withColumn("split", _split("members"))
    chain = own.select(F.lag("class_key").over(Window.partitionBy("group_key", "split").orderBy("class_key")).alias("a"), F.col("class_key").alias("b")).filter("a is not null")
    return chain.union(own.select(F.col("hub").alias("a"), F.col("class_key").alias("b")).filter("a != b"))


def _components_of(docs: DataFrame, tenths: int, between: Callable[[], None] = lambda: None) -> DataFrame:
    """Per row of ``docs``: doc_id, h (hash of its text), n, best (doc_id and h of the row that stands for its component, null without shingles) and component_id.

    ``between`` is called whenever a part of the work is done.
    """
    ranks = _cell_ranks(docs)
    rows = written(_sets(docs, ranks, tenths), "shingle-sets")
    full = rows.filter("n > 0")
    classes = written(full.groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("best"), F.first("group_key").alias("group_key"), F.first("n").alias("n"), F.first("signature", ignorenulls=True).alias("signature")), "classes")
    nodes = classes.select(F.col("class_key").alias("node"))

    # places of shingles that several groups have
    places = full.filter("prefix is not null").select("n", "group_key", F.posexplode("prefix").alias("at", "token"))
    tokens = places.groupBy("token").agg(F.min("group_key").alias("low"), F.max("group_key").alias("high"), F.count("*").alias("places"))
    tokens = written(tokens.filter("low != high").select("token", "places"), "shared-tokens")
    bits = written(bit_table(tokens), "shared-bits")
    shared = written(filtered(places, bits).join(tokens, "token").select("n", "group_key", "at", "token", "places").distinct(), "shared-places")
    between()

    first = classes.groupBy("group_key").agg(F.min("class_key").alias("c"))
    near = _neighbours(shared, tenths)
    near = near.join(first.withColumnRenamed("c", "a"), "group_key").join(first.select(F.col("group_key").alias("other"), F.col("c").alias("b")), "other").select("a", "b")
    ordered = near.union(_inside(classes)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _verified(docs, ordered, classes, ranks, tenths)
    between()
    labels = components(nodes, links)
    between()

    # second round: whatever shares a prefix shingle (or a group) across components
    member = written(classes.join(labels, classes["class_key"] == labels["node"]).select("class_key", "group_key", "label"), "members")
    unit = member.select("group_key", "label").distinct()
    single = unit.groupBy("group_key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    at_token = shared.select("token", "group_key").join(single, "group_key")
    apart = at_token.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select("token")
    # sets that link have sizes in the same range or in neighbouring ones
    size_range = F.floor(F.log(F.col("n")) / F.lit(float(np.log(10 / tenths)) + 1e-9))
    mixed = shared.select("token", "n", "at", "group_key").join(apart, "token").join(unit, "group_key")
    mixed = written(mixed.withColumn("range", size_range), "mixed-places")
    other = mixed.select(F.col("token").alias("o_token"), *[F.col(c).alias(f"o_{c}") for c in ("n", "at", "group_key", "label")], F.explode(F.array(*[F.col("range") + d for d in (-1, 0, 1)])).alias("o_range"))
    crossing = mixed.join(other, (F.col("token") == F.col("o_token")) & (F.col("range") == F.col("o_range")) & (F.col("label") < F.col("o_label")) & _bounded(F.col("n"), F.col("at"), F.col("o_n"), F.col("o_at"), tenths))
    crossing = crossing.select("group_key", "label", "o_group_key", "o_label")
    own = unit.select("group_key", "label").join(unit.select("group_key", F.col("label").alias("o_label")), "group_key").filter("label < o_label")
    crossing = crossing.union(own.select("group_key", "label", F.col("group_key").alias("o_group_key"), "o_label")).distinct()
    expanded = crossing.join(member.withColumnRenamed("class_key", "a"), ["group_key", "label"]).join(
        member.select(F.col("class_key").alias("b"), F.col("group_key").alias("o_group_key"), F.col("label").alias("o_label")), ["o_group_key", "o_label"]
    )
    links = _verified(docs, expanded.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), classes, ranks, tenths)
    between()
    ends = [member.select(F.col("class_key").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b")]
    joined = links.join(ends[0], "a").join(ends[1], "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    tops = components(member.select(F.col("label").alias("node")).distinct(), written(joined, "label-links"))
    final = written(member.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label").select("class_key", "top"), "tops")
    smallest = classes.join(final, "class_key").groupBy("top").agg(F.min("best").alias("best"))
    out = rows.select("doc_id", "h", "n", "class_key").join(final.join(smallest, "top"), "class_key", "left")
    return out.select("doc_id", "h", "n", "best", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"))


def near_components(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id; linked from Jaccard tenths/10 on."""
    return _components_of(docs, tenths).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: one row of each.

    It is the one with the smallest id (a null id comes last), of rows with one
    id the one whose text has the smallest hash, and of rows that repeat both
    any one.  Rows without shingles stay.
    """
    rows = _components_of(docs, tenths, lambda: tidy(docs.sparkSession)).filter("best is not null")
    marked = rows.withColumn("stays", F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.h") == F.col("h")))
    marked = written(marked.groupBy("doc_id", "h", "stays").agg(F.count("*").alias("times")), "representatives")
    key = lambda df: df.select(F.col("doc_id").alias("_varve_id"), F.col("h").alias("_varve_h"))
    same = (text_hash(docs) == F.col("_varve_h")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_varve_id"))
    kept = docs.join(key(marked.filter("not stays")), same, "left_anti")
    again = marked.filter("stays and times > 1")
    if again.isEmpty():
        return kept
    single = kept.withColumn("_varve_row", text_hash(docs)).join(key(again), same, "left_semi").dropDuplicates(["doc_id", "_varve_row"])
    return kept.join(key(again), same, "left_anti").unionByName(single.drop("_varve_row"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at Jaccard 0.8 over 5-word shingles."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
