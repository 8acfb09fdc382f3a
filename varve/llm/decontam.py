"""Benchmark decontamination by a prefix-filtered set join, native operators only.

Every window of ``size`` item words (a shorter item is one window) is a set of
word shingles.  A document can hold a window only if it holds all its shingles,
so for exact containment one necessary prefix token is enough: the rarest of
the window's shingles, by counts over all documents.  Documents post the places
of prefix tokens only; candidates that the length and positional bounds leave
are verified word by word.

Texts are never shuffled.  Documents are read twice, to count the benchmark's
shingles and to post the places of prefix tokens with the few words around
them; both times a bit table of fixed size (``bits``, broadcast) drops nearly all other places before anything moves.  What it lets through is
joined by the token itself, however large the benchmark is.

Null and empty texts have no words, very long ones are taken whole.  Repeated
rows get a row each; repeated items count once; an item without an id gives
hits but no item.  Either table may be empty; extra columns are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bits import bit_table, filtered
from .session import written

#: Words in a prefix token.
SHINGLE = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    kept = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(kept)


def split_words(text: Column) -> Column:
    """Words between possibly empty first and last elements."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)


def _token(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct pairs of an item and a window: item_id, win (words), len, win_id (a 128-bit hash of the words)."""
    words = F.filter(split_words(F.col("text")), lambda w: w != "")
    items = benchmark.select(F.col("item_id"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    each = items.select("item_id", "words", F.explode(starts).alias("s")).select("item_id", F.slice("words", F.col("s"), size).alias("win"))
    return each.distinct().withColumn("len", F.size("win")).withColumn("win_id", F.md5(F.array_join("win", " ")))


def _places(docs: DataFrame, k: int, first: int = 0) -> DataFrame:
    """Every place ``at`` (from ``first``) of ``k`` words in a document, with its token and the document's words ``w``."""
    words = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), split_words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    if first == 0:
        words = words.filter(F.col("n") >= k)
    each = words.select("*", F.explode(F.sequence(F.lit(first), F.greatest(F.col("n") - k, F.lit(first)))).alias("at"))
    return each.withColumn("k", F.lit(k)).withColumn("token", _token(F.col("w"), F.greatest("at", F.lit(0)), k))


def counts(docs: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """token, k, df: how often the documents hold each of ``tokens`` (and, of others, some that the filter lets through)."""
    bits = written(bit_table(tokens), "token-bits")
    found = [filtered(_places(docs, k).select("at", "token", "k"), bits) for k in sizes]
    return reduce(DataFrame.unionByName, found).groupBy("token", "k").agg(F.count("*").alias("df"))


def postings(docs: DataFrame, tokens: DataFrame, size: int, sizes: list[int]) -> DataFrame:
    """Places that the filter of ``tokens`` lets through, and a row with at = -1 and the number of words for every document.

    ``context`` has the words around the place, from ``lo`` on, that any
    window with the token could take.
    """
    bits = written(bit_table(tokens), "prefix-bits")
    at, n, found = F.col("at"), F.col("n"), []
    for i, k in enumerate(sizes):
        near = filtered(_places(docs, k, 0 if i else -1), bits, marked=not i)
        lo = F.greatest(at - (size - k), F.lit(0))
        count = n - (F.get("w", F.lit(0)) == "").cast("int") - ((n > 1) & (F.get("w", n - 1) == "")).cast("int")
        found.append(near.select("doc_id", "h", "at", "k", "token", "n", lo.alias("lo"), F.when(at >= 0, F.slice("w", lo + 1, at - lo + size)).alias("context"), F.when(at < 0, count.cast("long")).alias("n_words")))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, h (hash of its text), n_words, n_hit, n_items, items_sha256, contaminated."""
    named = written(windows(benchmark, size), "windows").withColumn("k", F.least("len", F.lit(SHINGLE)))
    wins = named.select("win_id", "win", "len", "k").distinct()
    sizes = sorted((r.k for r in wins.select("k").distinct().collect()), reverse=True) or [SHINGLE]
    offsets = F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("off")
    parts = wins.select("win_id", "win", "len", "k", offsets)
    shingles = written(reduce(DataFrame.unionByName, [parts.filter(F.col("k") == k).withColumn("token", _token(F.col("win"), F.col("off"), k)) for k in sizes]), "shingles")

    # rarity over all documents; a window with an absent shingle occurs nowhere
    rarity = counts(docs, shingles.select("token"), sizes)
    ranked = shingles.join(rarity, ["token", "k"], "left").groupBy("win_id", "len").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "token", "k")).alias("rarest"), F.first("win").alias("win")
    )
    prefix = written(ranked.filter(F.col("rarest.df") > 0).select("win_id", "win", "len", "rarest.off", "rarest.token", "rarest.k"), "prefixes")
    post = written(postings(docs, prefix.select("token"), size, sizes), "postings")
    start = F.col("at") - F.col("off")
    found = (
        post.filter(F.col("at") >= 0)
        .join(prefix, ["token", "k"])
        .withColumn("start", start)
        .filter((F.col("start") >= F.col("lo")) & (F.col("start") + F.col("len") <= F.col("n")))
        .filter(F.slice("context", F.col("start") - F.col("lo") + 1, F.col("len")) == F.col("win"))
        .select("doc_id", "h", "start", "len", "win_id")
        .distinct()
    )
    found = written(found, "occurrences")
    key = ["doc_id", "h"]
    before = Window.partitionBy(*key).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    spans = found.select(*key, "start", "len").distinct().withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
    hits = spans.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered"))).alias("n_hit"))
    ids = named.filter(F.col("item_id").isNotNull()).select("win_id", F.col("item_id").cast("string").alias("item"))
    items = found.select(*key, "win_id").distinct().join(ids, "win_id").select(*key, "item").distinct()
    listed = items.groupBy(*key).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("listed"))
    rows = post.filter(F.col("at") < 0).select("doc_id", "h", "n_words")
    for side in (hits, listed):
        side = side.withColumnRenamed("doc_id", "side_id").withColumnRenamed("h", "side_h")
        rows = rows.join(side, (rows["h"] == side["side_h"]) & rows["doc_id"].eqNullSafe(side["side_id"]), "left").drop("side_id", "side_h")
    return rows.select(
        "doc_id",
        "h",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window."""
    hit = contamination(docs, benchmark, size).filter("contaminated").select(F.col("doc_id").alias("_varve_id"), F.col("h").alias("_varve_h")).distinct()
    same = (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_varve_h")) & docs["doc_id"].eqNullSafe(F.col("_varve_id"))
    return docs.join(hit, same, "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("h")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[s:s + 9] AS win, len(w[s:s + 9]) AS n FROM starts),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win ON p.n = win.n AND p.w[p.s:p.s + p.n - 1] = win.win),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
