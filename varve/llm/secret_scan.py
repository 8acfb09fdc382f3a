"""Secret scan: fixed patterns and character Markov models, native operators only.

Base spans are matches of three patterns.  The method adds ``random`` spans:
runs of 12 characters or more outside base spans whose log-likelihood under a
Markov model of random strings exceeds that under one of ordinary identifiers
by a margin.  Both models are counts of character pairs from labelled samples.
Random: the secrets of all base matches, and strings drawn from the usual
alphabets of keys (``GENERATED`` of each).  Ordinary: identifiers in the usual
styles, one made of the first four plain words in a row of every document, the
others of words common in names (``GENERATED`` sets).

A text is matched and a token scored in time linear in its length, however long
it is.  Null and empty texts have no spans; an empty table gives no rows.
Repeated rows get the same result each; extra columns are ignored, whatever
their names.  Spans count code points, ends are exclusive.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run is matched whole, so a least length in the pattern drops just the matches that are too short
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Characters of the models, and the tokens that they score: whole runs of this many or more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}"
# plain words one after the other
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}(?: [A-Za-z]{2,}){3}(?![A-Za-z0-9+/_=-])"
#: Log-likelihood ratio (nats) in all and per character from which a token is a secret.
MARGIN, PER_CHARACTER = 12.0, 0.8
#: Labelled samples: random strings drawn from each alphabet, and sets of common words; of a document its first ORDINARY match.
GENERATED = 4000

#: Words common in names of programs, files and settings.
COMMON = (
    "access action active application argument average balance binary block buffer build cache callback change channel client cluster "
    "command comment component config container content control convert create current database date delete description dictionary "
    "directory download element enable encoding entity error example exception expected export factory feature filter format general "
    "global handler header identifier image index input instance integer internal iterator length library limit list location machine "
    "maximum memory method model network number operation option output package parent partition path payment permission position "
    "process product project property provider public random record region register remote request response result sample schedule "
    "scope search security select server service setting shared source special start status string structure support system target "
    "template test thread total transaction transform type update upload validate value vector version visible warning worker write"
).split()

_MATCH = "struct<kind:string,i:int,gap:int,size:int,value:string>"


def _matches(text: Column, kind: str, pattern: str, cheap: Column, value: int = 0) -> Column:
    """Array of (kind, i, gap before, match, value): all matches of a pattern in order."""
    once = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")))  # a value of a lambda, so that neither runs twice
    taken = lambda m: F.regexp_extract(m, pattern, value) if value else m
    one = lambda own, m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(own["g"], i)).alias("gap"), F.length(m).alias("size"), taken(m).alias("value"))
    rows = F.flatten(F.transform(once, lambda own: F.transform(own["m"], lambda m, i: one(own, m, i))))
    return F.when(cheap, rows).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of _matches with start and end, one for each distinct document."""
    rows = rows.dropDuplicates(["doc_id", "h", "kind", "i"])
    running = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(running)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def base_matches(docs: DataFrame) -> DataFrame:
    """Every base match before its length test, a ``plain`` row for each sample identifier, and a ``row`` row for every document."""
    text = F.col("text")
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("size"), value.alias("value"))
    words = F.filter(F.split(F.regexp_extract(text, ORDINARY, 0), " "), lambda w: w != "")
    every = F.concat(
        F.array(one("row", F.lit(""))).cast(f"array<{_MATCH}>"),
        F.transform(F.flatten(F.transform(F.array(words), _identifiers)), lambda w: one("plain", w)).cast(f"array<{_MATCH}>"),
        _matches(text, "assign", ASSIGN, text.rlike(r"(?i)pass|secret|token|api_?key"), 2),
        _matches(text, "access", ACCESS, text.contains("AKIA")),
        _matches(text, "hex", HEX, text.rlike(HEX)),
    )
    return _keyed(docs).select("doc_id", "h", F.explode(every).alias("x")).select("doc_id", "h", "x.*")


def _identifiers(words: Column) -> Column:
    """The first of an array of words, and a name made of them in one of the usual styles: snake, kebab, camel, path, upper case, numbered, dated."""
    drawn = F.pmod(F.xxhash64(F.array_join(words, " ")), F.lit(2_000_000_000))
    number, time = (drawn % 2100).cast("string"), F.date_format(F.timestamp_seconds(drawn), "yyyy-MM-dd'T'HH-mm-ss")
    styles = [
        F.lower(F.array_join(words, "_")),
        F.lower(F.array_join(words, "-")),
        F.replace(F.initcap(F.array_join(words, " ")), F.lit(" ")),
        F.lower(F.array_join(words, "/")),
        F.upper(F.array_join(words, "_")),
        F.concat(F.lower(F.array_join(F.slice(words, 1, 2), "_")), F.lit("_"), number),
        F.concat(F.lower(F.array_join(F.slice(words, 3, 2), "")), F.substr(number, F.lit(1), F.lit(2))),
        F.concat(F.lower(F.array_join(F.slice(words, 1, 2), "/")), F.lit("/"), F.substr(time, F.lit(1), F.lit(10))),
        time,
    ]
    own = reduce(lambda c, k: c.when(drawn % len(styles) == k, styles[k]), range(1, len(styles)), F.when(drawn % len(styles) == 0, styles[0]))
    return F.when(F.size(words) > 0, F.array(F.get(words, F.lit(0)), own)).otherwise(F.array().cast("array<string>"))


def generated(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """``n`` random strings (value) of each usual alphabet, always the same ones."""
    drawn = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(drawn("a")))
    alphabets = [
        F.rtrim(F.regexp_replace(base64, "=", "")),
        F.translate(F.regexp_replace(base64, "=", ""), "+/", "-_"),
        F.regexp_replace(base64, "[+/=]", ""),
        F.substr(drawn("h"), F.lit(1), F.lit(40)),
        F.upper(F.substr(drawn("u"), F.lit(1), F.lit(40))),
        F.concat(*[F.conv(F.substr(drawn("k"), F.lit(1 + 12 * i), F.lit(12)), 16, 36) for i in range(4)]),
        F.lower(F.concat(*[F.conv(F.substr(drawn("l"), F.lit(1 + 12 * i), F.lit(12)), 16, 36) for i in range(4)])),
    ]
    return spark.range(n).select(F.explode(F.array(*alphabets)).alias("value"))


def common(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """Identifiers (value) of ``n`` sets of common words, always the same ones."""
    words = F.array(*[F.element_at(F.split(F.lit(" ".join(COMMON)), " "), F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(COMMON))).cast("int") + 1) for k in range(4)])
    return spark.range(n).select(words.alias("words")).select(F.explode(_identifiers(F.col("words"))).alias("value"))


def pair_counts(samples: DataFrame) -> DataFrame:
    """(label, pair, n) of adjacent characters of samples (label, value), over ALPHABET."""
    letters = _letters(F.regexp_replace("value", "[^A-Za-z0-9+/_=-]", ""))
    pairs = F.zip_with(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return samples.select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def _letters(token: Column) -> Column:
    """A string's characters, each once, in one pass."""
    return F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0))


def train(samples: DataFrame, backoff: float = 4.0) -> np.ndarray:
    """Log-likelihood ratio of each character pair, random (label 1) over ordinary (label 0).

    Pairs back off to the share of their second character.  What comes to the driver has a row at most for each label and pair.
    """
    size = len(ALPHABET)
    counts = np.zeros((2, size, size))
    for r in pair_counts(samples).collect():
        counts[r.label, ALPHABET.index(r.pair[0]), ALPHABET.index(r.pair[1])] += r.n
    single = counts.sum(axis=1, keepdims=True) + 0.1
    single /= single.sum(axis=2, keepdims=True)
    chance = np.log((counts + backoff * single) / (counts.sum(axis=2, keepdims=True) + backoff))
    return chance[1] - chance[0]


def ratio(token: Column, model: np.ndarray) -> Column:
    """Log-likelihood ratio of a token over ALPHABET, in one pass over its characters."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model.ravel())), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"))

    def step(state: Column, letter: Column) -> Column:
        place = F.instr(F.lit(ALPHABET), letter) - 1
        return F.struct(place.alias("last"), (state["total"] + F.when(state["last"] >= 0, F.get(table, state["last"] * len(ALPHABET) + place)).otherwise(0.0)).alias("total"))

    return F.aggregate(_letters(token), start, step, lambda state: state["total"])


def _random(token: Column, model: np.ndarray) -> Column:
    return ratio(token, model) >= F.greatest(F.lit(MARGIN), F.length(token) * PER_CHARACTER)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, h (hash of its text) and found, the sorted spans (start, rank of kind, end)."""
    matches = written(base_matches(docs), "base-matches")
    base = _placed(matches.filter(F.col("kind").isin(*KINDS)))
    base = base.filter((F.col("kind") != "assign") | (F.length("value") >= 12))
    base = written(base.select("doc_id", "h", "kind", "start", "end", "value"), "base-spans")
    seen = base.select(F.when(F.col("kind") == "access", F.substr("value", F.lit(5))).otherwise(F.col("value")).alias("value"))
    random = seen.unionByName(generated(docs.sparkSession)).select(F.lit(1).alias("label"), "value")
    ordinary = matches.filter("kind = 'plain'").select("value").unionByName(common(docs.sparkSession)).select(F.lit(0).alias("label"), "value")
    model = train(random.unionByName(ordinary))

    tokens = F.regexp_extract_all("text", F.lit(LONG), F.lit(0))
    keyed = _keyed(docs).filter(F.exists(tokens, lambda t: _random(t, model)))
    cand = keyed.select("doc_id", "h", F.explode(_matches(F.col("text"), "random", LONG, F.lit(True))).alias("x")).select("doc_id", "h", "x.*")
    cand = written(_placed(cand).filter(_random(F.col("value"), model)).select("doc_id", "h", "kind", "start", "end", "value"), "random-tokens")

    # of the added spans those that no base span overlaps
    key = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    is_base = F.col("kind") != "random"
    both = base.unionByName(cand)
    both = both.withColumn("past", F.max(F.when(is_base, F.col("end"))).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("next", F.min(F.when(is_base, F.col("start"))).over(key.rowsBetween(0, Window.unboundedFollowing)))
    free = (F.coalesce("past", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    kept = both.filter(is_base | free)
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    found = kept.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), rank.alias("rank"), F.col("end")))).alias("found"))
    rows = matches.filter("kind = 'row'").select("doc_id", "h")
    found = found.withColumnRenamed("doc_id", "f_id").withColumnRenamed("h", "f_h")
    joined = rows.join(found, (rows["h"] == found["f_h"]) & rows["doc_id"].eqNullSafe(found["f_id"]), "left")
    return joined.select("doc_id", "h", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced (spans that overlap by one mark), and ``n_chars`` (if there) counted anew."""
    found = secret_spans(docs).filter(F.size("found") > 0).dropDuplicates(["doc_id", "h"])
    spans = found.select("doc_id", "h", F.explode("found").alias("s")).select("doc_id", "h", "s.start", "s.end")
    order = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    past = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") < F.col("past"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = spans.withColumn("past", past).withColumn("run", run).groupBy("doc_id", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("_varve_id"), F.col("h").alias("_varve_h"), F.col("runs").alias("_varve_runs"))

    def piece(own: Column, start: Column, end: Column) -> Column:
        # four bytes a code point, so that a place is found without walking through the text
        return F.decode(F.substr(own["wide"], (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int")), "UTF-32")

    def joined(own: Column) -> Column:
        before = F.transform(own["runs"], lambda s, i: piece(own, F.coalesce(F.get(own["runs"], i - 1)["end"], F.lit(0).cast("long")), s["start"]))
        last = F.element_at(own["runs"], -1)["end"]
        return F.concat(F.array_join(before, mark), F.lit(mark), piece(own, last, F.octet_length(own["wide"]) / 4))

    rows = docs.join(runs, (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_varve_h")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_varve_id")), "left")
    own = F.array(F.struct(F.encode("text", "UTF-32").alias("wide"), F.col("_varve_runs").alias("runs")))
    hit = F.col("_varve_runs").isNotNull()
    rows = rows.withColumn("text", F.when(hit, F.get(F.transform(own, joined), F.lit(0))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def _of_kind(k: int):
    return lambda s: s["rank"] == k


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["rank"] < 3)
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
