"""Personal data: fixed patterns and bootstrapped contextual extraction.

Base spans are the matches of four patterns that pass their tests.  They are
the seeds of the bootstrap.  Lexical patterns are what stands around a seed:
the two words before it, the two after it, or one on each side; words are
whatever stands between white space, lower-cased, and of any length.  Text of a
looser form of the same kind is an instance.  Spark scores the graph of
patterns and instances in rounds: a pattern by the share of its distinct
instances that are known, an instance by the patterns that it stands in.
Patterns of high confidence give the spans that the fixed patterns miss.

Patterns and instances of more than ``WHOLE`` characters are compared by a
128-bit hash of the whole, so that long words are never cut and rows stay small.
Null and empty texts have no spans, very long ones are scanned whole in linear
time; an empty table gives no rows.  Every row has a result of its own, repeated
ones too, though repeated rows lend a pattern no support twice; extra columns
are ignored, whatever their names.  Spans count code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import arrow_map, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser forms of the kinds of digits, which only a trusted pattern turns into spans; e-mail's is in ``_loose_emails``.
LOOSE = {
    1: re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[.-][0-9]{1,4}){3,5}(?![0-9.])"),
    2: re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,19}(?![0-9])"),
    3: re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])"),
}
_WORD, _RUN = re.compile(r"\S+"), re.compile(r"[^@<>()\s]+")
#: Characters up to which a pattern or an instance is kept as it is.
WHOLE = 100
#: A pattern is trusted from so many distinct known instances and this share of them on.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3


def _emails(text: str) -> list[tuple[int, int]]:
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = past + len(text[past:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            past = m.end()
        else:
            past = at + 1
        at = text.find("@", past)
    return out


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if first := _DIGIT.search(text):
        at = first.start()
        # a match begins at the first digit of a run or not at all, so a failing run is passed whole
        for m in _IP.finditer(text, at):
            if all(_small(p) for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, at):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _loose_emails(text: str) -> list[tuple[int, int]]:
    """Two runs of characters around an @, leftmost first."""
    out, last = [], None
    for m in _RUN.finditer(text):
        if last is not None and m.start() == last[1] + 1 and text[last[1]] == "@":
            out.append((last[0], m.end()))
            last = None
        else:
            last = m.span()
    return out


def key_of(text: str) -> str:
    """The text, or a hash that stands for a long one."""
    return text if len(text) <= WHOLE else hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def patterns_at(text: str, starts: list[int], ends: list[int], start: int, end: int) -> list[str]:
    """Patterns around a span, given where the text's words start and end."""
    left = bisect_right(ends, start)  # words that end at the span's start or before
    right = bisect_left(starts, end)
    word = lambda i: text[starts[i] : ends[i]].lower()
    out = []
    if left >= 2:
        out.append(f"{word(left - 2)} {word(left - 1)} _")
    if right + 1 < len(starts):
        out.append(f"_ {word(right)} {word(right + 1)}")
    if left >= 1 and right < len(starts):
        out.append(f"{word(left - 1)} _ {word(right)}")
    return [key_of(p) for p in out]


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and looser instances with their patterns; looser ones overlap no base span."""
    digits = _DIGIT.search(text)
    if not base and "@" not in text and not digits:
        return []
    found = [(s, k, e, True) for s, k, e in base]
    # base spans of one kind never overlap, so of any place the four before it are enough
    taken = sorted((s, e) for s, _, e in base)
    begins = [s for s, _ in taken]
    loose = [(k, m.span()) for k, form in LOOSE.items() for m in form.finditer(text)] if digits else []
    for k, (s, e) in [*((0, x) for x in (_loose_emails(text) if "@" in text else [])), *loose]:
        near = bisect_left(begins, e)
        if not any(a < e and s < b for a, b in taken[max(0, near - len(KINDS)) : near]):
            found.append((s, k, e, False))
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    return [
        {"kind": k, "start": s, "end": e, "pattern": p, "instance": key_of(text[s:e].lower()), "known": known}
        for s, k, e, known in found
        for p in patterns_at(text, starts, ends, s, e)
    ]


_OCC = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("instance", pa.string()), ("known", pa.bool_())]))
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def _scan(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() << 36
        for batch in batches:
            base, occ = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text) if text else []
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                occ.append(occurrences(text, own) if text else [])
            n = len(base)
            yield pa.record_batch([batch.column(0), pa.array(range(slot, slot + n), pa.int64()), pa.array(base, _BASE), pa.array(occ, _OCC)], names=["doc_id", "slot", "base", "occ"])
            slot += n

    schema = "doc_id long, slot long, base array<struct<start:long,kind:int,end:long>>, occ array<struct<kind:int,start:long,end:long,pattern:string,instance:string,known:boolean>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(arrow_map, scan, schema)


def trusted_patterns(found: DataFrame) -> DataFrame:
    """(kind, pattern) to trust, from occurrences (kind, pattern, instance, known).

    A pattern's score is the mean score of its distinct instances; it is kept
    from SUPPORT (their sum) and CONFIDENCE on.  An instance's is 1 if known,
    else one minus the product of (1 - 0.9 score) over its kept patterns.
    """
    graph = written(found.groupBy("kind", "pattern", "instance").agg(F.max("known").alias("known")), "pattern-graph")
    score = graph.groupBy("kind", "instance").agg(F.max(F.col("known").cast("double")).alias("score"))
    patterns = None
    for _ in range(ROUNDS):
        linked = graph.join(score, ["kind", "instance"])
        patterns = linked.groupBy("kind", "pattern").agg(F.sum("score").alias("support"), F.avg("score").alias("share"))
        patterns = written(patterns.filter((F.col("support") >= SUPPORT) & (F.col("share") >= CONFIDENCE)), "patterns")
        # an instance is unknown only if none of its patterns is right
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("share") * 0.9, F.lit(1e-6)))))
        fresh = graph.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - doubt).alias("new_score"))
        score = graph.groupBy("kind", "instance").agg(F.max(F.col("known").cast("double")).alias("old")).join(fresh, ["kind", "instance"], "left")
        score = written(score.select("kind", "instance", F.greatest("old", F.coalesce("new_score", F.lit(0.0))).alias("score")), "instance-scores")
    return patterns.select("kind", "pattern")


def personal_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, base and added, both sorted arrays of (start, kind, end)."""
    scanned = written(_scan(docs), "pii-scan")
    found = scanned.select("slot", F.explode("occ").alias("o")).select("slot", "o.*")
    fresh = found.filter(~F.col("known")).join(trusted_patterns(found), ["kind", "pattern"])
    added = fresh.groupBy("slot").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return scanned.select("doc_id", "slot", "base").join(added, "slot", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    out = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
