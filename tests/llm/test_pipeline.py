"""The pipeline's stages, each against what its operator decides."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from varve.llm import decontam, ngram_join, secret_scan

DATA = os.environ.get("VARVE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
    ids = {k: {r.doc_id for r in v.select("doc_id").distinct().collect()} for k, v in seen.items()}
    assert all(seen[k].columns == columns for k in list(seen)[:-1])
    same = ngram_join.near_components(seen["quality"])
    assert ids["near_duplicates"] == {r.doc_id for r in same.filter("component_id = doc_id").collect()}
    hit = decontam.contamination(seen["near_duplicates"], spark.read.parquet(f"{DATA}/benchmark.parquet")).filter("contaminated")
    assert ids["decontamination"] == ids["near_duplicates"] - {r.doc_id for r in hit.collect()}
    assert ids["secrets"] == ids["decontamination"] == ids["packing"]
    assert secret_scan.secret_spans(seen["secrets"]).filter(F.size("found") > 0).isEmpty()
    assert len(ids["quality"]) > 0.7 * spark.read.parquet(f"{DATA}/documents.parquet").count()


def word_sets(text):
    return {tuple(w[k : k + 5]) for w in [(text or "").lower().split()] for k in range(max(1, len(w) - 4)) if w}


def brute(rows, labels, items):
    """The pipeline's kept rows in plain Python but for the classifier's scores: (doc_id, text) with secrets replaced."""
    import re

    rows = [(d, t) for d, t in rows if labels.get(d, 1)]
    groups = []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = word_sets(t)
        same = [g for g in groups if own and any(w and 10 * len(own & w) >= 8 * len(own | w) for w in g["sets"])]
        if same:  # the first of them holds the smallest id
            same[0]["sets"] += [own, *(w for g in same[1:] for w in g["sets"])]
            groups = [g for g in groups if g not in same[1:]]
        else:
            groups.append({"sets": [own], "keep": (d, t)})
    kept = [g["keep"] for g in groups]
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    windows = {tuple(w[k : k + 10]) for t in items for w in [split(t)] if w for k in range(max(1, len(w) - 9))}
    clean = [(d, t) for d, t in kept if not any(tuple(w[k : k + len(x)]) == x for w in [split(t)] for x in windows for k in range(len(w) - len(x) + 1))]
    secret = re.compile(r"""token = "[0-9a-f]{40}|token = [0-9a-f]{40}""")
    return sorted(((d, None if t is None else secret.sub("[SECRET]", t)) for d, t in clean), key=str)


@pytest.fixture()
def odd_tables(spark, tmp_path):
    """Null, empty, repeated and near-repeated rows, benchmark passages, secrets, extra columns with the operators' names."""
    import random

    rng = random.Random(6)
    pool = [f"{a}{b}" for a in ("red", "blue", "tall", "wide", "old", "new") for b in ("house", "river", "stone", "field", "cloud")]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    base = [text(60) for _ in range(12)]
    items = [text(14), text(14)]
    rows = [(i, t) for i, t in enumerate(base)] + [(i, t) for i, t in enumerate(base[:3])]
    rows += [(20, " ".join(["new", *base[4].split()[1:]])), (21, base[5]), (30, f"{text(9)} {items[0]} {text(9)}"), (31, f"{text(20)} token = {'0123456789abcdef' * 2}01234567 {text(5)}")]
    rows += [(40, None), (40, None), (41, ""), (None, text(30)), (None, base[6]), (42, text(9000))]
    bad = [(50 + i, "BUY!!! $$$ WIN " * 12) for i in range(40)]
    good = [(100 + i, text(50)) for i in range(40)]
    rows += bad + good
    schema = "doc_id long, text string, lang string, h int, slot string, top int, n_chars long"
    spark.createDataFrame([(d, t, "en", 1, "s", 2, len(t or "")) for d, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = {**{d: 0 for d, _ in bad}, **{d: 1 for d, _ in good}, **{d: 1 for d in range(12)}}
    spark.createDataFrame([(d, q, 0) for d, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, {d: 0 for d, _ in bad}, items


def test_pipeline_of_odd_rows_equals_brute_force(spark, odd_tables):
    path, rows, bad, items = odd_tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert docs.columns == columns, name
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == brute(rows, bad, items)
    assert all(r.n_chars == len(r.text or "") for r in docs.collect())
    packed = pipeline.run(spark, path).collect()
    assert sorted({r.doc_id for r in packed}, key=str) == sorted({d for d, _ in got}, key=str)


def test_pipeline_of_an_empty_table(spark, odd_tables, tmp_path):
    path = str(tmp_path / "none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_tables[0]}/{t}.parquet").filter("false").write.parquet(f"{path}/{t}.parquet")
    assert pipeline.run(spark, path).isEmpty()


def test_driver_drops_what_is_done(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(ngram_join, "tidy", lambda session: calls.append(session))
    texts = ["one two three four five six seven eight"] * 3 + ["nine ten eleven twelve thirteen fourteen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.representatives(docs).collect()) == [0, 3]
    assert len(calls) >= 4
