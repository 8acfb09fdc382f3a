"""Training-data operators against brute force on hand-made rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varve.llm import bits, decontam, licenses, ngram_join, packing, pii, pivot_search, quality, secret_scan, shards, token_store
from varve.llm.bpe import encoder

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


def ids_of(text):
    return encoder(VOCABULARY).whole.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words(rng, n, pool=40):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    base = [words(rng, n) for n in (3, 5, 6, 60, 80, 200, 200)]
    near = base[5].split()
    near[100] = "changed"
    odd = [None, "", " \n\t ", "one", "É MIXED Case über", "a  b\n c \t d", "it's 12 x<|endoftext|>y", "日本語 🎉 a\0b", words(rng, 6000, 900)]
    return [*base, " ".join(near), base[3].upper(), *odd, base[3], base[3]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 4 else i // 2 * 2 if i in (2, 3) else i, t, "en", 7, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, n int, start double").cache()


def test_encoder_equals_the_library():
    e = encoder(VOCABULARY)
    tests = ["", " ", "  a", "a   b\n c \n\n  d\te", "we'll 'll ' s", "1 23a4 5_6__ 7", "  a 　 b", "a\x03b \x03", "\r\n \r\n x", "é̀ ñ", "x" * 300, "<|endoftext|>"]
    for t in tests:
        assert np.frombuffer(e.ids(t), e.dtype).tolist() == ids_of(t)[:-1], t


def test_token_store_round_trip(spark, docs, tmp_path):
    index = token_store.write_tokens(docs, str(tmp_path / "t"), VOCABULARY, length=16).cache()
    got = token_store.read_digests(index, str(tmp_path / "t")).orderBy("start").collect()
    assert len(got) == docs.count() and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    want = Counter((r.doc_id, len(ids_of(r.text)), crc(ids_of(r.text))) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    file = token_store.TokenFile(str(tmp_path / "t"), index.first().file)
    assert all(len(b) == token_store.BATCH for b in file.batches[:-1])
    own = index.filter(F.col("file") == index.first().file).orderBy("at").collect()
    masks = [file.sequence(k)[1] for k in range(len(file))]
    assert sum(sum(m.to_pylist()) for m in masks) == sum(r.n_tokens for r in own)
    flat = np.concatenate([file.sequence(k)[0] for k in range(len(file))])
    text = {(r.doc_id, len(ids_of(r.text)), crc(ids_of(r.text))) for r in docs.select("doc_id", "text").collect()}
    for r in own:
        ids = file.document(r.at, r.n_tokens)
        assert (ids == flat[r.at : r.at + r.n_tokens]).all() and (r.doc_id, len(ids), crc(ids.tolist())) in text
    # views of the mapped file: in its buffers, nothing allocated
    buffer, before = file.batches[0].column(0).flatten().buffers()[1], pa.total_allocated_bytes()
    ids, mask = file.sequence(0)
    assert buffer.address <= ids.ctypes.data < buffer.address + buffer.size and not ids.flags.writeable
    assert mask.buffers()[1].address == file.batches[0].column(1).flatten().buffers()[1].address and pa.total_allocated_bytes() == before
    assert token_store.read_digests(token_store.write_tokens(docs.filter("false"), str(tmp_path / "e"), VOCABULARY), str(tmp_path / "e")).isEmpty()


def test_token_files_are_rolled(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BATCH", 2)
    monkeypatch.setattr(token_store, "FILE_TOKENS", 300)
    want = Counter((r.doc_id, len(ids_of(r.text)), crc(ids_of(r.text))) for r in docs.select("doc_id", "text").collect())
    for limit in (3, 1000):
        monkeypatch.setattr(token_store, "FILE_DOCUMENTS", limit)
        folder = str(tmp_path / str(limit))
        index = token_store.write_tokens(docs, folder, VOCABULARY, length=16)
        got = token_store.read_digests(index, folder).orderBy("start").collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
        assert max(r.n for r in index.groupBy("file").agg(F.count("*").alias("n")).collect()) <= limit


def test_other_vocabularies_go_through_the_library(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    plain = Tokenizer.from_file(VOCABULARY)
    texts = ["Some  TEXT it's 12\n x", "", None, "É a\x03b"]
    for change in ("normalizer", "prefix", "model"):
        other = Tokenizer.from_file(VOCABULARY)
        if change == "normalizer":
            other.normalizer = normalizers.Lowercase()
        elif change == "prefix":
            other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
        else:
            other = Tokenizer(models.WordLevel({"Some": 0, "TEXT": 1, "?": 2}, unk_token="?"))
            other.pre_tokenizer = pre_tokenizers.Whitespace()
        other.save(str(tmp_path / change))
        e = encoder(str(tmp_path / change))
        assert not e.fast
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.many(texts)] == [other.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoder(VOCABULARY).fast and plain.get_vocab_size() == encoder(VOCABULARY).whole.get_vocab_size()


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def component_labels(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def brute_components(rows):
    label, group = component_labels(rows), {}
    for i, (d, _) in enumerate(rows):
        group.setdefault(label[i], []).append(d)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in group.items()}
    return Counter((d, len(shingle_set(t)), smallest[label[i]]) for i, (d, t) in enumerate(rows))


def test_ngram_join(spark, docs, texts):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seed = words(rng, 70, 500).split()
    for k in range(60):  # a chain of near copies, some linked, some just not
        seed = [*seed]
        seed[rng.randrange(70)] = f"n{k}"
        rows.append((100 + k, " ".join(seed)))
    common = words(rng, 30, 400)
    rows += [(300 + k, common + " " + words(rng, 40, 3000)) for k in range(40)]  # a shared passage
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.near_components(df).collect())
    assert got == brute_components(rows)
    assert ngram_join.near_components(df.filter("false")).isEmpty()
    kept = Counter((r.doc_id, r.text) for r in ngram_join.representatives(df.withColumn("n", F.lit(1)).withColumn("top", F.lit("t"))).collect())
    assert kept == brute_representatives(rows)


def brute_representatives(rows):
    """One row of each component: that with the smallest id, null last; any of several texts under one id."""
    label = component_labels(rows)
    out, seen = Counter(), {}
    for i, (d, t) in enumerate(rows):
        if not shingle_set(t):
            out[d, t] += 1
        else:
            seen.setdefault(label[i], []).append((d is None, d or 0, xxh(t), d, t))
    out.update(min(own, key=lambda x: x[:3])[3:] for own in seen.values())
    return out


def xxh(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_representatives_of_repeated_rows(spark):
    rng = random.Random(21)
    one, two = words(rng, 30, 500), words(rng, 30, 500)
    near = " ".join(["new", *one.split()[1:]])
    rows = [(5, one), (5, one), (5, two), (2, near), (9, two), (9, two), (None, two), (None, words(rng, 9, 90)), (None, "a b"), (None, "a b"), (7, None), (7, None), (7, ""), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("stays", F.lit(True))
    got = ngram_join.representatives(df)
    assert got.columns == df.columns and Counter((r.doc_id, r.text) for r in got.collect()) == brute_representatives(rows)
    assert ngram_join.representatives(df.filter("false")).isEmpty()


def test_ngram_join_of_hot_shingles(spark, monkeypatch):
    """Shingles in a third of all documents, a large group of near copies, and splits of few places."""
    monkeypatch.setattr(ngram_join, "SPLIT", 8)
    rng = random.Random(22)
    shared, copy = words(rng, 40, 900), words(rng, 60, 900).split()
    rows = [(i, words(rng, 50, 4000)) for i in range(120)]
    rows += [(200 + i, shared + " " + words(rng, rng.choice([3, 8, 9, 10, 30]), 4000)) for i in range(100)]
    for i in range(100):  # copies that differ in up to three places
        own = [*copy]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"z{rng.randrange(50)}"
        rows.append((400 + i, " ".join(own)))
    rows += [(600 + i, " ".join(copy)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in ngram_join.near_components(df).collect()) == brute_components(rows)


def best_ten(rows):
    """Each query row's ten best, as a sorted list of (query, [(vec_id, score), ...])."""
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(ok):
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(ok) if m != n)[:10]
            out.append((q, [(i, -x) for x, i in s]))
    return sorted(out)


def found_ten(found):
    """The result as best_ten's; a repeated query's rows are told apart by rank, its results being the same multiset."""
    by = {}
    for r in found.orderBy("query_id", "rank", "vec_id").collect():
        by.setdefault(r.query_id, {}).setdefault(r.rank, []).append((r.vec_id, r.score))
    return by


def test_pivot_search(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3]) for i in range(330)]
    rows += [(400 + i, rows[7][1]) for i in range(15)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (600, [0.5] * 3), (7, rows[7][1]), (None, rows[3][1])]
    rows += [(700, rows[5][1])] * 3 + [(800, rows[9][1]), (800, rows[11][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("far", F.lit(2))
    want = {}
    for q, own in best_ten(rows):
        for rank, x in enumerate(own, 1):
            want.setdefault(q, {}).setdefault(rank, []).append(x)
    got = found_ten(pivot_search.top_k(df, F.col("vec_id") % 100 == 0))
    assert {q: {r: sorted(x) for r, x in own.items()} for q, own in got.items()} == {q: {r: sorted(x) for r, x in own.items()} for q, own in want.items()}
    assert len(got[700][1]) == 3 and len(got[800][10]) == 2
    assert pivot_search.top_k(df.filter("false"), F.col("vec_id") % 100 == 0).isEmpty()
    assert pivot_search.top_k(df.limit(1), F.col("vec_id") % 100 == 0).isEmpty()
    x = np.round(rng.normal(size=(4000, 8)) * 300)
    best = pivot_search.Best(x[:3], np.arange(3), pivot_search.distances(x[:3]), 10)
    best.offer(x, np.arange(4000), np.arange(4000), pivot_search.distances(x))
    assert best.evaluated < 3 * 4000  # bounds do eliminate


def test_pivot_search_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(i * 25, [float(x) for x in rng.normal(size=5)]) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found_ten(pivot_search.top_k(df, F.col("vec_id") % 100 == 0))
    assert sorted((q, [own[r][0] for r in range(1, 11)]) for q, own in got.items()) == best_ten(rows)


def test_pivot_search_of_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(250)]
    rows += [(300, [40000.0, -3e5, 2.5, 1e6]), (301, [1e6, 1e6, -1e6, 2e6]), (302, [-4e5] * 4), (400, [2.0**20, 2.0**20, 1.0, 0.0]), (401, [2.0**20, -(2.0**20), 3.0, 0.0]), (402, [-(2.0**38), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found_ten(pivot_search.top_k(df, F.col("vec_id") % 100 == 0))
    assert sorted((q, [own[r][0] for r in range(1, 11)]) for q, own in got.items()) == best_ten(rows)
    with pytest.raises(Exception, match="(?i)overflow|too large|out of"):
        pivot_search.top_k(df.union(spark.createDataFrame([(403, [2.0**40] * 4)], df.schema)), F.col("vec_id") == 400).collect()


def test_shards(spark, docs, tmp_path):
    rows = docs.select("doc_id", "text", "h").withColumn("shard", F.lit("own"))
    store = shards.ShardStore(spark, str(tmp_path / "s"), target=1 << 20)
    assert store.read().isEmpty() and store.compact() == 0 == store.vacuum()
    for k in range(5):
        store.append(rows.withColumn("arrival", F.lit(k)))
    before = store.version()
    assert len(store.manifest()) >= 5 and len(store.head().segments) < 5
    store.compact()
    assert len(store.manifest()) == 1 and store.read().count() == 5 * rows.count() == store.read(before).count()
    with pytest.raises(shards.Conflict):
        store._commit(shards.Manifest(), before)
    assert store.vacuum() >= 5 and store.vacuum() == 0 and store.versions() == [store.version()]
    want = Counter((r.doc_id, r.text, r.h, "own", k) for r in rows.collect() for k in range(5))
    assert Counter(tuple(r) for r in store.read().collect()) == want
    with pytest.raises(ValueError):
        store.read(shard="Shard")
    assert store.read(shard="file").select("file").distinct().count() == 1


def test_shards_keep_new_columns_and_refuse_other_types(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    for k in range(4):
        store.append(spark.createDataFrame([(k, None if k else "x" * 100_000)], "a long, text string"))
    store.append(spark.createDataFrame([], "a long, later double"))
    for k in range(4, 8):
        store.append(spark.createDataFrame([("e", k)], "extra string, A long"))
    want = Counter([(k, None if k else "x" * 100_000, None, None) for k in range(4)] + [(k, None, None, "e") for k in range(4, 8)])
    for _ in range(2):
        assert store.read().columns == ["a", "text", "later", "extra"] and Counter(tuple(r) for r in store.read().collect()) == want
        store.compact()
        store.vacuum()
    version = store.version()
    with pytest.raises(shards.SchemaConflict):
        store.append(spark.createDataFrame([("x",)], "a string"))
    assert store.version() == version and store.append(spark.createDataFrame([], "a long")) == version + 1


def test_shards_of_racing_writers(spark, tmp_path):
    one, two = (shards.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    one.append(spark.createDataFrame([(0,)], "a long"))
    after, publish, done = one.version(), one.files.publish, []

    def second_first(name, value):  # the other writer publishes when this one is about to
        if not done:
            done.append(two.append(spark.createDataFrame([(2,)], "a long")))
        publish(name, value)

    one.files.publish = second_first
    assert one.append(spark.createDataFrame([(1,)], "a long")) == after + 2 and done == [after + 1]
    assert sorted(r.a for r in one.read(after + 1).collect()) == [0, 2]
    for k in (3, 4, 5):
        two.append(spark.createDataFrame([(k,)], "a long"))
    done.clear()
    listed, took = one._listed, []

    def second_merges(folder, schema):  # the other writer merges the same shards meanwhile
        if not took:
            took.append(two.compact())
        return listed(folder, schema)

    one._listed = second_merges
    one.compact()
    assert took and sorted(r.a for r in two.read().collect()) == [0, 1, 2, 3, 4, 5]
    assert not list((tmp_path / "s" / "manifests").glob("*.tmp"))


def test_sharding_query_of_an_empty_table(spark, docs, tmp_path):
    docs.filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert shards.op4_sharding(spark, str(tmp_path)).isEmpty()
    store = shards.ingest(docs, str(tmp_path / "s"), target=1 << 20)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(map(tuple, docs.collect()), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 2049, 800), rng.integers(1, 90, 300), [2048, 2048, 1]])
    sequence, offset = packing.best_two_fit(lengths, 2048)
    for s in range(sequence.max() + 1):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]] and lengths[own].sum() <= 2048
    bins = []  # no worse than first-fit decreasing
    for n in sorted(lengths.tolist(), reverse=True):
        k = next((k for k, b in enumerate(bins) if b + n <= 2048), len(bins))
        bins[k : k + 1] = [(bins[k] if k < len(bins) else 0) + n]
    assert sequence.max() + 1 <= len(bins)


def test_packing(spark, docs):
    got = packing.pack_documents(docs, VOCABULARY, 64).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(r.text)
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        want.update((r.doc_id, p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64
    assert packing.pack_documents(docs.filter("false"), VOCABULARY).isEmpty()


def test_base_spans_of_personal_data():
    rng = random.Random(1)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        t = "".join(rng.choice("a@.01+-( )%_") for _ in range(rng.randrange(40)))
        assert [(s, e) for s, k, e in pii.base_spans(t) if k == 0] == [m.span() for m in email.finditer(t)]
    t = "ü a@b.co 10.0.0.256; 1.2.3.4; 4111 1111 1111 1111; 4111111111111112; +1 (212) 555-0100"
    assert [(t[s:e], k) for s, k, e in pii.base_spans(t)] == [("a@b.co", 0), ("1.2.3.4", 1), ("4111 1111 1111 1111", 2), ("+1 (212) 555-0100", 3)]
    pii.base_spans("a" * 200_000 + "@" + "1" * 200_000)


def brute_trust(rows):
    """Bootstrapping in plain Python: kept (kind, pattern) after the rounds."""
    graph = {}
    for k, p, i, known in rows:
        graph[k, p, i] = graph.get((k, p, i), False) or known
    known = {}
    for (k, _, i), f in graph.items():
        known[k, i] = max(known.get((k, i), 0.0), float(f))
    score, kept = dict(known), {}
    for _ in range(pii.ROUNDS):
        by = {}
        for k, p, i in graph:
            by.setdefault((k, p), []).append(score[k, i])
        kept = {x: sum(v) / len(v) for x, v in by.items() if sum(v) >= pii.SUPPORT and sum(v) / len(v) >= pii.CONFIDENCE}
        score = dict(known)
        for k, i in known:
            doubt = 1.0
            for x, share in kept.items():
                if (*x, i) in graph and x[0] == k:
                    doubt *= max(1 - 0.9 * share, 1e-6)
            score[k, i] = max(known[k, i], 1 - doubt if doubt < 1 else 0.0)
    return set(kept)


def test_bootstrap_equals_brute_force(spark):
    rng = random.Random(14)
    rows = []
    for _ in range(900):  # the later a pattern, the more of its instances are unknown
        p, i = rng.randrange(40), rng.randrange(150)
        known = rng.random() > p / 40
        rows.append((p % 2, f"p{p}", f"{'i' if known else 'u'}{i}", known and rng.random() < 0.9))
    rows += [(3, "p", f"a{i}", True) for i in range(6)] + [(3, "p", "new", False)] + [(3, "q", "new", False)] + [(3, "q", f"b{i}", True) for i in range(9)]
    got = pii.trusted_patterns(spark.createDataFrame(rows, "kind int, pattern string, instance string, known boolean")).collect()
    want = brute_trust(rows)
    assert {tuple(r) for r in got} == want and (3, "q") in want and 5 < len(want) < 35, want


def test_bootstrap_finds_unseen(spark, docs):
    rows = [(i, f"filler {i} text. mail me u{i}@x{i}.org today") for i in range(12)] + [(50, "so mail me root@localhost now"), (51, "see also root@elsewhere now"), (52, None), (53, "")]
    rows += [(60 + i, f"{i} {'w' * 300}{i % 2} 10.0.0.{i} {'v' * 5000} end") for i in range(12)] + [(80, f"at {'w' * 300}0 300.1.2.3 {'v' * 5000} end"), (81, f"at {'w' * 300}2 300.1.2.3 {'v' * 4999} end")]
    rows += [(90, rows[12][1]), (90, rows[12][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("pattern", F.lit("x"))
    by = {}
    for r in pii.personal_spans(df).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by.values())) == len(rows) and all(rows[12][1][a.start : a.end] == "root@localhost" for d in (50, 90) for r in by[d] for a in r.added)
    assert len(by[50][0].added) == 1 and len(by[90]) == 2 and len(by[90][1].added) == 1
    assert not by[51][0].added and not by[52][0].base and not by[53][0].base
    assert [(a.kind, a.end - a.start) for a in by[80][0].added] == [(1, 9)] and not by[81][0].added
    assert pii.personal_spans(df.filter("false")).isEmpty()


def test_bootstrap_on_planted_contexts(spark):
    """Looser identifiers in the contexts of strict ones are found, those elsewhere are not."""
    rng = random.Random(15)
    filler = lambda: " ".join(rng.choice(["red", "green", "blue", "one", "two", "three", "tall", "short"]) + rng.choice("abcdefgh") for _ in range(12))
    strict = {0: lambda: f"u{rng.randrange(10**6)}@mail{rng.randrange(9)}.org", 1: lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), 3: lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"}
    loose = {0: lambda: f"u{rng.randrange(10**6)}@host{rng.randrange(99)}", 1: lambda: f"{rng.randrange(256, 999)}.1.{rng.randrange(99)}.4", 3: lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"}
    context = {0: "write to {} for details", 1: "connected from {} over tls", 3: "please call {} before noon"}
    rows, want = [], {}
    for i in range(600):
        k = rng.choice([0, 1, 3])
        unseen = i % 8 == 0
        value = (loose if unseen else strict)[k]()
        own = context[k] if i % 24 else "{}"  # a third of the unseen ones stand anywhere
        text = f"{filler()} {own.format(value)} {filler()}"
        rows.append((i, text))
        if unseen and i % 12:
            want[i] = (text.index(value), k, text.index(value) + len(value))
    got = {r.doc_id: [tuple(a) for a in r.added] for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(x in got[d] for d, x in want.items())
    wrong = sum(len(own) for d, own in got.items() if d not in want)
    assert found == len(want) and wrong == 0


def test_scanning_long_texts_takes_linear_time():
    import time

    began = time.time()
    for text in ("a" * 2_000_000 + "@", "1." * 1_000_000, "@" * 500_000, "x@y " * 200_000, "1" * 2_000_000 + " 1.2.3.4"):
        pii.occurrences(text, pii.base_spans(text))
    assert time.time() - began < 60


def test_licenses(spark):
    scan = licenses.Scanner()
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0-header"]
    t = f"foo bar\n{mit}\nmore text {mit} end. {apache.replace('compliance', 'accordance').upper()}"
    found = scan.find(t)
    assert [n for _, _, n, _ in found].count("MIT") == 2 and "Apache-2.0-header" in {n for _, _, n, _ in found}
    assert t[found[0][0] : found[0][1]] == "Released under the MIT License"
    assert scan.find("the license of a released bird under version two") == scan.find(None) == scan.find("") == []
    df = spark.createDataFrame([(1, t), (1, t), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.matches)) for r in licenses.license_matches(df).collect()) == [(1, len(found)), (1, len(found)), (2, 0), (3, 0)]
    assert licenses.align(list("axbyc"), list("abc")) == [(0, 0), (2, 1), (4, 2)]


def brute_align(text, template):
    """Patience alignment straight from its definition, with the longest rising run by trying all (ties: the least places from its end)."""
    if not text or not template:
        return []
    if text[0] == template[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in brute_align(text[1:], template[1:])]
    if text[-1] == template[-1]:
        return brute_align(text[:-1], template[:-1]) + [(len(text) - 1, len(template) - 1)]
    anchors = [(i, template.index(w)) for i, w in enumerate(text) if text.count(w) == 1 and template.count(w) == 1]
    best = max((c for n in range(len(anchors) + 1) for c in itertools.combinations(anchors, n) if all(a[1] < b[1] for a, b in zip(c, c[1:]))), key=lambda c: (len(c), [-j for _, j in reversed(c)]), default=())
    if not best:
        return []
    out, last = [], (0, 0)
    for i, j in [*best, (len(text), len(template))]:
        out += [(last[0] + a, last[1] + b) for a, b in brute_align(text[last[0] : i], template[last[1] : j])]
        if i < len(text) or j < len(template):
            out.append((i, j))
        last = (i + 1, j + 1)
    return [x for x in out if x[0] < len(text) and x[1] < len(template)]


def test_alignment_equals_brute_force():
    rng = random.Random(17)
    for _ in range(1500):
        template = [rng.choice("abcdefgh") for _ in range(rng.randrange(8))]
        text = [w for w in template if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            text.insert(rng.randrange(len(text) + 1), rng.choice("abcdefghxyz"))
        got = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in got) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))
        assert len(got) == len(brute_align(text, template)), (text, template)


def test_licenses_of_odd_tables(spark):
    import time

    mit, bsd = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["BSD-3-Clause-text"]
    filler = "some plain words about nothing " * 100_000
    rows = [(1, f"{filler}{mit} {filler}"), (2, f"ÀÈ İstanbul {bsd.lower()} x"), (2, f"ÀÈ İstanbul {bsd.lower()} x"), (None, None), (None, ""), (3, f"{mit} " * 40), (4, " ".join(w for k, w in enumerate(mit.split()) if k % 8))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(1)).withColumn("name", F.lit("x"))
    began, by = time.time(), {}
    for r in licenses.license_matches(df).collect():
        by.setdefault(r.doc_id, []).append(r.matches)
    found = {d: [[(m.name, round(m.coverage, 2)) for m in own] for own in v] for d, v in by.items()}
    assert found[1] == [[("MIT-text", 1.0)]] and by[1][0][0].start == len(filler) and by[1][0][0].end == len(filler) + len(mit) - 1
    assert found[2][0] == found[2][1] and ("BSD-3-Clause-text", 1.0) in found[2][0] and by[2][0][0].start == len("ÀÈ İstanbul ")
    assert found[None] == [[], []] and found[3] == [[("MIT-text", 1.0)] * 40] and [n for n, _ in found[4][0]] == ["MIT-text"] and 0.8 <= found[4][0][0][1] < 0.9
    assert licenses.license_matches(df.filter("false")).isEmpty() and time.time() - began < 60


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_repeated_licenses(name):
    scan, template = licenses.Scanner({name: licenses.TEMPLATES[name]}), licenses.words_of(licenses.TEMPLATES[name])
    for copies in (1, 2, 3, 20):
        for between in ("", "x ", "x y "):
            text, want = "foo ", []
            for _ in range(copies):
                notice = " ".join(template)
                want.append((len(text), len(text) + len(notice), name, 1.0))
                text += f"{notice} {between}"
            assert scan.find(text + "bar") == want, (copies, between)
    if len(template) >= 10:  # copies that lack a word each
        for gone in range(1, len(template) - 1):
            part = " ".join(template[:gone] + template[gone + 1 :])
            got = scan.find(f"foo {part} {part} x {part} bar")
            assert [(a, b) for a, b, _, _ in got] == [(4 + d, 4 + d + len(part)) for d in (0, len(part) + 1, 2 * len(part) + 4)], gone


def test_secrets(spark):
    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = [(i, f"ümlaut ordinary_identifier_name and someotherlongword Token = '{draw(30)}' x AKIA{draw(16).upper()} {i}") for i in range(60)]
    lone = draw(40)
    rows += [(100, f"a lone {lone} here"), (101, "a perfectly_ordinary_identifier_of_words here"), (102, None), (103, ""), (104, "token: secret: abcdefabcdefabcdef"), (None, "PASSWORD=" + "f" * 20), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("kind", F.lit(2))
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = secret_scan.secret_spans(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append([(s.start, s.rank, s.end) for s in r.found])
    for d, t in rows:
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert all([s for s in own if s[1] < 3] == sorted(want) for own in by[d]), t
    assert by[100] == [[(7, 3, 47)]] and by[101] == [[]] and len(by[0]) == 2
    clean = {r.doc_id: r.text for r in secret_scan.redacted(df).collect()}
    assert clean[100] == "a lone [SECRET] here" and clean[102] is None and clean[None] == "[SECRET]"
    assert secret_scan.secret_spans(df.filter("false")).isEmpty()


def test_markov_models_equal_brute_force(spark):
    rng = random.Random(12)
    alphabet = secret_scan.ALPHABET
    samples = [(k, "".join(rng.choice(alphabet[:: 2 - k]) for _ in range(rng.randrange(30)))) for k in (0, 1) for _ in range(80)] + [(1, "ü a!b"), (0, None), (1, "")]
    counts = np.zeros((2, len(alphabet), len(alphabet)))
    for k, v in samples:
        v = [c for c in v or "" if c in alphabet]
        for a, b in zip(v, v[1:]):
            counts[k, alphabet.index(a), alphabet.index(b)] += 1
    chance = np.zeros_like(counts)
    for k in (0, 1):
        single = counts[k].sum(0) + 0.1
        for a in range(len(alphabet)):
            for b in range(len(alphabet)):
                chance[k, a, b] = np.log((counts[k, a, b] + 4 * single[b] / single.sum()) / (counts[k, a].sum() + 4))
    model = secret_scan.train(spark.createDataFrame(samples, "label int, value string"))
    assert np.allclose(model, chance[1] - chance[0])
    tokens = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 60))) for _ in range(40)] + ["a", ""]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan.ratio(F.col("t"), model).alias("r")).collect()
    for r in got:
        want = sum(model[alphabet.index(a), alphabet.index(b)] for a, b in zip(r.t, r.t[1:]))
        assert abs(r.r - want) < 1e-4 * max(1, len(r.t))
    assert {len(set(r.value)) > 5 for r in secret_scan.generated(spark, 20).collect()} == {True}


def planted(spark, texts, seed=3):
    """Documents with a random token each, others with an identifier each: rows and the planted strings."""
    rng = random.Random(seed)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789"]
    plain = ["session_handler", "getElementById", "partition-map", "src/main/resources", "MAX_BUFFER_SIZE", "internationalization", "release/2023-11-05"]
    rows, found = [], {}
    for i in range(300):
        secret = i % 2 == 0
        token = "".join(rng.choice(alphabets[i // 2 % 3]) for _ in range(rng.choice([16, 20, 24, 32, 40]))) if secret else rng.choice(plain)
        text = texts[i % len(texts)]
        cut = rng.randrange(len(text) + 1)
        rows.append((10**6 + i, f"{text[:cut]} ({token}) {text[cut:]}"))
        if secret:
            found[10**6 + i] = token
    return rows, found


def test_models_find_planted_secrets(spark):
    rng = random.Random(31)
    syllables = ["tion", "the", "er", "ung", "ment", "re", "an", "lich", "que", "in"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(60)) for _ in range(100)]
    rows, want = planted(spark, texts)
    got = {}
    for r in secret_scan.secret_spans(spark.createDataFrame(rows + list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r.doc_id] = [s for s in r.found]
    text = dict(rows)
    hit = [d for d, token in want.items() if token in [text[d][s.start : s.end] for s in got[d] if s.rank == 3]]
    wrong = [d for d, own in got.items() if d not in want and own]
    assert len(hit) >= 0.9 * len(want) and len(wrong) <= 0.02 * len(rows), (len(hit), len(want), wrong)


def test_secrets_of_long_texts(spark):
    import time

    rng = random.Random(8)
    run = "".join(rng.choice(secret_scan.ALPHABET) for _ in range(1_000_000))
    many = "é " + "password=abcdefabcdef0 x token: secretsecret1 ü " * 5000
    rows = [(1, f"ü {run} end"), (2, many), (3, "plain words only " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    began = time.time()
    got = {r.doc_id: r.found for r in secret_scan.secret_spans(df).collect()}
    assert (2, 2 + len(run)) in [(s.start, s.end) for s in got[1] if s.rank == 3] and len(got[2]) == 10_000 and not got[3]
    clean = {r.doc_id: r for r in secret_scan.redacted(df).collect()}
    assert clean[1].text == "ü [SECRET] end" and clean[2].text == "é " + "[SECRET] x [SECRET] ü " * 5000 and clean[2].n_chars == len(clean[2].text)
    assert time.time() - began < 120


def item_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def test_decontamination(spark, monkeypatch):
    rng = random.Random(8)
    items = [(1, words(rng, 14)), (2, "Ünly, FOUR wörds here!"), (3, words(rng, 10)), (4, None), (5, "--"), (6, words(rng, 14, 3)), (7, "tiny"), (1, "tiny")]
    rows = [(i, words(rng, rng.randrange(60), 6)) for i in range(20)] + [(30, f"x y {items[0][1].upper()} z"), (31, "so ünly four;wörds...here"), (32, " ".join(items[0][1].split()[2:12] + items[2][1].split())), (33, None), (34, ""), (35, "tiny"), (35, "tiny"), (None, "a tiny one"), (36, words(rng, 400, 3)), (37, words(rng, 60_000, 9) + " " + items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("token", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("len", F.lit(1))
    wins = {(i, tuple(w[k : k + 10])) for i, t in items for w in [item_words(t)] if w for k in range(max(1, len(w) - 9))}
    want = Counter()
    for d, t in rows:
        w, hit, found = item_words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found.add(str(i))
        want[(d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    assert Counter(tuple(r) for r in decontam.contamination(docs, bench).drop("h").collect()) == want
    monkeypatch.setattr(bits, "FILTER_ROWS", 1)  # a filter that lets much through, and joins by sorting
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert Counter(tuple(r) for r in decontam.contamination(docs, bench).drop("h").collect()) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert decontam.contamination(docs.filter("false"), bench).isEmpty()
    assert not decontam.contamination(docs, bench.filter("false")).filter("contaminated").count()
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {k[0] for k in want if not k[-1]}


def test_quality(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "word", "text"]) for _ in range(40)) + "." for _ in range(150)]
    bad = [" ".join(["SPAM!!", "BUY###"][rng.randrange(2)] for _ in range(40)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (902, "Ünïcode text " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(9))
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (900, None)], "doc_id long, quality int")
    model = quality.quality_model(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i < 150) for i in held) / len(held) > 0.97 and len(got) == len(rows)
    assert got[900] == got[901] and 0 <= got[900] <= 1
    text = "some text " * 300_000
    assert abs(model.score([text, "x"])[0] - model.score([text])[0]) == 0
    assert quality.quality_model(docs, labels.filter("false")).score(["a"])[0] == 0.5
    assert quality.scored(docs.filter("false"), model).isEmpty()


def test_quality_features_by_brute_force():
    """Words hash alike wherever they stand and unlike their anagrams; a text's features are its n-grams', words' and pairs'."""
    texts = ["listen to  the\nsilent enlist tinsel", "silent to listen", "a a b", *("xyzuvwq"[:n] for n in range(1, 8)), " ", "é ü " * 50, "word " * 300]
    by = {}
    for t in texts:
        for w, h in zip(re.findall(r"[^ \n]+", t), quality.word_hashes(np.frombuffer(t.encode(), np.uint8)), strict=True):
            assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by) >= 10
    for t in texts:
        data, own = t.encode(), re.findall(r"[^ \n]+", t)
        n = {1: max(0, len(data) - 2), 2: max(0, len(data) - 5), 3: max(0, len(data) - 4), 4: len(own), 5: max(0, len(own) - 1)}
        found = quality._features(t)
        assert [len(f) for f in found] == list(n.values()) and all(((f >> quality.BITS) == k).all() for k, f in enumerate(found))
        for k, length in ((0, 3), (2, 5)):
            assert len(set(found[k].tolist())) <= len({data[i : i + length] for i in range(len(data))})
        buckets, share = quality.counted(t)
        count = Counter(b for f in found for b in f.tolist())
        assert dict(zip(buckets.tolist(), share)) == {b: c / sum(count.values()) for b, c in count.items()}


def test_quality_training_equals_brute_force(monkeypatch):
    """Softmax and gradient descent written out in loops over the distinct features, in float64."""
    rng = random.Random(3)
    rows = [quality.counted(" ".join(rng.choice(["aa", "bb", "cc"] if k % 2 else ["dd", "ee", "cc"]) for _ in range(6))) for k in range(24)]
    labels = np.array([k % 2 for k in range(24)])
    model = quality.train(rows, labels, epochs=3, batch=7, rate=20.0, seed=5)
    draw = np.random.default_rng(5)
    vectors = draw.normal(0, 0.1, (quality.SIZE, quality.DIMENSIONS)).astype(np.float32).astype(float)
    layer = draw.normal(0, 0.5, (quality.DIMENSIONS, 2)).astype(np.float32).astype(float)
    bias = np.log([0.5, 0.5])
    for epoch in range(3):
        step, order = 20.0 * (1 - epoch / 3), draw.permutation(24)
        for k in range(0, 24, 7):
            own = order[k : k + 7]
            g_vectors, g_layer, g_bias = {}, np.zeros_like(layer), np.zeros(2)
            for i in own:
                mean = sum(s * vectors[b] for b, s in zip(*rows[i]))
                p = np.exp(mean @ layer + bias)
                error = (p / p.sum() - np.eye(2)[labels[i]]) / len(own)
                for b, s in zip(*rows[i]):
                    g_vectors[b] = g_vectors.get(b, 0) + s * (layer @ error)
                g_layer += np.outer(mean, error)
                g_bias += error
            for b, g in g_vectors.items():
                vectors[b] -= step * g
            layer, bias = layer - 0.02 * step * g_layer, bias - 0.02 * step * g_bias
    used = sorted({b for r in rows for b in r[0].tolist()})
    assert np.allclose(model.weights[used] / model.SCALE, vectors[used] @ (layer[:, 1] - layer[:, 0]), atol=1e-3)
    text = "aa bb dd x"
    score = (vectors @ (layer[:, 1] - layer[:, 0]))[quality.counted(text)[0]] @ quality.counted(text)[1] + bias[1] - bias[0]
    assert abs(model.score([text])[0] - 1 / (1 + np.exp(-score))) < 1e-3
