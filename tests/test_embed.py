"""Embedding operators (E-1..E-4, U-1) and the blob codec (S-6, K-2)."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from simcat.functions.vector import l2_normalize
from simcat.operators.embed import HashingEmbedder, ModelEmbedder, PrecomputedEmbedder, mean_pool
from simcat.sources.blob import export_blob_table, import_blob_table


def py_hash_vector(text, dim=64, max_tokens=None):
    toks = [t for t in text.lower().split(" ") if t][:max_tokens]
    c = np.zeros(dim)
    for t in toks:
        h = hashlib.md5(t.encode()).hexdigest()
        c[int(h[:8], 16) % dim] += 1 if int(h[8], 16) % 2 == 0 else -1
    n = np.sqrt((c * c).sum())
    return (c / max(n, 1e-12)).astype(np.float32)


def test_hashing_embedder_cuts_tokens_only_when_told(spark):
    text = " ".join(f"w{i}" for i in range(700))
    df = spark.createDataFrame([(text,), (None,)], "text string")
    whole, null = [r.v for r in HashingEmbedder(64).embed(df, "text", "v").collect()]
    cut = HashingEmbedder(64, max_tokens=512).embed(df, "text", "v").first().v
    assert null is None
    assert np.array_equal(np.array(whole, dtype=np.float32), py_hash_vector(text))
    assert np.array_equal(np.array(cut, dtype=np.float32), py_hash_vector(text, max_tokens=512))


def test_hashing_embedder_matches_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ""), (-2, "   "), (-3, " ".join(["w%d" % i for i in range(700)]))],
                                  "doc_id long, text string")
    rows = HashingEmbedder(64).embed(docs.unionByName(extra), "text", "v").collect()
    for r in rows:
        exp = py_hash_vector(r.text)
        assert np.array_equal(np.array(r.v, dtype=np.float32), exp), r.doc_id
    zero = [r for r in rows if r.doc_id in (-1, -2)]
    assert all(not any(r.v) for r in zero)


def test_mean_pool_and_normalize(spark):
    rows = [(1, 0, 1, [1.0, 2.0]), (1, 1, 1, [3.0, 4.0]), (1, 2, 0, [100.0, 100.0]), (2, 0, 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "doc long, pos long, mask int, vec array<double>")
    got = {r.doc: r.vector for r in mean_pool(df, "doc", "pos", "mask", "vec").collect()}
    assert got == {1: [2.0, 3.0], 2: [0.0, 0.0]}
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = [r.n for r in v.select(l2_normalize("v").alias("n")).collect()]
    assert np.allclose(out[0], [0.6, 0.8]) and out[1] == [0.0, 0.0]


def test_mean_pool_over_many_tasks_and_flushes(spark, monkeypatch):
    """Against numpy: null vectors, masks, components and documents, a hot document, string keys."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 == 0 else f"d{i % 11}", i, int(rng.integers(0, 2)), [float(x) for x in rng.normal(size=5)]) for i in range(900)]
    rows += [("d1", 1000, None, [1.0] * 5), ("d2", 1001, 1, None), ("none", 0, 1, None), (None, 0, 1, [1.0, None, 2.0, 3.0, 4.0]), ("masked", 0, 0, [7.0] * 5)]
    df = spark.createDataFrame([rows[-3], *rows[:-3], *rows[-2:]], "doc string, pos long, mask int, vec array<double>").repartition(6)
    want: dict = {}
    for d, _, m, v in rows:
        s, n = want.get(d, (None, 0))
        if v is not None:
            s, n = (0 if s is None else s) + np.array([x or 0.0 for x in v]) * (m or 0), n + (m or 0)
        want[d] = s, n
    got = {r.doc: r.vector for r in mean_pool(df, "doc", "pos", "mask", "vec").collect()}
    assert got.keys() == want.keys() and got["none"] is None and got["masked"] == [0.0] * 5
    assert all(np.allclose(got[d], s / max(n, 1e-9)) for d, (s, n) in want.items() if s is not None)
    first_null = spark.createDataFrame([(1, 0, 1, None), (1, 1, 1, [2.0])], "doc long, pos long, mask int, vec array<float>").coalesce(1)
    assert mean_pool(first_null, "doc", "pos", "mask", "vec").first().vector == [2.0]
    assert mean_pool(first_null.limit(0), "doc", "pos", "mask", "vec").count() == 0


def test_mean_pool_refuses_mixed_dimensions(spark):
    import pytest

    rows = [(1, 0, 1, [1.0, 2.0]), (2, 1, 1, [3.0]), (1, 2, 1, [3.0])]
    df = spark.createDataFrame(rows, "doc long, pos long, mask int, vec array<double>")
    for parts in (1, 3):
        with pytest.raises(Exception, match="dimension mismatch"):
            mean_pool(df.filter("doc = 1").repartition(parts, "pos"), "doc", "pos", "mask", "vec").collect()
    with pytest.raises(Exception, match="expected 3"):
        mean_pool(df, "doc", "pos", "mask", "vec", dim=3).collect()


def _toy(vectors, seen):
    """A tokenizing model: one id per word, the id's row of a fixed matrix as its vector."""
    def make_model():
        def encode(ids, mask):
            seen.append((ids.size, int(mask.sum()))) if seen is not None else None
            return vectors[ids]
        return encode
    return make_model


def test_model_embedder_batches_by_length(spark):
    import random

    from simcat.operators.embed import length_batches

    rng, vectors = random.Random(2), np.random.default_rng(2).normal(size=(50, 4))
    texts = [" ".join(str(rng.randrange(1, 50)) for _ in range(rng.choice([1, 2, 3, 40, 41, 700]))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    tokenize = lambda t: [int(x) for x in t.split()]
    emb = ModelEmbedder(_toy(vectors, None), dim=4, batch_size=16, tokenize=tokenize, max_text_length=512)
    got = {r.i: r.v for r in emb.embed(df, "text", "v").collect()}
    raw = {r.i: r.v for r in ModelEmbedder(_toy(vectors, None), dim=4, batch_size=7, tokenize=tokenize, max_text_length=512, normalize=False).embed(df, "text", "v").collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None and raw[i] is None
            continue
        ids = tokenize(t)[:512]
        mean = vectors[ids].mean(axis=0) if ids else np.zeros(4)
        assert np.allclose(raw[i], mean, atol=1e-5)
        assert np.allclose(got[i], mean / max(np.linalg.norm(mean), 1e-12), atol=1e-5)
    lengths = [min(512, len((t or "").split())) for t in texts]
    padded = sum(len(b) * max(lengths[i] for i in b) for b in length_batches(lengths, 16))
    assert sorted(i for b in length_batches(lengths, 16) for i in b) == list(range(len(texts))) and padded < 1.2 * sum(lengths)


def test_model_embedder_pools_and_normalises(spark):
    def make_model():
        def encode(texts):
            b = len(texts)
            tok = np.zeros((b, 3, 2), dtype=np.float32)
            mask = np.zeros((b, 3), dtype=np.int64)
            for i, t in enumerate(texts):
                n = min(len(t), 3)
                tok[i, :n, 0] = 1.0
                tok[i, :n, 1] = np.arange(n)
                mask[i, :n] = 1
            return tok, mask
        return encode

    df = spark.createDataFrame([("abc",), ("a",)], "text string")
    got = [r.v for r in ModelEmbedder(make_model, dim=2, batch_size=2).embed(df, "text", "v").collect()]
    exp0 = np.array([1.0, 1.0]) / np.sqrt(2)   # mean of (1,0),(1,1),(1,2) = (1,1)
    assert np.allclose(got[0], exp0, atol=1e-6) and np.allclose(got[1], [1.0, 0.0])


def test_precomputed_embedder(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k long, v array<float>")
    df = spark.createDataFrame([(2, "b"), (3, "c")], "id long, text string")
    got = {r.id: r.vector for r in PrecomputedEmbedder(vecs, "k", "v", 2).embed(df).collect()}
    assert got == {2: [0.0, 1.0], 3: None}


def test_blob_roundtrip_and_rejects(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"),
                                                                 F.col("embedding").alias("vector"))
    blobs = export_blob_table(emb)
    r0 = blobs.orderBy("id").first()
    first = emb.orderBy("id").first()
    assert r0.blob == np.array(first.vector, dtype="<f4").tobytes() and r0.dim == 64
    back, rejects = import_blob_table(blobs)
    assert back.join(emb.withColumnRenamed("vector", "o"), "id").filter(F.col("vector") != F.col("o")).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"\x00" * 7), 2), (2, None, 1)], "id long, blob binary, dim int")
    ok, rej = import_blob_table(bad)
    assert ok.count() == 0 and rej.count() == 2 and rejects.count() == 0


def test_dot_and_dimension_check(spark):
    import pytest

    from simcat.functions.vector import dot
    from simcat.operators.catalog import check_dimension

    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0]), (2, [0.5, 0.5], [0.5, -0.5])],
                               "id long, a array<float>, vector array<float>")
    assert [r.d for r in df.orderBy("id").select(dot("a", "vector").alias("d")).collect()] == [11.0, 0.0]
    check_dimension(df, 2)
    with pytest.raises(ValueError):
        check_dimension(df, 3)


def test_now_seconds(spark):
    import time

    from simcat.operators.catalog import now_seconds

    got = spark.range(1).select(now_seconds().alias("t")).first().t
    assert abs(got - int(time.time())) < 60


def test_a_batch_of_long_texts_is_taken_in_slices(spark, monkeypatch):
    """The tokens of a whole Arrow batch were held at once."""
    import simcat.operators.embed as E

    texts = [(i, None if i == 5 else " ".join(f"w{(i * 31 + j) % 50}" for j in range(i * 3))) for i in range(40)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    whole = {r.id: r.vector for r in E.HashingEmbedder(16).embed(df).collect()}
    monkeypatch.setattr(E, "_SLICE_TOKENS", 20)
    assert {r.id: r.vector for r in E.HashingEmbedder(16).embed(df).collect()} == whole
