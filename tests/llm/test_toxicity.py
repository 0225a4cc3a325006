import random
import re
import struct
import zlib

import numpy as np
import xxhash
from helpers import documents, sentence
from pyspark.sql import functions as F

from simcat.llm import queries, toxicity


def corpus(spark, n=900, flip=None):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = sentence(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(["vilebad", "nastyword"])
        rows.append((i, " ".join(words)))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(toxic) if not (held and flip) else 1 - int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_labels_never_read(spark):
    docs, labels = corpus(spark)
    scored = {r.doc_id: r.score for r in toxicity.fit_and_score(docs, labels).collect()}
    held = [i for i in scored if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and all((scored[i] >= 0.5) == (i % 4 == 0) for i in held)
    docs, flipped = corpus(spark, flip=True)
    assert {r.doc_id: r.score for r in toxicity.fit_and_score(docs, flipped).collect()} == scored


def test_query_finds_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity_ftrl(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted for r in held if r.toxic)
    assert hits / sum(r.toxic for r in held) > 0.8
    assert sum(r.predicted for r in held if not r.toxic) / len(held) < 0.02


def plain_coordinates(text):
    """Hashed words, word pairs and skip pairs, one by one in Python integers."""
    words, low = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()), (1 << 32) - 1
    a, b, c, d = (int(x) for x in toxicity._MIX)
    h = [zlib.crc32(w) for w in words]
    out = {(x * a & low) >> 12 for x in h}
    for pairs, p, q, add in ((zip(h, h[1:]), b, c, 1), (zip(h, h[2:]), c, b, 2)):
        for x, y in pairs:
            v = (x * p + y * q + add) * d & low
            out.add((v ^ v >> 15) >> 12)
    return out


def test_query_scores_equal_a_plain_model(spark, sf):
    """The whole operator again: choice and order of the training rows, features, updates, weights and scores."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in docs and zlib.crc32(str(r.doc_id).encode()) % 5}
    place = lambda i: int(np.uint64(xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)).astype(np.int64))
    seen = [(plain_coordinates(docs[i]) | {1 << 20}, truth[i]) for i in sorted(truth, key=place)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return (np.sign(z[i]) * toxicity.L1 - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, y in seen:
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (toxicity.TOXIC_WEIGHT if y else 1.0)
            for i in at:
                had = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((had + g * g) ** 0.5 - had**0.5) / toxicity.ALPHA * w[i]
                n[i] = had + g * g
    want = {i: 1 / (1 + np.exp(-sum(weight(c) for c in plain_coordinates(t) | {1 << 20}))) for i, t in docs.items()}
    got = {r.doc_id: r.score for r in queries.op6_toxicity_ftrl(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want) and len(set(got.values())) > 1


def test_training_is_bounded_and_sparse(spark):
    docs, labels = corpus(spark)
    few = toxicity.train(docs, labels, rows=50).collect()
    assert 0 < len(few) < 2000
    all_rows = toxicity.train(docs, labels)
    assert all_rows.count() < 5000


def test_awkward_rows(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(60)] + [(5, 1), (None, 1), (10**9, 1)], "doc_id long, toxic int")
    out = toxicity.fit_and_score(docs, labels)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    same = {}
    for r in rows:
        assert same.setdefault(r.text, r.score) == r.score
    assert toxicity.fit_and_score(documents(spark, []), labels).count() == 0
    none = toxicity.fit_and_score(docs, labels.limit(0)).collect()
    assert all(r.score < 1e-9 for r in none)


def test_ftrl_follows_its_update_rule():
    model = toxicity.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2, toxic_weight=1.0)
    z, n = np.zeros(17), np.zeros(17)
    for x, y in [([1, 2], 1), ([2, 3], 0), ([1], 1), ([2], 0)] * 3:
        at = [*x, 16]
        w = [0.0 if abs(z[i]) <= 0.1 else (np.sign(z[i]) * 0.1 - z[i]) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.2) for i in at]
        g = 1 / (1 + np.exp(-sum(w))) - y
        for i, wi in zip(at, w):
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
            z[i] += g - s * wi
            n[i] += g * g
        model.learn(np.array(x), y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
