import hashlib
import random
import re

import xxhash
from helpers import awkward_texts, documents, sentence

from simcat.llm import graph, queries, simhash
from test_linededup import LOWER


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=3):
    """Smallest index reachable."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark, sf):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    want = {d[0]: (f"{f:016x}", docs[c][0]) for d, f, c in zip(docs, fps, components(fps))}
    assert {r[0]: tuple(r[1:]) for r in queries.op5_simhash_neardup(spark, sf).collect()} == want


def test_links_connect_exactly_the_balls(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    for f in list(fps):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 7)):
                f ^= 1 << b
            fps.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = components([f % (1 << 64) for f in signed])
    made = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all((a ^ b).bit_count() <= 3 for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in made.collect()))
    roots = {r.u: r.v for r in graph.connected_components(made).collect()}
    assert [roots.get(f, f) for f in signed] == [signed[c] for c in want]


def test_large_packs_are_split(spark, monkeypatch):
    """Fingerprints that differ in their low bits only fall into one pack; its variants are dealt one by one."""
    rng = random.Random(12)
    top = rng.getrandbits(40) << 24
    fps = sorted({(top | rng.getrandbits(24)) - (1 << 64 if top >> 63 else 0) for _ in range(1200)})
    fps += [f ^ (1 << 20) ^ (1 << 3) ^ (1 << 7) for f in fps[:300]] + [f ^ (1 << 60) for f in fps[300:600]]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    want = components([f % (1 << 64) for f in fps])
    assert len(set(want)) > 100
    for split in (4096, 16):
        monkeypatch.setattr(simhash, "SPLIT", split)
        made = simhash.links(nodes)
        assert all((r.a ^ r.b).bit_count() <= 3 if (r.a < 0) == (r.b < 0) else False for r in made.collect())
        roots = {r.u: r.v for r in graph.connected_components(made).collect()}
        assert [roots.get(f, f) for f in fps] == [fps[c] for c in want], split


def test_awkward_rows(spark):
    texts = awkward_texts()
    docs = documents(spark, texts)
    fps = [brute_fingerprint(t) for t in texts]
    got = {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, components(fps)))}


def test_keep_one_per_group_with_null_and_repeated_ids(spark):
    docs = documents(spark, extra=True).withColumnRenamed("t", "row")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in docs.collect()]
    rows = kept.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    assert len(set(components(fps))) == len(rows) == len(set(components([brute_fingerprint(t) for t in texts])))


def test_rows_with_one_id_and_different_texts_all_stay(spark):
    rng = random.Random(8)
    texts = [sentence(rng, 40) for _ in range(40)]
    assert len(set(components([brute_fingerprint(t) for t in texts]))) == len(texts)
    rows = [(7 if i % 3 else None, t) for i, t in enumerate(texts)]
    # id 5 has a copy of id 3's text and a text of its own
    rows += [(3, "copied " + texts[0]), (5, "copied " + texts[0]), (5, "own " + texts[1] + " " + texts[2])] + rows[:10]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()))
    comp = components([brute_fingerprint(t) for _, t in order])
    assert kept == sorted((r[0] or 0, r[1]) for i, r in enumerate(order) if comp[i] == i)
    assert len(kept) >= len(texts) and sum(i == 5 for i, _ in kept) == 1


def test_empty_and_chunked_shingles(spark, monkeypatch):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0
    text = awkward_texts()[9]
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (7000, 6999), (None, 3)]
    edges += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    got = {r.u: r.v for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}
