import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import documents

from simcat.llm import linededup, queries

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(texts, limit):
    keyed = [[(x, x.strip(SPACE).translate(LOWER)) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for rows in keyed for k in {k for _, k in rows})
    out = []
    for rows in keyed:
        stay = [x for x, k in rows if not k or seen[k] < limit]
        out.append((len(rows), len(rows) - len(stay), "\n".join(stay)))
    return out


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(docs, brute([d.text for d in docs], 10))}
    assert {r[0]: tuple(r[1:]) for r in queries.op4_line_dedup(spark, sf).collect()} == want


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, extra=True)
    out = linededup.LineDedup(spark, threshold=3).insert(docs).apply(docs)
    assert {c.lower() for c in out.columns} == {c.lower() for c in docs.columns} | {"n_lines", "n_dropped"}
    want = brute([r.text for r in docs.collect()], 3)
    assert sorted((r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == sorted(want)
    assert out.filter("text is null").count() == docs.filter("text is null").count()


def test_insert_and_delete_are_reversible(spark):
    texts = [f"shared {i % 4}\nown {i}\n\n SHARED {i % 4} " for i in range(40)]
    a, b, c = documents(spark, texts[:20]), documents(spark, texts[20:]), documents(spark, [f"shared {i % 2}" for i in range(20)])
    state = linededup.LineDedup(spark, threshold=8, shards=4).insert(a)
    dropped = lambda docs: sorted(r.text for r in state.apply(docs).collect())
    assert dropped(a) == sorted(x[2] for x in brute(texts[:20], 8))
    before = sorted(map(tuple, state.counts.collect()))
    state.insert(b)
    assert dropped(a) == sorted(x[2] for x in brute(texts, 8)[:20])
    state.delete(b)
    assert sorted(map(tuple, state.counts.collect())) == before
    assert dropped(a) == sorted(x[2] for x in brute(texts[:20], 8))
    assert all(not np.frombuffer(r.marks, np.uint16).any() for r in state.filters.collect())
    state.insert(c)
    assert dropped(c) == [""] * 20


def test_state_reopens_from_its_folder(spark):
    texts = [f"shared {i % 4}\nown {i}\n\n SHARED {i % 4} " for i in range(40)]
    first, second = documents(spark, texts[:20]), documents(spark, texts[20:])
    path = linededup.LineDedup(spark, threshold=8).insert(first).path
    again = linededup.LineDedup(spark, path=path)
    assert (again.version, again.threshold, again.shards) == (1, 8, 16)
    again.insert(second)
    again.counts.write.parquet(f"{path}/v3/counts")  # an attempt that was never finished
    last = linededup.LineDedup(spark, path=path, threshold=8)
    assert last.version == 2 and sorted(r.text for r in last.apply(first).collect()) == sorted(x[2] for x in brute(texts, 8)[:20])
    last.delete(first)
    assert sorted(r.text for r in linededup.LineDedup(spark, path=path).apply(second).collect()) == sorted(x[2] for x in brute(texts[20:], 8))
    with pytest.raises(ValueError, match="threshold of 8"):
        linededup.LineDedup(spark, path=path, threshold=9)


def test_shards_double_as_they_fill(spark):
    texts = ["\n".join(f"line {j}" for j in range(i % 7, 300)) for i in range(12)]
    state = linededup.LineDedup(spark, threshold=4, shards=1, per_shard=20).insert(documents(spark, texts[:3]))
    assert state.shards == 1 and state.filters.count() == 0
    state.insert(documents(spark, texts[3:]))
    assert state.shards == 16 and state.filters.select("shard").distinct().count() == 16
    assert sorted(r.text for r in state.apply(documents(spark, texts)).collect()) == sorted(x[2] for x in brute(texts, 4))
    state.delete(documents(spark, texts[3:]))
    assert sorted(r.text for r in state.apply(documents(spark, texts[:3])).collect()) == sorted(texts[:3])


def test_a_row_is_a_document(spark):
    docs = spark.createDataFrame([(1, "one line\nmore")] * 12 + [(2, "more")], "doc_id long, text string")
    assert {r.text for r in linededup.LineDedup(spark).insert(docs).apply(docs).collect()} == {""}


def test_takedown_query_equals_brute_force(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.source != queries.TAKEN_DOWN]
    want = {d.doc_id: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(docs, brute([d.text for d in docs], 10))}
    assert {r[0]: tuple(r[1:]) for r in queries.op4_line_dedup_takedown(spark, sf).collect()} == want


def test_empty(spark):
    docs = documents(spark, [])
    assert linededup.LineDedup(spark).insert(docs).apply(docs).count() == 0


def test_filters_come_in_bundles_and_still_find_all(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BUNDLE", 1)
    docs = documents(spark, [f"line {i % 30}\nmine {i}" for i in range(90)])
    out = linededup.LineDedup(spark, threshold=3, shards=8).insert(docs).apply(docs).collect()
    assert sorted(r.text for r in out) == sorted(f"mine {i}" for i in range(90))


def test_cuckoo_holds_all_and_forgets_removed():
    keys = [linededup.key_digest(str(i).encode()) for i in range(5000)]
    layers = linededup.update_layers([], keys[:100], [])
    layers = linededup.update_layers(layers, keys[100:], [])
    assert len(layers) > 1
    probe = lambda ks: linededup.Bundle([(s, n, t) for s in range(4) for n, t in layers], 4).maybe(ks)
    assert probe(keys).all()
    assert probe([linededup.key_digest(f"other {i}".encode()) for i in range(20000)]).mean() < 0.01
    layers = linededup.update_layers(layers, [], keys[:4000])
    assert probe(keys[4000:]).all() and probe(keys[:4000]).mean() < 0.01


def test_a_digest_is_removed_from_the_layer_that_holds_it():
    digest = lambda mark, bucket: (0).to_bytes(8, "little") + ((mark - 1 << 48) | bucket).to_bytes(8, "little")
    # one mark in two layers: in the first both digests' buckets are {3, 3 ^ x}
    first, second = linededup.Cuckoo(16), linededup.Cuckoo(32)
    rng = np.random.default_rng(0)
    stays, goes = digest(5, 3), digest(5, 19)
    first.add(5, 3, rng), second.add(5, 19, rng)
    members = [{stays}, {goes}]
    layers = linededup.update_layers([(x.buckets, x.table.tobytes()) for x in (first, second)], [], [goes], members)
    assert members == [{stays}, set()]
    found = linededup.Bundle([(0, n, t) for n, t in layers], 1).maybe([stays, goes])
    assert found[0] and not np.frombuffer(layers[1][1], np.uint16).any()


def test_deletions_over_several_layers_lose_no_line(monkeypatch):
    # 63 different marks only, so that they meet in every layer
    monkeypatch.setattr(linededup, "_KICKS", 5)
    marks = linededup.Cuckoo.marks
    monkeypatch.setattr(linededup.Cuckoo, "marks", staticmethod(lambda d: (marks(d)[0] % np.uint64(63) + np.uint64(1), marks(d)[1])))
    keys = [linededup.key_digest(str(i).encode()) for i in range(400)]
    members = []
    layers = linededup.update_layers([], keys[:20], [], members)
    layers = linededup.update_layers(layers, keys[20:], [], members)
    assert len(layers) > 2 and sum(map(len, members)) == len(keys)
    layers = linededup.update_layers(layers, [], keys[::2], members)
    assert linededup.Bundle([(s, n, t) for s in range(4) for n, t in layers], 4).maybe(keys[1::2]).all()
    assert sum(int(np.count_nonzero(np.frombuffer(t, np.uint16))) for _, t in layers) == len(keys) // 2


def test_the_filters_hold_every_hot_line_after_inserts_and_deletions(spark):
    a, b = documents(spark, [f"line {i}" for i in range(20)] * 2), documents(spark, [f"line {i}" for i in range(300)] * 2)
    state = linededup.LineDedup(spark, threshold=2, shards=1).insert(a).insert(b)
    assert state.filters.count() > 1
    state.delete(documents(spark, [f"line {i}" for i in range(100, 300)]))
    hot = [bytes(r.digest) for r in state.counts.filter("n >= 2").collect()]
    held = [bytes(r.digests[i : i + 16]) for r in spark.read.parquet(state._at("filters")).collect() for i in range(0, len(r.digests), 16)]
    assert sorted(held) == sorted(hot) and len(hot) == 100
    assert all(bundle.maybe(hot).all() for bundle in state._bundles())
