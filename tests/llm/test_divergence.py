import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, sentence

from simcat.llm import divergence as V
from simcat.llm import queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=30, smooth=5, best=50):
    """The audit of (text, lang, source) rows."""
    rows = [(TERM.findall((t or "").translate(LOWER)), lang or "", source or "") for t, lang, source in rows]
    held, groups, counts = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for words, lang, source in rows:
        held[lang].update(set(words))
        groups[lang].add(source)
    kept = {lang: [w for w, n in c.items() if n >= least] for lang, c in held.items()}
    for words, lang, source in rows:
        keep = set(kept[lang])
        counts[lang, source].update(w for w in words if w in keep)
    out = set()
    for lang, sources in groups.items():
        terms, v = kept[lang], len(kept[lang])

        def p_of(c):
            total = sum(c.values()) + smooth * v
            return [1 + 10**9 * (c[w] + smooth) // total for w in terms]

        p = {s: p_of(counts[lang, s]) for s in sources}
        q = p_of(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            more = [(a - b, w) for w, a, b in zip(terms, p[s], q) if counts[lang, s][w] and a > b]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", more, best)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_query_equals_brute_force(spark, sf):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op12_divergence_audit(spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()} == brute(rows)


def tuples(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 3, "bundle_bytes": 1, "counters": 5}])
def test_awkward_rows_small_shards_and_bundles(spark, sizes):
    docs = documents(spark, extra=True)
    rng = random.Random(1)
    more = [(None, sentence(rng, 50) + f" own{i % 3} own{i % 3} Ünï ΣΑΣ", "en" if i % 4 else None, ["src0", "src1", None][i % 3], 0) for i in range(60)]
    more += [(1, None, "zz", "only"), (1, "", "zz", "other"), (1, "a b", "zz", None)][:0]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    bare = spark.createDataFrame([(1, None, "zz", "only", 0), (1, "", "zz", "other", 0), (2, "a b", "zz", None, 0), (2, "a b", "yy", None, 0)], docs.schema)
    docs = docs.union(bare)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert tuples(V.audit(V.count_terms(docs, least_docs=5, **sizes), best=4)) == brute(rows, least=5, best=4)


def test_empty_table(spark):
    assert V.audit(V.count_terms(documents(spark, []))).count() == 0


def test_perfect_hash_is_minimal_and_verifies_keys():
    import pyarrow as pa

    keys = [f"key{i}".encode() for i in range(5000)]
    made = V.build_shard(keys)
    own = V.Shards(pa.Table.from_pylist([{"lang": "x", "shard": 0, **made}]))
    shard, words = own.langs["x"][0], [*keys, *(f"other{i}".encode() for i in range(5000))]
    slots = own.slots(shard, words, V.hashes_of(words))
    assert sorted(slots[:5000].tolist()) == list(range(5000)) and (slots[5000:] == -1).all()
    assert len(made["bits"]) * 8 < 6 * len(keys)


def test_keys_that_share_a_hash_get_another_seed(monkeypatch):
    hashes = V.hashes_of
    monkeypatch.setattr(V, "hashes_of", lambda words, seed=0: hashes(words, seed) if seed else np.zeros(len(words), np.uint64))
    made = V.build_shard([b"a", b"b", b"c"])
    assert made["seed"] == 1 and made["n_keys"] == 3


def test_shares_are_exact_for_large_counts():
    for total in (7, 10**15, (1 << 52) - 1, 1 << 60):
        counts = np.array([0, 1, total // 3, total - 1, total], np.int64)
        assert V.shares(counts, total).tolist() == [1 + 10**9 * int(c) // total for c in counts]


def test_vectors_are_packed_narrow_and_whole():
    for top in (0, 65535, 65536, 1 << 40):
        v = np.array([0, top, 3], np.int64)
        assert V._unpacked(V._packed(v)).tolist() == v.tolist()
