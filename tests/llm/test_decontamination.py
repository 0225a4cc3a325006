import hashlib
import re

import pytest
from helpers import documents, sentence

import random

from simcat.llm import decontamination as D
from simcat.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, width=10):
    """(n_words, hit places, items) of each text."""
    windows: dict = {}
    for name, body in items:
        w = words(body)
        n = min(width, len(w))
        for at in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[at : at + n]), set()).add("" if name is None else str(name))
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, own = words(t), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[at : at + n]))):
                    hit.update(range(at, at + n))
                    own |= found
        out.append((len(w), sorted(hit), sorted(own)))
    return out


def seen(rows):
    return sorted((r.n_words, [p for h in r.hits for p in range(h["first"], h["last"] + 1)], r["items"]) for r in rows)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {d.doc_id: (n, len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(hit))
            for d, (n, hit, own) in zip(docs, brute([d.text for d in docs], items))}
    got = {r[0]: tuple(r[1:]) for r in queries.op11_decontamination(spark, sf).collect()}
    assert got == want and any(r[4] for r in got.values())


def awkward(rng):
    long_item = sentence(rng, 90)
    items = [(1, long_item), (1, long_item), (2, "Short ITEM"), (3, "é日本"), (4, None), (5, " .,\n"), (None, sentence(rng, 12)),
             (10, long_item.upper().replace(" ", " - ")), (6, " ".join(["same"] * 30)), (7, "one"), (7, sentence(rng, 40))]
    texts = [None, "", "...", "a short item, a SHORT\nitem", "x é日本 y", "same " * 200, long_item, "Zz " + long_item[5:300] + " end", "one",
             items[6][1], sentence(rng, 20000) + " short item", items[10][1] + " " + items[10][1], "on e", "short-item one one"]
    return items, texts


@pytest.mark.parametrize("bundle_bytes", [1 << 20, 300])
def test_awkward_rows_one_bundle_and_many(spark, bundle_bytes):
    items, texts = awkward(random.Random(3))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, hits int")
    docs = documents(spark, texts, extra=True).withColumnRenamed("slot", "Hits")
    out = D.find_leaks(docs, bench, bundle_bytes=bundle_bytes, piece=24)
    own = [r.text for r in docs.collect()]
    assert seen(out.collect()) == sorted(brute(own, items))
    assert {c.lower() for c in out.columns} == {c.lower() for c in docs.columns} | {"n_words", "hits", "items"}


def test_empty_tables(spark):
    items, texts = awkward(random.Random(3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.find_leaks(documents(spark, []), bench).count() == 0
    assert seen(D.find_leaks(documents(spark, texts), bench.limit(0)).collect()) == sorted((len(words(t)), [], []) for t in texts)


def test_spans_or_documents_go(spark):
    leak = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    texts = [f"Start. {leak.upper()}, eleven; end", leak, "clean é text", None, f"a {leak} {leak} b {leak}!"]
    found = D.find_leaks(documents(spark, texts), bench)
    assert sorted(r.text or "" for r in D.remove_leaks(found).collect()) == sorted(["Start. , eleven; end", "", "clean é text", "", "a  b !"])
    assert sorted(r.text or "" for r in D.remove_leaks(found, whole_documents=True).collect()) == ["", "clean é text"]
    assert D.remove_leaks(found).columns == documents(spark, []).columns


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    """A first multiplier under which all words look alike is given up."""
    scatter = D._scatter
    monkeypatch.setattr(D, "_scatter", lambda x, m: x * 0 if m == 0x9E3779B97F4A7C15 else scatter(x, m))
    own = D.WindowSet(["a", "b"], [b"x y z", b"z y x"], width=2)
    assert own.scan([b"q x y"])[1:] == ([[(1, 2)]], [["a"]])
