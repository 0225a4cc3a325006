import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from helpers import awkward_texts, documents

from simcat.llm import alignment as L
from simcat.llm import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, tokens put side by side one by one."""
    a, b = libraries
    table = L._byte_level()
    every = []
    for t in texts:
        raw = (" " + (t or "")).encode()
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        groups, links = [], []
        if t and b"".join(bytes_a) == raw == b"".join(bytes_b):
            i = j = 0
            end_a = end_b = 0
            group = ([], [])
            while i < len(ids_a) or j < len(ids_b):
                if end_a <= end_b:
                    end_a += len(bytes_a[i])
                    group[0].append((end_a - len(bytes_a[i]), end_a, ids_a[i]))
                    i += 1
                else:
                    end_b += len(bytes_b[j])
                    group[1].append((end_b - len(bytes_b[j]), end_b, ids_b[j]))
                    j += 1
                if end_a == end_b:
                    groups.append(group)
                    group = ([], [])
            links = [(x[2], y[2]) for ga, gb in groups for x in ga for y in gb if x[0] < y[1] and y[0] < x[1]]
        every.append((ids_a if groups else [], ids_b if groups else [], groups, links))
    counts = Counter(link for *_, links in every for link in links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(len(x), len(y), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links),
             ";".join(",".join(str(v[2]) for v in ga) + "|" + ",".join(str(v[2]) for v in gb) for ga, gb in groups)) for x, y, groups, links in every]


def test_query_equals_brute_force(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: (*row, hashlib.sha256(groups.encode()).hexdigest() if groups else "") for d, (*row, groups) in zip(docs, brute([d.text for d in docs], libraries))}
    assert {r[0]: tuple(r[1:]) for r in queries.op13_token_alignment(spark, sf).collect()} == want


def strange(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\r", "\r\n", "\t", ".", ";", ".\r", "{\r", "'s", "don't", "I'LL", "über", "ÿ", "Straße", "ő", "日本語", "😀", "a", "the", "tion", "ing", "0", "2024", "=====",
             "\xa0", " ", "　", "\x85", "\x00", "\x1c", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "é", "é", "-", "_", "ab cd", "X"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_awkward_rows_and_clashing_columns(spark, libraries, monkeypatch, small):
    texts = [*awkward_texts(), *strange(400, 5), "▁", "x▁y", " ▁", *[strange(1, 7)[0]] * 30]
    docs = documents(spark, texts, extra=True).withColumnRenamed("slot", "N_Best").withColumnRenamed("kept", "groups")
    aligned = L.align(docs, A, B)
    out = L.score(aligned, A, B, **({"bundle_pairs": 500} if small else {}))
    got = sorted(tuple(r) for r in out.select(*L.COUNTS, "n_best", "count_sum", "groups").collect())
    assert got == sorted(brute([r.text for r in docs.collect()], libraries))
    assert len({c.lower() for c in out.columns}) == len(out.columns)


def test_empty_table(spark):
    assert L.score(L.align(documents(spark, []), A, B), A, B).count() == 0


def test_a_full_table_of_units_is_emptied(libraries):
    with open(A, "rb") as a, open(B, "rb") as b:
        own = L.Aligner(a.read(), b.read(), table_bytes=20_000)
    texts = strange(300, 9)
    got = [row for t in texts for row in own.align([t])]
    assert own.used < 200_000 and [(*x[:4], x[6]) for x in got] == [(*x[:4], x[6]) for x in brute(texts, libraries)]


def test_pairs_are_passed_on_when_a_task_holds_many(spark, libraries):
    aligned = L.align(documents(spark, strange(200, 4)), A, B)
    assert sorted(map(tuple, L.count_pairs(aligned, held=50).collect())) == sorted(map(tuple, L.count_pairs(aligned).collect()))
