"""SentencePiece coding and transducer counts against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from helpers import awkward_texts, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from simcat.llm import queries, sentencepieces, tokencount
from simcat.llm.bpe import Memo

MODEL, COUNTER = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("aeinrst th.,'0 \n▁ΣÉ<|>"), st.characters(codec="utf-8")), max_size=80)


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def word():
    return tokenizers.Tokenizer.from_file(COUNTER)


@pytest.fixture(scope="module")
def coder():
    return sentencepieces.PieceCoder(open(MODEL, "rb").read())


@pytest.fixture(scope="module")
def counter():
    return tokencount.TokenCounter(open(COUNTER, "rb").read())


def odd_texts(n=800):
    rng = random.Random(6)
    return ["".join(rng.choice("aeinrst th.,'0 \nΣé<|>") for _ in range(rng.randint(0, 90))) for _ in range(n)] + [t or "" for t in awkward_texts()]


def test_queries_equal_the_libraries(spark, sf, piece, word):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want8, want10 = {}, {}
    for i, t in docs:
        x = piece.encode(t or "", add_bos=True, add_eos=True)
        want8[i] = (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(piece.decode(x).encode()).hexdigest())
        n = len(word.encode(t or "", add_special_tokens=False).ids)
        want10[i] = (len((t or "").encode()), n, n > 2048)
    assert {r[0]: tuple(r[1:]) for r in queries.op8_sentencepiece(spark, sf).collect()} == want8
    assert {r[0]: tuple(r[1:]) for r in queries.op10_token_counts(spark, sf).collect()} == want10


def test_pieces_equal_the_library(piece, coder):
    texts = odd_texts()
    got = [np.frombuffer(x, "<u4").tolist() for x in coder.encode_many(texts)]
    assert got == [piece.encode(t, add_bos=True, add_eos=True) for t in texts]
    # uncut texts give the same: the cut is no approximation
    assert all(coder.unit(sentencepieces.MARK + t.replace(" ", sentencepieces.MARK)) == b"".join(coder.memo.values([coder.units(t)])[0]) for t in texts if t)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text(piece, coder, word, counter, text):
    assert np.frombuffer(coder.encode_many([text])[0], "<u4").tolist() == piece.encode(text, add_bos=True, add_eos=True)
    assert counter.count_many([text]) == [len(word.encode(text, add_special_tokens=False).ids)]


def test_counts_equal_the_library(word, counter):
    texts = odd_texts()
    want = [len(x.ids) for x in word.encode_batch(texts, add_special_tokens=False)]
    assert counter.count_many(texts) == want
    counter.machine.reset()
    counter.machine.limit = 50  # states are dropped and made again
    counter.memo.known.clear()
    assert counter.count_many(texts) == want


def test_chunk_maps_compose(counter):
    machine, symbols = counter.machine, "internationalisation"
    state, total = machine.run(symbols)
    for cut in range(1, len(symbols)):
        mid, a = machine.run(symbols[:cut])
        end, b = machine.run(symbols[cut:], mid)
        assert (end, a + b) == (state, total)
    counts = list(np.random.default_rng(0).integers(0, 9, 5000))
    assert tokencount.scan(counts).tolist() == np.cumsum(counts).tolist()


def test_long_words_are_composed_of_pieces(word, counter):
    """Words beyond ``PIECE`` bytes, and the maps of their pieces in any grouping."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["in", "ter", "nation", "al", "isa", "tion", "s", "é", "q"]) for _ in range(40_000)), "x" * 150_001, "ab" * 70_000, "日本語" * 30_000]
    assert all(len(t.encode()) > tokencount.PIECE for t in texts)
    assert counter.count_many(texts) == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]
    machine, symbols = counter.machine, texts[0].encode().decode("latin-1")[:4000]
    whole = machine.run(symbols)
    for lead in (0, 3, 64):  # guesses that meet no entry are completed
        maps = tokencount.piece_maps(machine, symbols, 300, lead)
        scanned = tokencount.compose(maps)
        at, total = 0, 0
        for i, m in enumerate(scanned):
            at, n = machine.run(symbols[300 * i : 300 * (i + 1)], at)
            total += n
            assert m(0) == (at, total)
        assert scanned[-1](0) == whole
        for cut in (1, 5, 13):
            left, right = tokencount.compose(maps[:cut])[-1], tokencount.compose(maps[cut:])[-1]
            assert left.then(right)(0) == whole
        for entry in (0, machine.run("inter")[0], machine.run("q")[0]):
            assert maps[3](entry) == machine.run(symbols[900:1200], entry)


def test_memo_holds_to_its_bytes():
    """Texts without spaces: their units are long and never stay; short ones stay up to the room."""
    memo = Memo(lambda xs: [x.encode() for x in xs], room=10_000)
    long = ["日本語" * 3000 + str(i) for i in range(40)]
    assert memo.values([long]) == [[x.encode() for x in long]] and not memo.known
    short = [f"unit{i}" for i in range(500)]
    assert memo.values([short]) == [[x.encode() for x in short]]
    assert 0 < len(memo.known) < 60 and sum(200 + 4 * len(k) + len(v) for k, v in memo.known.items()) <= 10_000
    assert memo.values([short]) == [[x.encode() for x in short]]


def test_awkward_tables(spark, piece, word):
    docs = documents(spark, extra=True).withColumnRenamed("t", "ids").withColumnRenamed("shard", "n_tokens")
    out = sentencepieces.encode(docs, MODEL)
    assert sorted(out.columns) == sorted([*docs.columns, "decoded"])
    for r in out.collect():
        x = piece.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == x and r.decoded == piece.decode(x)
    back = sentencepieces.decode(out.drop("text"), MODEL)
    assert sorted(r.text for r in back.collect()) == sorted(r.decoded for r in out.collect())
    counted = tokencount.count_tokens(docs, COUNTER)
    assert sorted(counted.columns) == sorted(docs.columns)
    assert all(r.n_tokens == len(word.encode(r.text or "", add_special_tokens=False).ids) for r in counted.collect())
    empty = documents(spark, [])
    assert sentencepieces.encode(empty, MODEL).count() == tokencount.count_tokens(empty, COUNTER).count() == 0


def test_memo_is_bounded_and_right():
    calls = []
    memo = Memo(lambda xs: calls.append(len(xs)) or [len(x) for x in xs], cap=3)
    assert memo.values([["a", "bb"], [], ["bb", "ccc"]]) == [[1, 2], [], [2, 3]]
    assert memo.values([["dddd", "a"]]) == [[4, 1]] and len(memo.known) == 3
    assert memo.values([["dddd"]]) == [[4]] and calls == [3, 1, 1]


def test_every_code_point(word, counter, piece, coder):
    for plane in (0, 1):
        texts = [f"a{chr(c)}b {chr(c)}" for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c < 0xE000]
        assert counter.count_many(texts) == [len(x.ids) for x in word.encode_batch_fast(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_many(texts)] == piece.encode(texts, add_bos=True, add_eos=True)
