import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from helpers import awkward_texts, documents

from simcat.llm import queries, records

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(FILE)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def test_query_equals_the_library(spark, sf, library):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want, at = {}, 0
    for i, t in docs:
        x = ids(library, t)
        want[i] = (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert {r[0]: tuple(r[1:]) for r in queries.op7_token_records(spark, sf).collect()} == want


def test_round_trip_of_awkward_rows_in_many_files(spark, library):
    docs = documents(spark, extra=True)
    path = records.write_records(docs, FILE, 2, file_bytes=2000)
    index = records.write_index(spark, path)
    assert index.select("file").distinct().count() > 3
    rows = sorted(records.with_start(index).collect(), key=lambda r: r.start)
    assert [r.key is None for r in rows] == sorted((r.key is None for r in rows), reverse=True)
    keys = [r.key for r in rows if r.key is not None]
    assert keys == sorted(keys) and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    back = sorted((r.key is None, r.key or 0, r.ids) for r in records.read_at(spark, path, index).collect())
    assert back == sorted((r.doc_id is None, r.doc_id or 0, ids(library, r.text)) for r in docs.collect())


def test_shuffled_reads_take_any_rows(spark, library):
    docs = documents(spark)
    path = records.write_records(docs, FILE, 2, file_bytes=3000)
    index = records.write_index(spark, path)
    some = index.filter("key in (3, 60, 9, 17)")
    got = {r.key: r.ids for r in records.read_at(spark, path, some.unionByName(some.filter("key = 9"))).collect()}
    texts = awkward_texts()
    assert got == {k: ids(library, texts[k]) for k in (3, 60, 9, 17)}


def test_damage_is_found(spark):
    path = records.write_records(documents(spark), FILE, 2)
    name = sorted(glob.glob(path.removeprefix("file:") + "/part-*"))[0].replace("//", "/")
    data = bytearray(open(name, "rb").read())
    for at in (3, 9, 40, len(data) - 2):
        broken = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises(ValueError, match="record at"):
            offset = 0
            while offset < len(broken):
                _, offset = records.unframe(memoryview(broken), offset, name)
    with pytest.raises(ValueError, match="cut off|wrong length"):
        records.unframe(memoryview(bytes(data[:6])), 0, name)


def test_encoder_equals_the_library_on_odd_space(library):
    coder = records.TextEncoder(open(FILE, "rb").read())
    texts = [t or "" for t in awkward_texts()] + ["a  b", "a \n b\n\n", " \x1ca \x1c\x1d", "x  y　", "\n\n<|endoftext|> \n a", "a b \u0085 c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_wide_ids_and_empty(spark):
    key, back = records.unpack(memoryview(records.pack(None, np.array([1, 1 << 17], "<u4"))))
    assert key is None and back.tolist() == [1, 1 << 17]
    path = records.write_records(documents(spark, []), FILE, 2)
    assert records.with_start(records.write_index(spark, path)).count() == 0
