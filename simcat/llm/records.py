"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

File format. A record is::

    length   unsigned 64-bit, little-endian: bytes of the payload
    check    masked CRC-32 of the 8 length bytes, unsigned 32-bit
    payload
    check    masked CRC-32 of the payload, unsigned 32-bit
    mark     one byte, 0x0A, that ends every record

A mask rotates the checksum right by 15 bits and adds 0xA282EAD8. A payload is a flag byte (1: the
id is null, 2: tokens are 16 bits wide, otherwise 32), the document id as a signed 64-bit
integer, and the tokens, little-endian.

Documents are dealt over files by ranges of (id, hash of text) and sorted inside, so file after
file the ids ascend; the texts are shuffled and encoded behind the shuffle, once. Files are
written by Spark's text writer, the mark being its line separator: a lost task is written
again and committed once, on any file system Spark knows. The number of files follows from
the bytes of text, ``FILE_BYTES`` each, so a reader holds one file of bounded size.

The index (Parquet) has, for each record, its file, offset, length, id, number of tokens and
the tokens before it in the file. ``read_at`` fetches any records by their index rows.

Defined results: null texts are encoded as empty ones, so each document has the end id at
least; null ids come first; rows with equal ids keep all their records, ordered by their texts;
an empty table makes no records; a damaged record raises an error that names file and offset.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Memo
from .common import UNICODE_SPACE, shared_dir

#: Bytes of text that a file is planned for; texts encoded at once.
FILE_BYTES, _ROWS = 16 << 20, 256
_HEAD, _CHECK, _PAYLOAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
_FRAME = _HEAD.size + 2 * _CHECK.size + 1
#: Files that one window numbers.
_BLOCK = 1024
_CODERS: dict = {}
#: Latin letters; a run of them that an ASCII character or nothing follows is a token's text by itself.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of such letters, or of non-spaces, with the space before it; of white space before a word, the last is apart.
_UNIT = re.compile(f" ?[{_LATIN}]+(?=[\x00-@\\[-`{{-\x7f]|$)| ?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+")
#: Units that are encoded in one call.
_RUN = 2048


def masked(data: bytes) -> int:
    c = crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its closing mark."""
    head = _HEAD.pack(len(payload))
    return head + _CHECK.pack(masked(head)) + payload + _CHECK.pack(masked(payload))


def unframe(data: memoryview, at: int, where: str) -> tuple[memoryview, int]:
    """The payload of the record at an offset, and the offset of the next one."""
    if at + _HEAD.size + _CHECK.size > len(data):
        raise ValueError(f"{where}: record at {at} is cut off")
    head = bytes(data[at : at + _HEAD.size])
    (size,), (check,) = _HEAD.unpack(head), _CHECK.unpack_from(data, at + _HEAD.size)
    start, stop = at + _HEAD.size + _CHECK.size, at + _HEAD.size + _CHECK.size + size
    if masked(head) != check or stop + _CHECK.size + 1 > len(data):
        raise ValueError(f"{where}: record at {at} has a wrong length")
    payload = data[start:stop]
    if _CHECK.unpack_from(data, stop)[0] != masked(payload) or data[stop + _CHECK.size] != 0x0A:
        raise ValueError(f"{where}: record at {at} is damaged")
    return payload, stop + _CHECK.size + 1


def pack(key: int | None, tokens: np.ndarray) -> bytes:
    narrow = not len(tokens) or int(tokens.max()) < 1 << 16
    return _PAYLOAD.pack((key is None) | narrow << 1, key or 0) + tokens.astype("<u2" if narrow else "<u4").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, key = _PAYLOAD.unpack_from(payload)
    return None if flags & 1 else key, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=_PAYLOAD.size).astype("<u4")


class TextEncoder:
    """Encodes texts with the tokenizers library, a unit at a time, through a memo.

    Byte-level pre-tokenisation (the library's own pattern, no prefix space, no normalizer) always
    ends a token where letters meet ASCII that is no letter, begins one at a space between two
    words, and takes white space before a word as one token but for its last character, so such
    units are encoded apart. New units of a space and letters are strung together, encoded in one call,
    and told apart again by the bytes their tokens stand for. Texts that hold a special string, and
    files of another kind, are encoded whole."""

    def __init__(self, file: bytes):
        self.library = tokenizers.Tokenizer.from_buffer(file)
        spec = json.loads(file)
        pre = spec["pre_tokenizer"] or {}
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not spec["normalizer"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = self.library.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)  # a byte-level token has a character per byte
        self.memo = Memo(self._units, cap=500_000)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, units: list[str]) -> list[bytes]:
        """Plain units in one call."""
        ids = np.array(self.library.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(u.encode()) for u in units])
        at = np.cumsum(self.sizes[ids])
        stops = np.searchsorted(at, ends) + 1
        if not np.array_equal(at[stops - 1], ends):
            return self._encode(units)
        data, stops = ids.tobytes(), (4 * stops).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _units(self, units: list[str]) -> list[bytes]:
        plain = [u for u in units if u[0] == " " and u[1:].isalpha()]
        made = {}
        for at in range(0, len(plain), _RUN):
            made.update(zip(plain[at : at + _RUN], self._run(plain[at : at + _RUN])))
        rest = [u for u in units if u not in made]
        made.update(zip(rest, self._encode(rest)))
        return [made[u] for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        whole = [i for i, t in enumerate(texts) if not self.apart or any(s in t for s in self.special)]
        skip = set(whole)
        out = [b"".join(x) for x in self.memo.values([[] if i in skip else _UNIT.findall(t) for i, t in enumerate(texts)])]
        for i, x in zip(whole, self._encode([texts[i] for i in whole]) if whole else []):
            out[i] = x
        return out


def text_encoder(file: bytes) -> TextEncoder:
    """The encoder of a tokenizer file, loaded once in each Python worker."""
    key = (len(file), crc32(file))
    if key not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _CODERS.clear()
        _CODERS[key] = TextEncoder(file)
    return _CODERS[key]


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", path: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Encode and write all documents in ascending order of their ids; the folder of the files."""
    path = path or shared_dir(docs.sparkSession, "llm", "records")
    with open(tokenizer_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = source.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("t")]
    dealt = source.repartitionByRange(1 + total // file_bytes, *order[:2]).sortWithinPartitions(*order)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                keys, texts = (c.to_pylist() for c in batch.slice(at, _ROWS).columns)
                made = [frame(pack(k, np.frombuffer(x + last, "<u4"))) for k, x in zip(keys, coder.encode(texts))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    dealt.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, content) of the record files; file numbers ascend with the ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), F.col("path").alias("name"), "content")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, key, n_tokens, before, ids_crc32) of all records, each checked; before:
    tokens before it in its file. Written, this is the offset index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name, content in zip(*(batch.column(i) for i in range(3))):
                data, at, seen, rows = memoryview(content.as_buffer()), 0, 0, []
                number, name = number.as_py(), name.as_py()
                while at < len(data):
                    payload, after = unframe(data, at, name)
                    key, ids = unpack(payload)
                    rows.append((number, at, after - at, key, len(ids), seen, crc32(ids.tobytes())))
                    at, seen = after, seen + len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 7)], names=["file", "offset", "length", "key", "n_tokens", "before", "ids_crc32"])

    return _files(spark, path).mapInArrow(run, "file long, offset long, length long, key long, n_tokens long, before long, ids_crc32 long")


def write_index(spark: SparkSession, path: str, index_path: str | None = None) -> DataFrame:
    """Read the files once, write their offset index, return it."""
    index_path = index_path or shared_dir(spark, "llm", "records-index")
    made = scan_records(spark, path)
    made.write.parquet(index_path)
    return spark.read.schema(made.schema).parquet(index_path)


def with_start(index: DataFrame) -> DataFrame:
    """``index`` with start: the tokens of all records before, over all files. Files are summed
    in blocks, and blocks in turn, so no window holds more than a block of files."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("file") / _BLOCK))
    blocks = files.groupBy("block").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", before(Window.partitionBy(F.floor(F.col("block") / F.lit(1 << 40))).orderBy("block")).alias("block_start"))
    bases = files.withColumn("in_block", before(Window.partitionBy("block").orderBy("file"))).join(blocks, "block")
    return index.join(bases.select("file", (F.col("block_start") + F.col("in_block")).alias("base")), "file").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(key, ids array<long>) of the records that rows of the index name, in any order; a row asked
    for twice comes twice. Requests meet their file, not the other way round."""
    asked = wanted.select("file", "offset").groupBy("file").agg(F.collect_list("offset").alias("offsets"))
    met = _files(spark, path).join(asked, "file").select("name", "content", "offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, offsets in zip(*(batch.column(i) for i in range(3))):
                data = memoryview(content.as_buffer())
                rows = [unpack(unframe(data, at, name.as_py())[0]) for at in offsets.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x.astype(np.int64) for _, x in rows], pa.list_(pa.int64()))], names=["key", "ids"])

    return met.mapInArrow(run, "key long, ids array<long>")
