"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

A text's words are its runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. An
item gives all its windows of ``width`` consecutive words; an item of fewer words is one window. The
items are cut into pieces of bounded length (neighbours share ``width`` - 1 words, so no window
is lost), equal pieces are kept once, and the pieces are dealt by hash into bundles of about
``BUNDLE_BYTES``. A bundle is broadcast and compiled in each Python worker: the bundle's vocabulary, the
pieces as word numbers, and one sorted array of window hashes per window length. Documents are scanned in
place: words are numbered by the vocabulary, windows with an unknown word can't match, the
others' hashes are looked up, and every hit is verified word by word against the piece it comes
from. Two different windows of a bundle never share a hash: a clash is met by another multiplier.

One bundle is one scan without any shuffle. More bundles scan the documents once each and keep the
texts with hits only, known by their SHA-256, whose hits are then united and joined back.

Defined results: null, empty and blank texts have no words, hits or items; items without words don't
exist; an item without an id counts as the item ''; items of equal id are one item; repeated rows give
repeated rows; empty tables work on either side; extra columns pass through, but for those with a
result's name. Texts are scanned whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import materialise, tmp_names, without

WIDTH = 10
#: Words of a piece of an item; bytes of pieces that a bundle is planned for; bytes of text scanned at once.
PIECE, BUNDLE_BYTES, _AT_ONCE = 2048, 16 << 20, 4 << 20
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_NO_HITS, _NO_ITEMS = "cast(array() as array<struct<first: long, last: long>>)", "cast(array() as array<string>)"
#: Every byte of a word as it is compared, every other byte as a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_COMPILED: dict = {}


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, lower-cased."""
    return text.translate(_FOLD).split()


def _scatter(x: np.ndarray, multiplier: int) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(multiplier)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


class WindowSet:
    """The windows of pieces, given as (item, words joined by spaces)."""

    def __init__(self, items: list[str], pieces: list[bytes], width: int = WIDTH):
        self.width, self.names = width, sorted(set(items))
        number = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        rows = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in p.split(b" ")] for p in pieces]
        sizes = np.array([len(r) for r in rows], np.int64)
        self.words = np.fromiter((w for r in rows for w in r), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        owners = np.array([number[i] for i in items], np.int64)
        multiplier = 0x9E3779B97F4A7C15
        while not self._compile(starts, sizes, owners, multiplier):
            multiplier = (multiplier * 0x5851F42D4C957F2D + 0x14057B7EF767814F | 1) & (1 << 64) - 1

    def _compile(self, starts, sizes, owners, multiplier: int) -> bool:
        """Build the sets; False if two different windows of one length share a hash."""
        self.codes = _scatter(np.arange(len(self.vocabulary), dtype=np.uint64), multiplier)
        self.sets: dict[int, tuple] = {}  # window length: (sorted hashes, place of each window, offsets of its items, items)
        lengths = np.minimum(sizes, self.width)
        for n in np.unique(lengths).tolist():
            mine = lengths == n
            counts = sizes[mine] - n + 1
            which = np.repeat(np.arange(len(counts)), counts)
            at = starts[mine][which] + np.arange(len(which)) - (np.cumsum(counts) - counts)[which]
            hashes, who = self._hashes(self.words, at, n), owners[mine][which]
            order = np.lexsort((who, hashes))
            hashes, at, who = hashes[order], at[order], who[order]
            new = np.r_[True, hashes[1:] != hashes[:-1]]
            group = np.cumsum(new) - 1
            place = at[new]
            if not all(np.array_equal(self.words[at + j], self.words[place[group] + j]) for j in range(n)):
                return False
            own = np.r_[True, (group[1:] != group[:-1]) | (who[1:] != who[:-1])]
            self.sets[n] = hashes[new], place, np.searchsorted(group[own], np.arange(len(place) + 1)), who[own]
        return True

    def _hashes(self, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ self.codes[words[at + j]]
            h ^= h >> np.uint64(31)
        return h

    def scan(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each text its number of words, the runs of hit words (first, last), the items sorted."""
        rows = [words_of(t) for t in texts]
        counts = [len(r) for r in rows]
        get = self.vocabulary.get
        # a place without a word stands behind each text, so no window runs into the next one
        ids = np.full(sum(counts) + len(counts), -1, np.int64)
        starts = np.cumsum(np.array([0, *(n + 1 for n in counts)], np.int64))
        for row, at in zip(rows, starts.tolist()):
            ids[at : at + len(row)] = np.fromiter(map(get, row, repeat(-1)), np.int64, len(row))
        unknown = np.cumsum(np.r_[0, ids < 0])
        change = np.zeros(len(ids) + 1, np.int64)
        met: list[tuple[np.ndarray, np.ndarray, int]] = []
        for n, (hashes, place, _, _) in self.sets.items():
            at = np.flatnonzero(unknown[n:] == unknown[: len(unknown) - n])
            if not len(at):
                continue
            h = self._hashes(ids, at, n)
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[found] == h
            at, found = at[same], found[same]
            for j in range(n):  # verified word by word
                same = self.words[place[found] + j] == ids[at + j]
                at, found = at[same], found[same]
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            met.append((np.searchsorted(starts, at, "right") - 1, found, n))
        edges = np.diff(np.r_[0, np.cumsum(change)[:-1] > 0, 0].astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        runs: list[list] = [[] for _ in texts]
        for t, a, b in zip((np.searchsorted(starts, first, "right") - 1).tolist(), first.tolist(), last.tolist()):
            runs[t].append((a - int(starts[t]), b - int(starts[t])))
        return counts, runs, self._items(met, len(texts))

    def _items(self, met: list, n_texts: int) -> list[list[str]]:
        seen: list[np.ndarray | None] = [None] * n_texts
        for text, window, n in met:
            _, _, offsets, owners = self.sets[n]
            order = np.argsort(text, kind="stable")
            text, window = text[order], window[order]
            for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1) if len(text) else []:
                t, own = int(text[part[0]]), [owners[offsets[w] : offsets[w + 1]] for w in np.unique(window[part])]
                seen[t] = np.unique(np.concatenate(own if seen[t] is None else [seen[t], *own]))
        return [[] if s is None else [self.names[i] for i in s.tolist()] for s in seen]


def _compiled(key: str, table: pa.Table, width: int) -> WindowSet:
    """The window set of a broadcast bundle, compiled once in each Python worker."""
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = WindowSet(table.column(0).to_pylist(), table.column(1).to_pylist(), width)
    return _COMPILED[key]


def item_pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH, piece: int = PIECE) -> DataFrame:
    """(item, words) of the items' pieces, equal ones once; words: binary, joined by spaces."""
    step = piece - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bytes]] = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(body)
                if 0 < len(words) < width:
                    out.append((name, b" ".join(words)))
                else:
                    out += [(name, b" ".join(words[at : at + piece])) for at in range(0, len(words) - width + 1, step)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["item", "words"])

    source = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return source.mapInArrow(run, "item string, words binary").dropDuplicates()


def _bundles(pieces: DataFrame, bundle_bytes: int) -> Iterator[pa.Table]:
    """The pieces in bundles of about ``bundle_bytes`` (one piece at least), one after another."""
    size = F.octet_length("words") + F.octet_length("item") + 64
    total, largest = pieces.agg(F.sum(size), F.max(size)).first()
    count = 1 + int(total or 0) // bundle_bytes
    while True:
        dealt = pieces.withColumn("bundle", F.pmod(F.xxhash64("item", "words"), F.lit(count)))
        heaviest = dealt.groupBy("bundle").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0
        if heaviest <= max(2 * bundle_bytes, largest or 0):
            break
        count *= 2
    for i in range(count):
        yield dealt.filter(F.col("bundle") == i).select("item", "words").toArrow()


def _scan(docs: DataFrame, bundle: pa.Table, text: str, width: int) -> DataFrame:
    """``docs`` with what this bundle finds in them. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(bundle)
    key, at = uuid.uuid4().hex, docs.columns.index(text)
    schema = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.expr(_NO_HITS), "items": F.expr(_NO_ITEMS)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _compiled(key, sent.value, width)
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            n: list = []
            hits: list = []
            items: list = []
            for part in slices(texts, len, _AT_ONCE):
                for whole, made in zip((n, hits, items), own.scan(part)):
                    whole += made
            runs = pa.array([[{"first": a, "last": b} for a, b in x] for x in hits], _RUNS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), runs, pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _united(found: DataFrame) -> DataFrame:
    """(digest, hits, items) of texts from several bundles, each text once."""
    both = found.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(1).to_pylist():
                merged: list[dict] = []
                for r in sorted(runs, key=lambda r: r["first"]):
                    if merged and r["first"] <= merged[-1]["last"] + 1:
                        merged[-1]["last"] = max(merged[-1]["last"], r["last"])
                    else:
                        merged.append(r)
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _RUNS), batch.column(2)], names=["digest", "hits", "items"])

    return both.mapInArrow(run, both.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", width: int = WIDTH, bundle_bytes: int = BUNDLE_BYTES, piece: int = PIECE) -> DataFrame:
    """``docs`` with n_words, hits (runs of hit words, as places from 0) and items (the ids of the
    items with windows in the text, as strings, sorted)."""
    docs = without(docs, "n_words", "hits", "items")
    pieces = materialise(item_pieces(benchmark, item, text, width, piece), "benchmark-pieces")
    bundles = _bundles(pieces, bundle_bytes)
    first, second = next(bundles), next(bundles, None)
    if second is None:
        return _scan(docs, first, text, width)
    (digest,) = tmp_names(docs.columns, "digest")
    known = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    parts = []
    for bundle in (first, second, *bundles):
        found = _scan(docs.select(text), bundle, text, width).filter(F.size("hits") > 0).select(known.alias("digest"), "hits", "items")
        parts.append(materialise(found.dropDuplicates(["digest"]), "benchmark-hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    counted = _scan(docs, first.slice(0, 0), text, width).drop("hits", "items").withColumn(digest, known)
    joined = counted.join(_united(hits).withColumnRenamed("digest", digest), digest, "left").drop(digest)
    return joined.withColumns({"hits": F.coalesce("hits", F.expr(_NO_HITS)), "items": F.coalesce("items", F.expr(_NO_ITEMS))})


def hit_words(hits: str = "hits"):
    """How many words the runs cover."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def cut_spans(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """A text without the bytes from the first to the last word of each run."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in runs:
        out.append(text[at : places[a][0]])
        at = places[b][1]
    return b"".join([*out, text[at:]])


def remove_leaks(found: DataFrame, whole_documents: bool = False, text: str = "text") -> DataFrame:
    """The result of ``find_leaks`` without the documents that have hits, or with each run of hit
    words cut out of their texts; its own three columns go."""
    if whole_documents:
        return found.filter(F.size("hits") == 0).drop("n_words", "hits", "items")
    names = found.columns
    at, runs_at = names.index(text), names.index("hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            runs = batch.column(runs_at).to_pylist()
            cut = [cut_spans(t, [(r["first"], r["last"]) for r in own]) if own else t for t, own in zip(texts, runs)]
            columns = [*batch.columns]
            columns[at] = pa.array(cut, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(run, found.schema).drop("n_words", "hits", "items")
