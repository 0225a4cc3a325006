"""Source divergence audit: exact term counts per (language, source) through minimal perfect hashes.

Terms are runs of ASCII letters (lower-cased) and characters beyond ASCII. The first pass counts for
every language the documents that hold a term, exactly (summed per task before the shuffle), and
keeps the terms in ``least_docs`` documents or more. Kept terms are dealt by hash into shards of about
``SHARD_KEYS`` keys, and each shard gets a minimal perfect hash: a cascade of bit levels, where a key
stays at the first level on which it stands alone, and its slot is the number of set bits before it.
A shard keeps its keys in slot order.

The second pass broadcasts the shards, ``BUNDLE_BYTES`` at a time: a task looks every distinct word of
a batch up, compares it with the key stored in its slot, and adds its count to the dense vector
of its group and shard. Vectors are summed by (language, source, shard) as they stream through the
tasks behind the shuffle. Several bundles mean several scans of the documents.

The audit compares smoothed shares p = 1 + floor(10^9 * (count + smooth) / (N + smooth * V)) of the
groups of a language shard by shard: a task holds one shard's vectors of all sources of a language and
gives one partial sum per pair of sources and each source's ``best`` terms, never a row per pair and term.

Defined results: null text, language and source are the empty string; a group without terms has
counts of 0; a language without kept terms has pairs of value 0 and no terms; repeated rows are
documents of their own; an empty table gives no rows; other columns of the documents are not read.
Texts are read whole. All arithmetic is in integers.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import materialise

LEAST_DOCS, SMOOTH, BEST = 30, 5, 50
#: Keys that a shard is planned for; bytes of shards broadcast at once; counters that a task holds.
SHARD_KEYS, BUNDLE_BYTES, COUNTERS = 4096, 32 << 20, 4 << 20
#: Entries of the document counts that a task holds; bytes of text split at once.
_ENTRIES, _AT_ONCE = 300_000, 4 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COMPILED: dict = {}


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, lower-cased."""
    return text.translate(_FOLD).split()


def hashes_of(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _at_level(h: np.ndarray, level: int, size) -> np.ndarray:
    """A key's place on a level of ``size`` bits."""
    x = (h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(11)) % np.asarray(size, np.uint64)


def build_levels(h: np.ndarray) -> list[np.ndarray] | None:
    """The bit levels (each a boolean array) of distinct hashes; None if two keys share a hash."""
    if len(np.unique(h)) < len(h):
        return None
    levels = []
    while len(h):
        size = 2 * len(h) + 1
        at = _at_level(h, len(levels), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        h = h[~alone[at]]
    return levels


def build_shard(keys: list[bytes]) -> dict:
    """A shard: seed, level sizes, packed bits, the keys in slot order as one blob, their ends."""
    seed, levels = 0, build_levels(hashes_of(keys))
    while levels is None:
        seed += 1
        levels = build_levels(hashes_of(keys, seed))
    h, bits = hashes_of(keys, seed), np.concatenate(levels)
    slots, before = np.full(len(keys), -1), 0
    rank = np.cumsum(bits) - 1
    for i, level in enumerate(levels):
        at = _at_level(h, i, len(level)).astype(np.int64)
        here = (slots < 0) & level[at]
        slots[here] = rank[before + at[here]]
        before += len(level)
    ordered = [keys[i] for i in np.argsort(slots)]
    return {"n_keys": len(keys), "seed": seed, "sizes": [len(x) for x in levels], "bits": np.packbits(bits).tobytes(),
            "keys": b"".join(ordered), "ends": np.cumsum([len(k) for k in ordered]).astype("<i8").tobytes()}


_SHARD = "lang string, shard long, n_keys long, seed long, sizes array<long>, bits binary, keys binary, ends binary"


class Shards:
    """Shards of one or more languages, for look-ups of many words at once."""

    def __init__(self, table: pa.Table):
        rows = table.to_pylist()
        self.langs: dict[str, dict] = defaultdict(dict)
        for r in rows:
            sizes = np.array(r["sizes"], np.int64)
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
            ends = np.frombuffer(r["ends"], "<i8")
            self.langs[r["lang"]][r["shard"]] = {"seed": r["seed"], "sizes": sizes, "at": np.cumsum(sizes) - sizes, "bits": bits,
                                                 "rank": (np.cumsum(bits) - 1).astype(np.int32), "keys": r["keys"], "ends": ends, "starts": np.r_[0, ends[:-1]], "n": r["n_keys"]}

    def slots(self, shard: dict, words: list[bytes], h: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for words that are not a key of the shard."""
        if shard["seed"]:
            h = hashes_of(words, shard["seed"])
        slots, left = np.full(len(words), -1, np.int64), np.arange(len(words))
        for i, (size, at) in enumerate(zip(shard["sizes"].tolist(), shard["at"].tolist())):
            place = at + _at_level(h[left], i, size).astype(np.int64)
            here = shard["bits"][place]
            slots[left[here]] = shard["rank"][place[here]]
            left = left[~here]
        found = np.flatnonzero(slots >= 0)
        keys, a, b = shard["keys"], shard["starts"][slots[found]].tolist(), shard["ends"][slots[found]].tolist()
        wrong = [keys[x:y] != words[i] for i, x, y in zip(found.tolist(), a, b)]
        slots[found[np.array(wrong, bool)]] = -1
        return slots

    def add(self, lang: str, n_shards: int, counted: dict[bytes, int], vector_of) -> None:
        """Add the counts of words to the vectors that ``vector_of(shard, slots)`` gives."""
        words = list(counted)
        h, n = hashes_of(words), np.fromiter(counted.values(), np.int64, len(words))
        where = shard_of(h, n_shards)
        order = np.argsort(where, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            shard = self.langs[lang].get(int(where[part[0]]))
            if shard is None:
                continue  # its shard is in another bundle
            slots = self.slots(shard, [words[i] for i in part.tolist()], h[part])
            found = slots >= 0
            vector_of(int(where[part[0]]), shard["n"])[slots[found]] += n[part[found]]


def shard_of(h: np.ndarray, n_shards: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n_shards)).astype(np.int64)


def _table(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n_docs) of a (text, lang) table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counted in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted), pa.string()), pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], names=["lang", "term", "n_docs"])
            held.clear()

        for batch in batches:
            for body, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                held[lang].update(set(terms_of(body.as_py())))
            if sum(map(len, held.values())) > _ENTRIES:
                yield from flush()
        yield from flush()

    counted = docs.select("text", "lang").mapInArrow(run, "lang string, term binary, n_docs long")
    return counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))


def perfect_hashes(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The shards of (lang, term) rows, with n_shards and n_terms of their language."""
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms")).withColumn("n_shards", F.ceil(F.col("n_terms") / F.lit(shard_keys)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = hashes_of(batch.column(1).to_pylist()), batch.column(2).to_numpy()
            where = ((h >> np.uint64(20)) % n.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(where)], names=["lang", "term", "shard"])

    def build(group: pa.Table) -> pa.Table:
        made = build_shard(group.column("term").to_pylist())
        return pa.Table.from_pylist([{"lang": group.column("lang")[0].as_py(), "shard": group.column("shard")[0].as_py(), **made}], schema=pa.schema(
            [("lang", pa.string()), ("shard", pa.int64()), ("n_keys", pa.int64()), ("seed", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary()), ("ends", pa.binary())]))

    dealt = kept.join(sizes, "lang").select("lang", "term", "n_shards").mapInArrow(deal, "lang string, term binary, shard long")
    return dealt.groupBy("lang", "shard").applyInArrow(build, _SHARD).join(sizes, "lang")


def _bundles(shards: DataFrame, bundle_bytes: int) -> Iterator[pa.Table]:
    """The shards in the order of (lang, shard), in bundles of about ``bundle_bytes`` or one shard.
    Besides them only one size per shard comes to the driver."""
    size = F.octet_length("keys") + F.octet_length("ends") + 8 * F.octet_length("bits") * 5
    runs: list[list[tuple]] = []
    total = 0
    for *at, n in sorted(map(tuple, shards.select("lang", "shard", size).collect())):
        if not runs or total + n > bundle_bytes:
            runs.append([tuple(at), tuple(at)])
            total = 0
        runs[-1][1], total = tuple(at), total + n
    for first, last in runs:
        ends = [F.struct(F.lit(lang).alias("lang"), F.lit(shard).cast("long").alias("shard")) for lang, shard in (first, last)]
        yield shards.filter(F.struct("lang", "shard").between(*ends)).toArrow()


def _count(docs: DataFrame, bundle: pa.Table, counters: int) -> DataFrame:
    """(lang, source, shard, counts) partial vectors of the bundle's shards, as a task held them."""
    sent, key = docs.sparkSession.sparkContext.broadcast(bundle), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COMPILED:
            _COMPILED.clear()
            _COMPILED[key] = Shards(sent.value), dict(zip(sent.value.column("lang").to_pylist(), sent.value.column("n_shards").to_pylist()))
        own, n_shards = _COMPILED[key]
        held: dict[tuple, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k, _ in part], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))],
                                                  pa.array([_packed(v) for _, v in part], pa.binary())], names=["lang", "source", "shard", "counts"])
            held.clear()

        n_held = 0
        for batch in batches:
            bodies, langs, sources = batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = sorted((i for i in range(batch.num_rows) if langs[i] in n_shards), key=lambda i: (langs[i], sources[i]))
            for part in slices(rows, lambda i: len(bodies[i].as_buffer() or b""), _AT_ONCE):
                counted: dict[tuple, Counter] = defaultdict(Counter)
                for i in part:
                    counted[langs[i], sources[i]].update(terms_of(bodies[i].as_py()))
                for (lang, source), words in counted.items():
                    if not words:
                        continue

                    def vector_of(shard: int, n: int) -> np.ndarray:
                        nonlocal n_held
                        v = held.get((lang, source, shard))
                        if v is None:
                            v = held[lang, source, shard] = np.zeros(n, np.int64)
                            n_held += n
                        return v

                    own.add(lang, n_shards[lang], words, vector_of)
                    if n_held > counters:
                        yield from flush()
                        n_held = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, source string, shard long, counts binary")


def _packed(v: np.ndarray) -> bytes:
    """Counts in the narrowest of three widths; the first byte tells which."""
    for kind in ("<u2", "<u4"):
        if int(v.max(initial=0)) <= np.iinfo(kind).max:
            return kind[2].encode() + v.astype(kind).tobytes()
    return b"8" + v.astype("<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {"2": "<u2", "4": "<u4", "8": "<i8"}[chr(data[0])], offset=1).astype(np.int64)


def _summed(parts: DataFrame) -> DataFrame:
    """One vector per (lang, source, shard): partial ones are added as they stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key == last:
                    total += _unpacked(data)
                else:
                    if last is not None:
                        done.append((*last, _packed(total), int(total.sum())))
                    last, total = key, _unpacked(data)
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in done], schema=out)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, (*last, _packed(total), int(total.sum()))))], schema=out)

    key = ["lang", "source", "shard"]
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int64()), ("counts", pa.binary()), ("n", pa.int64())])
    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "lang string, source string, shard long, counts binary, n long")


class TermCounts:
    """What the two passes leave, as written tables: groups (lang, source), shards, counts."""

    def __init__(self, groups: DataFrame, shards: DataFrame, counts: DataFrame):
        self.groups, self.shards, self.counts = groups, shards, counts


def count_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, text: str = "text", lang: str = "lang", source: str = "source",
                shard_keys: int = SHARD_KEYS, bundle_bytes: int = BUNDLE_BYTES, counters: int = COUNTERS) -> TermCounts:
    """Exact counts of each language's kept terms in each of its sources."""
    table = _table(docs, text, lang, source)
    groups = materialise(table.select("lang", "source").distinct(), "divergence-groups")
    kept = materialise(document_counts(table).filter(F.col("n_docs") >= least_docs).select("lang", "term"), "divergence-terms")
    shards = materialise(perfect_hashes(kept, shard_keys), "divergence-shards")
    parts = None
    for bundle in _bundles(shards, bundle_bytes):
        counted = _count(table, bundle, counters)
        parts = counted if parts is None else parts.unionByName(counted)
    if parts is None:
        parts = docs.sparkSession.createDataFrame([], "lang string, source string, shard long, counts binary")
    return TermCounts(groups, shards, materialise(_summed(parts), "divergence-counts"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * counts / total), exact; counts are ``total`` at most."""
    if total > 1 << 52:
        return np.array([1 + 10**9 * int(c) // total for c in counts.tolist()], np.int64)
    # long division, a factor of 1000 a step, so that no product leaves 64 bits
    quotient, rest = np.zeros_like(counts), counts
    for _ in range(3):
        quotient, rest = quotient * 1000 + rest * 1000 // total, rest * 1000 % total
    return 1 + quotient


def audit(counted: TermCounts, smooth: int = SMOOTH, best: int = BEST) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its language by
    divergence (``pair``), and the ``best`` terms it uses more than its language does (``term``)."""
    # the totals of a group and of its language; a language without kept terms has no shard
    totals = counted.counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = counted.shards.groupBy("lang").agg(F.first("n_terms").alias("n_terms"))
    groups = counted.groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    frame = (groups.join(langs, "lang").join(of_lang, "lang")
             .join(counted.shards.select("lang", "shard"), "lang")
             .join(counted.counts.drop("n"), ["lang", "source", "shard"], "left"))
    keys = counted.shards.select("lang", "shard", "keys", "ends")
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def compare(rows: pa.Table, shard: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return out.empty_table()
        lang, names = rows.column("lang")[0].as_py(), rows.column("source").to_pylist()
        order = np.argsort(np.array([n.encode() for n in names], object), kind="stable")
        names = [names[i] for i in order]
        blob, ends = shard.column("keys")[0].as_py(), np.frombuffer(shard.column("ends")[0].as_py(), "<i8")
        terms = [blob[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
        data, n = rows.column("counts").to_pylist(), rows.column("n").to_pylist()
        v = int(rows.column("n_terms")[0].as_py())
        counts = np.zeros((len(names), len(terms)), np.int64)
        for at, i in enumerate(order):
            if data[i] is not None:
                counts[at] = _unpacked(data[i])
        p = np.stack([shares(c + smooth, int(n[i]) + smooth * v) for c, i in zip(counts, order)])
        q = shares(counts.sum(axis=0) + smooth, int(rows.column("lang_n")[0].as_py()) + smooth * v)
        columns: list[list] = [[], [], [], []]
        by_term = np.argsort(np.argsort(np.array(terms, object)))  # ties go by the terms' bytes
        for at, name in enumerate(names):
            sums = np.abs(p[at + 1 :] - p[at]).sum(axis=1).tolist()
            more = np.flatnonzero((counts[at] > 0) & (p[at] > q))
            gain = (p[at] - q)[more]
            top = np.lexsort((by_term[more], -gain))[:best]
            for column, made in zip(columns, ([name] * (len(sums) + len(top)), ["pair"] * len(sums) + ["term"] * len(top), names[at + 1 :] + [terms[i].decode() for i in more[top].tolist()], sums + gain[top].tolist())):
                column += made
        return pa.Table.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *[pa.array(c, f.type) for c, f in zip(columns, list(out)[1:])]], schema=out)

    made = frame.groupBy("lang", "shard").cogroup(keys.groupBy("lang", "shard")).applyInArrow(compare, "lang string, source string, part string, item string, value long")
    # every two sources of a language have a pair, with a value of 0 where no term is kept
    bare = counted.groups.join(langs, "lang", "left_anti")
    bare = bare.groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("all")).select("lang", "all", F.posexplode("all").alias("at", "source"))
    bare = bare.select("lang", "source", F.lit("pair").alias("part"), F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("item"), F.lit(0).cast("long").alias("value"))
    sums = made.filter("part = 'pair'").unionByName(bare).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    flipped = sums.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    pairs = sums.unionByName(flipped).withColumn("rank", place)
    terms = made.filter("part = 'term'").withColumn("rank", place).filter(F.col("rank") <= best)
    return pairs.unionByName(terms)
