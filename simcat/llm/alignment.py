"""Alignment of two tokenizers' tokens over the same bytes, with an identity map as the fast path.

A text, with a space before it, is tokenised by A (byte-level BPE) and B (SentencePiece BPE).
Places where tokens of both end cut the tokens into groups; within a group every A token is linked to
every B token whose bytes overlap its own. The identity map gives, for every A id, the B id of the same
bytes: a group of one token each is such a pair, so it is written as its A id alone and counted in a
vector of A's vocabulary length. Only links of irregular groups are pairs of ids that go through
the shuffle.

Texts are cut into units where both tokenizers always end a token: before white space that follows
another character and after a run of Latin letters that other ASCII follows, as far as B's vocabulary
lets no piece cross (checked when it is loaded). A worker tokenises and aligns a unit once and keeps it in a
table bounded in bytes; a full table is emptied. A text's result is the sum of its units'.

``align`` is map-only. ``score`` writes its input, counts the links of all texts, and scores each text by the
counts: vectors of the vocabularies' lengths are broadcast, irregular pairs come in bundles of
``BUNDLE_PAIRS``, one scan of the compact rows per bundle.

Defined results: texts that are null, empty, or whose tokens of A or B don't give back their bytes (a
literal U+2581) have no tokens: zeros, and no groups; repeated rows give repeated rows and count as often;
an empty table stays empty; extra columns pass through, but for those with a result's name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import UNICODE_SPACE, materialise, without

#: Numbers of a text; its links, packed: A ids of one-to-one groups, irregular pairs, both with counts.
COUNTS, PACKED = ["n_a", "n_b", "n_groups", "n_links"], ["exact", "pairs"]
#: Bytes of a worker's table of units; characters of texts aligned at once; pairs broadcast at once.
TABLE_BYTES, _AT_ONCE, BUNDLE_PAIRS = 96 << 20, 1 << 20, 2 << 20
#: Pairs that a task holds before it passes their counts on.
_HELD = 4 << 20
_MARK, _LATIN = "▁", "A-Za-zÀ-ÖØ-öø-ÿ"
_LOADED: dict[bytes, Aligner] = {}


def _byte_level() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Vocabularies:
    """Bytes of every id of A and B, and the identity map (-1 where B has no id of the same bytes)."""

    def __init__(self, file: bytes, model: bytes):
        spec, table = json.loads(file), _byte_level()
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("A needs a byte-level BPE without a normalizer and prefix space")
        vocab = spec["model"]["vocab"]
        self.a = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.a[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        if p.decode(p.encode(" Å\n ")) != " Å\n " or p.id_to_piece(p.encode("a")[0])[0] != _MARK:
            raise ValueError("B needs identity normalisation, byte fallback and a space put first")
        self.pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        special = [p.is_control(i) or p.is_unknown(i) for i in range(len(self.pieces))]
        self.b = [b"" if special[i] else bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(self.pieces)]
        plain = [i for i in range(len(self.b)) if self.b[i]]
        by_bytes: dict[bytes, int] = {}
        for i in sorted(plain, key=p.is_byte):  # a piece goes before the byte of the same value
            by_bytes.setdefault(self.b[i], i)
        self.identity = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a], np.int64)
        self.neighbours = {x[i : i + 2] for k, x in enumerate(self.pieces) if not special[k] and not p.is_byte(k) for i in range(len(x) - 1)}


class Aligner:
    """Tokenises and aligns texts unit by unit."""

    def __init__(self, file: bytes, model: bytes, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.vocab, self.limit = Vocabularies(file, model), table_bytes
        self.library_a = tokenizers.Tokenizer.from_buffer(file)
        self.library_a.encode_special_tokens = True  # special strings in a text are plain text
        self.library_b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in v], np.int64) for v in (self.vocab.a, self.vocab.b))
        self.text_a, self.text_b = ([str(i) for i in range(len(v))] for v in (self.vocab.a, self.vocab.b))
        self.n_b = len(self.vocab.b)
        self.lead = len(self.library_b.encode("a"))  # tokens of the letter that B's units are put behind
        self.unit = self._units()
        self.reset()

    def _units(self) -> re.Pattern:
        space = f"{UNICODE_SPACE}{_MARK}"
        is_space, is_latin = re.compile(f"[{space}]"), re.compile(f"[{_LATIN}]")
        pairs = self.vocab.neighbours
        crossing = {b for a, b in pairs if is_space.match(b) and not is_space.match(a)}
        if _MARK in crossing:
            return re.compile("(?s:.+)")
        after = {b for a, b in pairs if is_latin.match(a)}
        ends = "".join(re.escape(chr(c)) for c in range(128) if not chr(c).isalpha() and chr(c) not in after)
        ends += "".join(c for c in map(chr, range(128, 0x3001)) if re.match(f"[{UNICODE_SPACE}]", c) and c not in after and c not in crossing)
        s, held = UNICODE_SPACE, "".join(re.escape(c) for c in sorted(crossing))
        more = f"(?:[{held}][{s}]*[^{s}]*)*" if held else ""
        return re.compile(f"[{s}]*[{_LATIN}]+(?=[{ends}]|$)|[{s}]*[^{s}]+{more}|[{s}]+")

    def reset(self) -> None:
        """An empty table of units. Per unit: the four numbers, whether it gives back its bytes, its links
        (A ids of one-to-one groups; pairs as A * size of B + B), the groups as text."""
        self.number: dict[str, int] = {}
        self.counts, self.sound = np.zeros((0, 4), np.int64), np.zeros(0, bool)
        self.exact, self.exact_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.pairs, self.pair_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.groups: list[str] = []
        self.used = 0

    def _tokenise(self, units: list[str]) -> tuple[list, list]:
        a = [x.ids for x in self.library_a.encode_batch_fast(units, add_special_tokens=False)]
        # behind a letter B puts no space before a unit, and no piece joins the two
        b = [x[self.lead :] for x in self.library_b.encode(["a" + u for u in units], num_threads=1)]
        return a, b

    def add(self, units: list[str]) -> None:
        """Tokenise and align new units."""
        a, b = self._tokenise(units)
        sound = [b"".join([self.vocab.a[i] for i in x]) == (raw := u.encode()) and b"".join([self.vocab.b[i] for i in y]) == raw for u, x, y in zip(units, a, b)]
        a, b = ([x if ok else [] for x, ok in zip(side, sound)] for side in (a, b))
        ids_a, ids_b = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        # the units' bytes laid end to end: both sides' ends, and the links, one per stretch between two ends
        end_a, end_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        ends = np.union1d(end_a, end_b)
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[link_a] == ends) & (end_b[link_b] == ends)
        # a link whose own end and the one before it are both group ends is a group of one token each
        single = both & np.r_[True, both[:-1]][: len(both)] & (self.vocab.identity[ids_a[link_a]] == ids_b[link_b])
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        owner = np.repeat(np.arange(len(units)), n_a)[link_a]
        per_unit = lambda mask: np.bincount(owner[mask], minlength=len(units))
        counts = np.stack([n_a, n_b, per_unit(both), np.bincount(owner, minlength=len(units))], axis=1)
        first = len(self.number)
        self.number.update(zip(units, range(first, first + len(units))))
        self.counts, self.sound = np.concatenate([self.counts, counts]), np.concatenate([self.sound, np.array(sound, bool)])
        self.exact = np.concatenate([self.exact, ids_a[link_a[single]].astype(np.uint32)])
        self.pairs = np.concatenate([self.pairs, (ids_a[link_a[~single]] * self.n_b + ids_b[link_b[~single]]).astype(np.uint32)])
        self.exact_ends = np.concatenate([self.exact_ends, self.exact_ends[-1] + np.cumsum(per_unit(single))])
        self.pair_ends = np.concatenate([self.pair_ends, self.pair_ends[-1] + np.cumsum(per_unit(~single))])
        made = self._groups(ids_a, ids_b, link_a[both] + 1, link_b[both] + 1, np.cumsum(counts[:, 2]))
        self.groups += made
        self.used += sum(4 * len(u) + len(g) + 360 for u, g in zip(units, made)) + 8 * len(ends)

    def _groups(self, ids_a, ids_b, stop_a, stop_b, ends) -> list[str]:
        """Each unit's groups as text; stops: tokens of each side up to a group's end; ends: groups up to a unit's end."""
        text_a, text_b = [self.text_a[i] for i in ids_a.tolist()], [self.text_b[i] for i in ids_b.tolist()]
        out, i, j = [], 0, 0
        for x, y in zip(stop_a.tolist(), stop_b.tolist()):
            out.append(f"{text_a[i]}|{text_b[j]}" if x - i == y - j == 1 else ",".join(text_a[i:x]) + "|" + ",".join(text_b[j:y]))
            i, j = x, y
        return [";".join(out[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, exact, pairs, groups) of each text."""
        if self.used > self.limit:
            self.reset()
        split = [self.unit.findall(" " + t) if t else [] for t in texts]
        new = [u for u in dict.fromkeys(u for units in split for u in units) if u not in self.number]
        if new:
            self.add(new)
        get, out = self.number.__getitem__, []
        for units in split:
            at = np.fromiter(map(get, units), np.int64, len(units))
            if not len(at) or not self.sound[at].all():
                out.append((0, 0, 0, 0, b"", b"", ""))
                continue
            links = [_tally(values[_spread(ends, at)]) for values, ends in ((self.exact, self.exact_ends), (self.pairs, self.pair_ends))]
            out.append((*self.counts[at].sum(axis=0).tolist(), *links, ";".join([self.groups[i] for i in at.tolist()])))
        return out


def _spread(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the values of the rows ``at``, one row after another."""
    n = ends[at + 1] - ends[at]
    return np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _tally(values: np.ndarray) -> bytes:
    """Distinct values, ascending, then how often each occurs: unsigned 32-bit integers."""
    distinct, n = np.unique(values, return_counts=True)
    return np.concatenate([distinct, n]).astype("<u4").tobytes()


def _tallies(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, count) of a column of tallies."""
    data = [np.frombuffer(x, "<u4").astype(np.int64) for x in column.to_pylist()]
    half = [len(x) // 2 for x in data]
    return np.repeat(np.arange(len(data)), half), *(np.concatenate([np.zeros(0, np.int64), *(x[k] for x, k in zip(data, cut))]) for cut in ([slice(0, h) for h in half], [slice(h, None) for h in half]))


def aligner(file: bytes, model: bytes) -> Aligner:
    """The aligner of two tokenizer files, loaded once in each Python worker."""
    key = hashlib.sha256(file + model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(file, model)
    return _LOADED[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links; exact and pairs (its links, packed); groups
    ('a1,a2|b1;a3|b2,b3' in decimal ids). No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((_read(a_path), _read(b_path)))
    docs = without(docs, *COUNTS, *PACKED, "groups")
    schema = docs.withColumns({**{c: F.lit(0).cast("long") for c in COUNTS}, **{c: F.lit(b"") for c in PACKED}, "groups": F.lit("")}).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*sent.value)
        for batch in batches:
            row = 0
            for part in slices([x or "" for x in batch.column(at).to_pylist()], len, _AT_ONCE):
                made = list(zip(*own.align(part)))
                columns = [pa.array(x, kind) for x, kind in zip(made, [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.string()])]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(part)).columns, *columns], names=schema.names)
                row += len(part)

    return docs.mapInArrow(run, schema)


def count_exact(aligned: DataFrame, size: int) -> DataFrame:
    """(a, n) of the one-to-one groups of identity pairs: a vector of A's length in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(size, np.int64)
        for batch in batches:
            _, value, n = _tallies(batch.column(0))
            np.add.at(vector, value, n)
        met = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(vector[met])], names=["a", "n"])

    return aligned.select("exact").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def count_pairs(aligned: DataFrame, held: int = _HELD) -> DataFrame:
    """(pair, n) of the links in irregular groups; pair: A id * size of B's vocabulary + B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def summed() -> None:
            pair, at = np.unique(np.concatenate(values), return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            values[:], counts[:] = [pair], [n]

        def flush() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(values[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(values[0][i : i + (1 << 16)]), pa.array(counts[0][i : i + (1 << 16)])], names=["pair", "n"])
            values[:], counts[:] = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        for batch in batches:
            _, value, n = _tallies(batch.column(0))
            values.append(value)
            counts.append(n)
            waiting += len(value)
            if waiting > held:
                summed()
                waiting = 0
                if len(values[0]) > held:
                    yield from flush()
        summed()
        yield from flush()

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _look_up(aligned: DataFrame, exact_n: np.ndarray, exact_best: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, pair_best: np.ndarray) -> DataFrame:
    """Add to n_best and count_sum what these vectors (by A id) and pairs (ascending) give."""
    sent = aligned.sparkSession.sparkContext.broadcast((exact_n, exact_best, pairs, pair_n, pair_best))
    names = aligned.columns
    at = {c: names.index(c) for c in (*PACKED, "n_best", "count_sum")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact_n, exact_best, pairs, pair_n, pair_best = sent.value
        for batch in batches:
            best, total = (batch.column(at[c]).to_numpy(zero_copy_only=False).copy() for c in ("n_best", "count_sum"))
            row, value, n = _tallies(batch.column(at["exact"]))
            np.add.at(best, row, n * exact_best[value])
            np.add.at(total, row, n * exact_n[value])
            row, value, n = _tallies(batch.column(at["pairs"]))
            if len(pairs) and len(value):
                place = np.minimum(np.searchsorted(pairs, value), len(pairs) - 1)
                known = pairs[place] == value
                row, n, place = row[known], n[known], place[known]
                np.add.at(best, row, n * pair_best[place])
                np.add.at(total, row, n * pair_n[place])
            columns = [*batch.columns]
            columns[at["n_best"]], columns[at["count_sum"]] = pa.array(best), pa.array(total)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return aligned.mapInArrow(run, aligned.schema)


def score(aligned: DataFrame, a_path: str, b_path: str, bundle_pairs: int = BUNDLE_PAIRS) -> DataFrame:
    """``aligned`` with n_best (its links whose pair's count is the highest of their B id) and count_sum
    (the pairs' counts over all its links). A pair's count is its number of links in all texts."""
    spark, vocab = aligned.sparkSession, Vocabularies(_read(a_path), _read(b_path))
    identity, n_b = vocab.identity, len(vocab.b)
    rows = materialise(without(aligned, "n_best", "count_sum"), "alignment")
    exact = materialise(count_exact(rows, len(identity)), "alignment-exact").toArrow()  # a row per A id at most
    exact_n = np.zeros(len(identity), np.int64)
    exact_n[exact.column("a").to_numpy()] = exact.column("n").to_numpy()
    pairs = materialise(count_pairs(rows), "alignment-pairs")
    # the pairs of the identity map, met in one-to-one groups or not, are counted together in the vector
    own = np.flatnonzero(identity >= 0)
    mapped = spark.createDataFrame([(int(a), int(a) * n_b + int(identity[a])) for a in own], "a long, pair long")
    also = pairs.join(F.broadcast(mapped), "pair").select("a", "n").toArrow()
    exact_n[also.column("a").to_numpy()] += also.column("n").to_numpy()
    rest = pairs.join(F.broadcast(mapped.select("pair")), "pair", "left_anti")
    # the highest count of each B id: over the vector, then over the irregular pairs
    best = np.zeros(n_b, np.int64)
    np.maximum.at(best, identity[own], exact_n[own])
    highest = rest.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("n")).toArrow()  # a row per B id at most
    np.maximum.at(best, highest.column("b").to_numpy(), highest.column("n").to_numpy())
    exact_best = np.zeros(len(identity), np.int64)
    exact_best[own] = exact_n[own] == best[identity[own]]
    scored = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    bundles = 1 + pairs.count() // bundle_pairs
    for i in range(bundles):
        part = pairs.filter(F.pmod(F.xxhash64("pair"), F.lit(bundles)) == i).toArrow()
        order = np.argsort(part.column("pair").to_numpy())
        value, n = part.column("pair").to_numpy()[order], part.column("n").to_numpy()[order]
        mine = identity[value // n_b] == value % n_b
        n = np.where(mine, exact_n[value // n_b], n)
        once = 1 if i == 0 else 0  # the vectors are added with the first bundle
        scored = _look_up(scored, once * exact_n, once * exact_best, value, n, (n == best[value % n_b]).astype(np.int64))
        if i + 1 < bundles:
            scored = materialise(scored, "alignment-scored")
    return scored
