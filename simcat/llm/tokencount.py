"""Token counts from a finite-state transducer compiled from a BPE vocabulary.

The transducer reads a word byte by byte. Its state is what decides all that follows: the longest
suffix read that begins some token, the last token of every prefix within that suffix, and
the token counts of these prefixes relative to the present one. Tokens have bounded length,
so the states are finite and the machine is deterministic; each transition carries the number
of tokens it adds to the prefix's count (it can be negative when a longer token takes over),
and the transition on a word's last byte, which has its own symbol, carries the rest of the
count and leads back to the start. States and transitions are made when they are first
taken, and all dropped when there are too many.

A text is a sequence of chunks: runs of Latin letters that white space or other ASCII
follows, where a word always ends, and else what stands between white space, which belongs to
no token. A chunk's state map leads from the start to the start with a count, computed once
and kept in a bounded memo; maps from start to start compose by adding, so a text's scan over them is a
prefix sum, over blocks of chunks, then over the blocks.

A word that is longer than ``PIECE`` is cut into pieces, and these have maps over several entry states. Which
states can be entered isn't known before the piece in front has been run, so a piece's map is made for the states
that runs over the last ``LEAD`` bytes in front of it end in, from the start and from the middle of a word; the
machine forgets what lies further back almost always. The maps compose as functions, in any grouping, by a scan that
doubles its reach in every round; where an exit meets no entry of the next map, that map is completed by a run
from this state, so the result never rests on a guess.

The tokenizer file is read on the driver and broadcast. Supported are files like the given one:
byte-level BPE with an end-of-word suffix, NFC, lower case, white space dropped; special
strings inside texts count one token each, as the library does by default.

Defined results: null and empty texts have 0 tokens and 0 bytes; texts are read whole; equal rows
give equal rows; an empty table stays empty; extra columns pass through, but for one with the result's name.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, Merges, slices
from .common import UNICODE_SPACE, without

#: Bytes of a chunk that one state map covers; states kept; characters counted at once.
PIECE, STATES, _AT_ONCE = 1 << 16, 200_000, 1 << 20
#: Bytes in front of a piece that are run to find the states it can be entered in.
LEAD = 64
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_CHUNK = re.compile(f"[{_LATIN}]+(?=[\x00-@\\[-`{{-\x7f]|$)|[^{UNICODE_SPACE}]+")
_LOADED: dict[bytes, TokenCounter] = {}


def _byte_symbols() -> dict[str, str]:
    """From the printable characters that byte-level vocabularies write bytes with, to the bytes'
    symbols: the character of the byte's own number."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {**{chr(b): chr(b) for b in printable}, **{chr(256 + i): chr(b) for i, b in enumerate(rest)}}


_SYMBOLS = _byte_symbols()


def _shape(text: str) -> str:
    """Lower-case text without white space, its other letters as A, other numbers as 0, the rest as !."""
    if text.isascii():
        return text
    return "".join(c if c < "\x80" else {"L": "A", "N": "0"}.get(unicodedata.category(c)[0], "!") for c in text)


class Transducer:
    """The machine over the symbols of a word, each one character."""

    def __init__(self, merges: Merges, tokens: set[str], states: int = STATES):
        self.merges, self.tokens, self.limit = merges, tokens, states
        self.begins = {t[:n] for t in tokens for n in range(1, len(t) + 1)}
        self.reset()

    def reset(self) -> None:
        # a state: (suffix, last token of the prefixes that end within it, their counts relative to the present prefix)
        self.states: list[tuple] = [("", (None,), (0,))]
        self.number = {self.states[0]: 0}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}

    def _token_after(self, state: int, symbol: str) -> tuple[str, int]:
        """The last token once ``symbol`` is read, and how much the count grows."""
        suffix, last, counts = self.states[state]
        for n in range(len(suffix), -1, -1):
            token = suffix[len(suffix) - n :] + symbol
            if token not in self.tokens and n:
                continue
            before = last[len(suffix) - n]
            if before is None or self.merges.compatible(before, token):
                return token, counts[len(suffix) - n] + 1
        raise AssertionError("a single symbol always is a token")

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The next state and the count its transition carries."""
        known = self.steps.get((state, symbol))
        if known is None:
            token, grows = self._token_after(state, symbol)
            suffix, last, counts = self.states[state]
            wide, last, counts = suffix + symbol, (*last, token), (*(c - grows for c in counts), 0)
            while wide and wide not in self.begins:
                wide = wide[1:]
            keep = len(wide) + 1
            after = (wide, last[-keep:], counts[-keep:])
            if after not in self.number:
                self.number[after] = len(self.states)
                self.states.append(after)
            known = self.steps[state, symbol] = self.number[after], grows
        return known

    def finish(self, state: int, symbol: str) -> int:
        """The count that a word's last symbol adds; the machine is at the start again."""
        known = self.steps.get((state, symbol))
        if known is None:
            known = self.steps[state, symbol] = 0, self._token_after(state, symbol)[1]
        return known[1]

    def run(self, symbols: str, state: int = 0) -> tuple[int, int]:
        """State map of a piece of a word at one entry: (exit state, count)."""
        total, steps = 0, self.steps
        for s in symbols:
            state, n = steps.get((state, s)) or self.step(state, s)
            total += n
        return state, total


class PieceMap:
    """State map of consecutive pieces of a word: entry state -> (exit state, count), made for some entries and
    completed by ``run`` for others when they are asked for."""

    def __init__(self, run: Callable[[int], tuple[int, int]], entries: Iterable[int]):
        self.run = run
        self.known = {s: run(s) for s in entries}

    def __call__(self, state: int) -> tuple[int, int]:
        known = self.known.get(state)
        if known is None:
            known = self.known[state] = self.run(state)
        return known

    def then(self, other: PieceMap) -> PieceMap:
        """This map, then the other one."""

        def run(state: int) -> tuple[int, int]:
            between, n = self(state)
            after, m = other(between)
            return after, n + m

        return PieceMap(run, self.known)


def piece_maps(machine: Transducer, symbols: str, piece: int = PIECE, lead: int = LEAD) -> list[PieceMap]:
    """The maps of a word's pieces, each for the states it is likely to be entered in; the first one for the start."""
    out = []
    for at in range(0, len(symbols), piece):
        entries = {0}
        if at:
            near = symbols[max(0, at - lead) : at]
            entries = {machine.run(near)[0], machine.run(near, machine.run(near[: lead // 2])[0])[0]}
        out.append(PieceMap(partial(machine.run, symbols[at : at + piece]), entries))
    return out


def compose(maps: list[PieceMap]) -> list[PieceMap]:
    """Prefix scan: the i-th result is the composition of the first i + 1 maps; every round doubles what each covers,
    and the compositions of a round don't depend on one another."""
    out, reach = list(maps), 1
    while reach < len(out):
        out = [m if i < reach else out[i - reach].then(m) for i, m in enumerate(out)]
        reach *= 2
    return out


class TokenCounter:
    """Counts tokens as the tokenizer of a JSON file does."""

    def __init__(self, file: bytes):
        spec, self.library = json.loads(file), tokenizers.Tokenizer.from_buffer(file)
        model, norm = spec["model"], [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or norm != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or model.get("ignore_merges"):
            raise ValueError("needs a byte-level BPE with NFC, lower case and an end-of-word suffix")
        splits = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the file's own pattern, over the shapes of ``_shape``
        self.word = re.compile(splits.replace(r"[^\s", "[^").replace(r"\p{L}", "a-zA").replace(r"\p{N}", "0-9"))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.end, ranks = model["end_of_word_suffix"], {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[self._symbols(a), self._symbols(b)] = i
        merges = Merges(lambda a, b: ranks.get((a, b)))
        tokens = {s for s in map(self._symbols, model["vocab"]) if merges.whole(s)}
        self.machine = Transducer(merges, tokens)
        self.memo = Memo(lambda chunks: [self.chunk(c) for c in chunks])

    def _symbols(self, token: str) -> str:
        """A token's symbols: one character per byte, another one for a byte that ends a word."""
        ends = token.endswith(self.end) and len(token) > len(self.end)
        out = "".join(map(_SYMBOLS.__getitem__, token[: -len(self.end)] if ends else token))
        return out[:-1] + chr(ord(out[-1]) + 256) if ends else out

    def _words(self, part: str) -> list[str]:
        """The words of a chunk, as symbols."""
        if not part.isascii() and any(unicodedata.category(c) == "Cn" for c in part):
            # characters newer than this Python's Unicode: the library knows their kind and case
            text = self.library.normalizer.normalize_str(part)
            return ["".join(map(_SYMBOLS.__getitem__, word)) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        part = unicodedata.normalize("NFC", part)
        part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
        return [part[m.start() : m.end()].encode().decode("latin-1") for m in self.word.finditer(_shape(part))]

    def chunk(self, chunk: str) -> int:
        """The count that a chunk's state map carries from start to start."""
        total, machine = 0, self.machine
        for i, part in enumerate(self.special.split(chunk) if self.special else [chunk]):
            if i % 2:
                total += 1
                continue
            for symbols in self._words(part):
                if len(machine.states) > machine.limit:
                    machine.reset()
                if len(symbols) <= PIECE:
                    state, count = machine.run(symbols[:-1])
                else:
                    state, count = compose(piece_maps(machine, symbols[:-1], PIECE))[-1](0)
                total += count + machine.finish(state, chr(ord(symbols[-1]) + 256))
        return total

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(text)

    def count_many(self, texts: list[str]) -> list[int]:
        return [scan(maps)[-1] if maps else 0 for maps in self.memo.values([self.chunks(t) for t in texts])]


def scan(counts: list[int], block: int = 1024) -> np.ndarray:
    """Inclusive prefix composition of chunk maps that all go from start to start: maps are
    composed inside blocks side by side, then the blocks' totals, then both."""
    n = len(counts)
    rows = np.zeros(-(-n // block) * block, np.int64)
    rows[:n] = counts
    inside = rows.reshape(-1, block).cumsum(axis=1)
    before = np.r_[0, inside[:-1, -1].cumsum()]
    return (inside + before[:, None]).ravel()[:n]


def counter(file: bytes) -> TokenCounter:
    """The counter of a tokenizer file, compiled once in each Python worker."""
    key = hashlib.sha256(file).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TokenCounter(file)
    return _LOADED[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text. No shuffle."""
    with open(tokenizer_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = without(docs, name)
    schema, at = docs.withColumn(name, F.lit(0).cast("long")).schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(sent.value)
        for batch in batches:
            made: list[int] = []
            for part in slices([x or "" for x in batch.column(at).to_pylist()], len, _AT_ONCE):
                made += own.count_many(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)
