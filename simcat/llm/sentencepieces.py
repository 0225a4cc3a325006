"""SentencePiece (BPE) encoding by a prefix table, and decoding.

For every prefix of a text the table holds its one last token. An Aho-Corasick automaton over
the pieces lists the tokens that end at each character; the one that is compatible with
the last token of the prefix before it is the entry. Ids are read backwards from the end. A
character without a piece is a token by itself, written as its bytes.

Where no piece of the vocabulary holds two neighbouring characters, no token can cross between
them. So a text is cut before a space mark that follows another character, and after a run of
Latin letters that an ASCII character follows, as far as the vocabulary allows it (checked when
it is loaded); a cut's ids are kept in a bounded memo per Python worker. The model's bytes are read on
the driver and broadcast.

Supported are BPE models with identity normalisation, byte fallback and a dummy prefix, the
kind of the given file; others raise an error when loaded.

Defined results: null and empty texts are the begin and end ids, and decode to the empty
text; white space, control characters and unknown characters round-trip; texts are never cut
short; equal rows give equal rows; extra columns pass through, but for those with a result's name.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, Merges, slices
from .common import kept, without

MARK = "▁"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Characters of texts that are encoded at once.
_AT_ONCE = 1 << 20


class PieceCoder:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        p, n = self.library, self.library.get_piece_size()
        special = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i)}
        if p.encode("a  b ") != p.encode("a  b ", enable_sampling=False) or any(p.is_unused(i) for i in range(n)) or p.decode(p.encode(" Å\n ")) != " Å\n " or not any(p.is_byte(i) for i in range(n)):
            raise ValueError("needs a BPE model with identity normalisation, byte fallback and no unused pieces")
        self.begin, self.end = p.bos_id(), p.eos_id()
        self.ids = {p.id_to_piece(i): i for i in range(n) if i not in special}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.scores = {piece: -p.get_score(i) for piece, i in self.ids.items()}
        self.cuts = self._cuts()
        self.merges = Merges(lambda a, b: self.scores.get(a + b))
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merges.whole(piece):
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.memo = Memo(lambda units: [self.unit(u) for u in units])

    def _cuts(self) -> re.Pattern | None:
        """Finds the units of a text; None if tokens may cross from a word into the next space."""
        pairs = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        if any(b == MARK != a for a, b in pairs):
            return None
        after = {b for a, b in pairs if re.match(f"[{_LATIN}]", a)}
        ends = "".join(re.escape(chr(c)) for c in range(128) if not chr(c).isalpha() and chr(c) not in after)
        return re.compile(f"{MARK}*[{_LATIN}]+(?=[{ends}{MARK}]|$)|{MARK}+[^{MARK}]*|[^{MARK}]+")

    def unit(self, text: str) -> bytes:
        """The ids of normalised text, as little-endian unsigned 32-bit integers."""
        last: list[str | None] = [None] * (len(text) + 1)
        compatible, known = self.merges.compatible, self.merges._pairs
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            start = end - len(token)
            if start:
                before = last[start]
                if before is None:
                    # a character without a piece ends its prefix alone
                    before = last[start] = text[start - 1]
                fits = known.get((before, token))
                if fits is False or fits is None and not compatible(before, token):
                    continue
            last[end] = token
        out, at = [], len(text)
        while at:
            token = last[at] or text[at - 1]
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in reversed(token.encode())]
            at -= len(token)
        out.reverse()
        return array("I", out).tobytes()

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        return self.cuts.findall(text) if self.cuts else [text]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        begin, end = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        return [begin + b"".join(parts) + end for parts in self.memo.values([self.units(t) for t in texts])]

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


def coder(model: bytes) -> PieceCoder:
    """The coder of a model, loaded once in each Python worker."""
    return kept(("pieces", hashlib.sha256(model).digest()), lambda: PieceCoder(model))


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``docs`` with the ids (binary, little-endian unsigned 32-bit integers, begin and end
    included) and the text they decode to. No shuffle."""
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = without(docs, ids, *([decoded] if decoded else []))
    schema = docs.withColumn(ids, F.lit(b""))
    schema = (schema.withColumn(decoded, F.lit("")) if decoded else schema).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(sent.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            made: list[bytes] = []
            for part in slices(texts, len, _AT_ONCE):
                made += own.encode_many(part)
            new = [pa.array(made, pa.binary())] + ([pa.array([own.decode(x) for x in made], pa.string())] if decoded else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the text that its ids decode to; null ids give null."""
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def run(column):
        return column.map(lambda x: None if x is None else coder(sent.value).decode(x))

    return docs.withColumn(text, run(ids))
