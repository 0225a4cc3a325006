"""Byte-pair merges without a merge queue, and a bounded memo of encoded units.

In an encoding of ranked, leftmost-first merges any two neighbours are compatible: encoding
the two tokens' text alone gives them back. Every prefix of a text therefore has one last
token that is compatible with the last token of the prefix before it, and a text's
tokens can be read backwards from these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import islice

_NEVER = float("inf")


class Merges:
    """Merge rules over symbols, each one character; a token is the string of its symbols.
    ``rank(a, b)`` is the priority of joining two tokens, None if they don't join; the smallest
    rank goes first, the leftmost pair at equal ranks."""

    def __init__(self, rank: Callable[[str, str], float | None], memo: int = 1 << 20):
        self.rank, self.memo = rank, memo
        self._edges: dict[tuple[str, bool], list[tuple[str, float, float]] | None] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def tree(self, symbols: str):
        """Merge ``symbols`` fully: a list of (token, rank it was made at, left, right)."""
        parts: list[tuple] = [(s, -1.0, None, None) for s in symbols]
        while len(parts) > 1:
            ranks = [self.rank(a[0], b[0]) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], best, parts[i], parts[i + 1])]
        return parts

    def whole(self, symbols: str) -> bool:
        """Whether these symbols merge into one token."""
        return len(symbols) == 1 or len(self.tree(symbols)) == 1

    def _edge(self, token: str, right: bool) -> list[tuple[str, float, float]]:
        """The tokens along a token's right (left) edge while it is merged, newest first, each
        with the rank it was made at and the rank at which its successor used it up."""
        known = self._edges.get((token, right))
        if known is None:
            node, known, gone = self.tree(token)[0], [], _NEVER
            while node:
                known.append((node[0], node[1], gone))
                gone, node = node[1], node[3] if right else node[2]
            self._edges[token, right] = known
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Whether the boundary between two tokens survives: no token of the left one's right edge
        joins one of the right one's left edge while both stand there. At equal ranks the pair
        further left goes first: the left token's own merge before, the right one's after."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._compatible(self._edge(left, True), self._edge(right, False))
            if len(self._pairs) < self.memo:
                self._pairs[left, right] = known
        return known

    def _compatible(self, lefts, rights) -> bool:
        i = j = 0
        while True:
            (a, made_a, gone_a), (b, made_b, gone_b) = lefts[i], rights[j]
            joined = self.rank(a, b)
            if joined is not None and joined < gone_a and joined <= gone_b:
                return False
            # step back before the later of the two merges; at equal ranks the right one came later
            if made_b >= made_a and j + 1 < len(rights):
                j += 1
            elif i + 1 < len(lefts):
                i += 1
            elif j + 1 < len(rights):
                j += 1
            else:
                return True


class Memo:
    """Values of text units, computed many at a time. Between calls at most ``cap`` of them stay, of ``room``
    bytes at most (an entry counts 4 bytes per character, its value's bytes and 200 more); a unit of more than ``LONG``
    characters, as in texts without spaces, never stays."""

    LONG = 256

    def __init__(self, compute: Callable[[list[str]], Iterable], cap: int = 300_000, room: int = 96 << 20):
        self.compute, self.cap, self.room, self.known, self.used = compute, cap, room, {}, 0

    def values(self, texts: Sequence[Sequence[str]]) -> list[list]:
        """For each text, given as its units, the units' values."""
        known, missing = self.known, {}
        out = [list(map(known.get, units)) for units in texts]
        gaps = [[i for i, v in enumerate(row) if v is None] if None in row else () for row in out]
        for units, at in zip(texts, gaps):
            for i in at:
                missing[units[i]] = None
        if missing:
            order = list(missing)
            missing.update(zip(order, self.compute(order)))
            for units, row, at in zip(texts, out, gaps):
                for i in at:
                    row[i] = missing[units[i]]
            if len(known) < self.cap and self.used < self.room:
                self._keep(missing)
        return out

    def _keep(self, made: dict) -> None:
        for unit, value in islice(made.items(), self.cap - len(self.known)):
            if len(unit) <= self.LONG:
                self.used += 200 + 4 * len(unit) + (len(value) if isinstance(value, bytes) else 0)
                if self.used > self.room:
                    return
                self.known[unit] = value


def slices(items: Sequence, size: Callable, limit: int) -> Iterable[Sequence]:
    """Runs of items whose sizes sum to about ``limit``; one large item is a run of its own."""
    at = total = 0
    for i, x in enumerate(items):
        n = size(x)
        if i > at and total + n > limit:
            yield items[at:i]
            at, total = i, 0
        total += n
    if at < len(items):
        yield items[at:]
