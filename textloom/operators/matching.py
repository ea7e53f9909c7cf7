"""Exact alignment of two texts, as difflib without junk has it, with the search for the longest match in whole numbers.

The table of equal characters of two stretches is one long number, a row of bits for each character of the first.  Anded
with itself one row and one column further, it holds the ends of matches of two, then four, and so on; so a search takes
a few operations over the number and not a step for every equal pair.  Stretches whose table would be large are searched
by difflib itself, in memory that grows with their length only.
"""

from __future__ import annotations

from difflib import Match, SequenceMatcher

#: Bits of the largest table; a fixed value.
TABLE = 1 << 24


class Matcher(SequenceMatcher):
    """SequenceMatcher(None, a, b, autojunk=False) with the same blocks, ratios and operations."""

    def __init__(self, a: str = "", b: str = ""):
        super().__init__(None, a, b, autojunk=False)

    def set_seq2(self, b: str) -> None:
        super().set_seq2(b)
        self.masks = {c: sum(1 << j for j in places) for c, places in self.b2j.items()}

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None) -> Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        rows, cols = ahi - alo, bhi - blo
        width = cols // 8 + 1  # bytes of a row; its last bit stays free, so that no match runs on into the next row
        if rows * width * 8 > TABLE:
            return super().find_longest_match(alo, ahi, blo, bhi)
        stretch, inside, get = self.a[alo:ahi], (1 << cols) - 1, self.masks.get
        bits = {c: ((get(c, 0) >> blo) & inside).to_bytes(width, "little") for c in set(stretch)}
        table = int.from_bytes(b"".join([bits[c] for c in stretch]), "little")
        if not table:
            return Match(alo, blo, 0)
        step = width * 8 + 1
        powers, size = [table], 1
        while longer := powers[-1] & (powers[-1] << size * step):
            powers.append(longer)
            size *= 2
        found = powers.pop()
        half = size
        while powers:
            half //= 2
            if longer := found & (powers.pop() << size * step):
                found, size = longer, size + half
        end = (found & -found).bit_length() - 1  # the first in a, and of those the first in b
        i, j = divmod(end, width * 8)
        return Match(alo + i - size + 1, blo + j - size + 1, size)


def _common(a: str, masks: dict[str, int], m: int) -> int:
    """Characters of the longest common subsequence of a and the text of ``masks``; no ratio can count more."""
    full = (1 << m) - 1
    v = full
    for c in a:
        if mask := masks.get(c):
            u = v & mask
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def nearest(texts: list[str], text: str, least: float) -> tuple[int, float]:
    """(place, ratio) of the first of the texts most like ``text``, (-1, 0.0) if none reaches ``least``.

    The most promising are compared first, so that a good match spares the others.
    """
    match = Matcher("", text)
    m, masks, bounds = len(text), match.masks, []
    for k, a in enumerate(texts):
        total = len(a) + m
        if not total or 2.0 * min(len(a), m) / total >= least:
            bound = 2.0 * _common(a, masks, m) / total if total else 1.0
            if bound >= least:
                bounds.append((-bound, k))
    best, score = -1, 0.0
    for bound, k in sorted(bounds):
        if -bound < score:
            break
        match.set_seq1(texts[k])
        now = match.ratio()
        if now >= least and (now > score or (now == score and k < best)):
            best, score = k, now
    return best, score
