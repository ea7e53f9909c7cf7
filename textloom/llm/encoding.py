"""Fast exact encoding of whole texts with the tokenizers library.

A text is cut before each space, between a Latin letter and the common punctuation after it, and around a line end
there.  With both public vocabularies no token crosses such a cut, so the ids of a text are those of its pieces one
after another, and each distinct piece of a batch is encoded once.  Pieces of Latin letters or common punctuation are
what the library's pre-tokenizer would make and go straight to the library's model; every other piece, and every text
where a cut could fall inside such a piece (runs of blanks, other symbols after punctuation), goes through the
library's encode_batch_fast.  tests/llm compares the outcome with plain encoding.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode blanks as RE2 sees them; two in a row, or one at the end of a text after another, need the plain way.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = re.escape(".,!?*$%&|#:;()-+=/@")
_HARD = f"{_BLANK}{_BLANK}|\\x00|[{_LETTERS}][{_MARKS}]+[^{_LETTERS}{_MARKS}0-9 \n]"
_CUT = f"([{_LETTERS}])([{_MARKS}]+\n?|\n)"
_EASY = re.compile(f"[{_LETTERS}]+|[{_MARKS}]+")
_LINE_END = re.compile(f"([{_MARKS}]*)\n")
#: Entries of a worker's piece cache; later ones are encoded anew in each batch.
_CACHE = 300_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Encoder:
    """ids of texts; one per tokenizer file and worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.hard = "|".join([_HARD, *(f"(?i:{x})" for x in added)])  # the library finds these strings before it cuts
        self.word_ends = bool(self.tok.model.end_of_word_suffix)  # such a vocabulary drops blanks and folds case
        self.model, self.letters = self.tok.model, _byte_letters()
        self.pieces: dict[str, tuple] = {"": ()}

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, piece: str) -> tuple:
        """ids of one piece of the pre-tokenizer."""
        if self.word_ends:
            piece = piece.strip().lower()
        if piece[:1] == " " and piece.isascii():
            piece = self.letters[32] + piece[1:]
        elif not piece.isascii() or piece[:1] == "\n":
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return tuple([t.id for t in self.model.tokenize(piece)]) if piece else ()

    def _encode_pieces(self, pieces: list[str]) -> list[tuple]:
        """pieces: as cut, with their leading space where there was one."""
        cache, hard = self.pieces, []
        out = [*map(cache.get, pieces)]
        for i in [i for i, x in enumerate(out) if x is None]:
            piece = pieces[i]
            if _EASY.fullmatch(piece, 1 if piece[0] == " " else 0):
                got = self._model(piece)
            elif found := _LINE_END.fullmatch(piece):
                got = self._model(found[1]) + self._model("\n")
            else:
                hard.append(i)
                continue
            out[i] = got
            if len(cache) < _CACHE:
                cache[piece] = got
        for i, ids in zip(hard, self.plain([pieces[i] for i in hard]), strict=True):
            out[i] = tuple(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, offsets): those of text i are ids[offsets[i]:offsets[i + 1]]."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.hard)
        hard = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        easy = pc.if_else(odd, "", texts) if len(hard) else texts
        cut = pc.split_pattern(pc.replace_substring_regex(easy, _CUT, "\\1\0\\2\0"), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        spaced = np.ones(int(bounds[-1]), bool)
        spaced[bounds[:-1][np.diff(bounds) > 0]] = False  # the first word of a text has no space before it
        cut = pc.split_pattern(cut.flatten(), "\0")
        words = cut.offsets.to_numpy().astype(np.int64)
        words -= words[0]
        book = cut.flatten().dictionary_encode()
        code = book.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2
        code[words[:-1]] += spaced
        bounds = words[bounds]
        seen = np.zeros(2 * len(book.dictionary) + 2, bool)
        seen[code] = True
        used = np.flatnonzero(seen)
        names = book.dictionary.to_pylist()
        parts = self._encode_pieces([" " + names[c >> 1] if c & 1 else names[c >> 1] for c in used.tolist()])
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.uint32, int(size.sum()))
        start = np.cumsum(size) - size
        place = np.zeros(len(seen), np.int64)
        place[used] = np.arange(len(used))
        at = place[code]
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = ends[bounds]
        if not len(hard):
            return ids, offsets
        lists = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        for i, got in zip(hard.tolist(), self.plain(texts.take(pa.array(hard)).to_pylist()), strict=True):
            lists[i] = np.array(got, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: str, most: int = 6 << 20):
    """The batch in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + most, side="right")))
        yield batch.slice(low, high - low)
        low = high


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, "<u4")
    at = np.arange(n)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + at] = False
    out[keep], out[~keep] = ids, end
    return out, offsets + np.arange(n + 1)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").view(np.uint8))
