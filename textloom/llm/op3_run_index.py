"""Removal of long byte strings that an earlier document also holds, with a run-length index per bucket.

Every ``length``-byte string (gram) of the corpus has one key, the smallest hash of the ``taps``-byte strings in it,
so equal grams have equal keys wherever they are, and neighbouring grams mostly share theirs: a stretch of grams with
one key costs one entry.  The work goes from cheap to exact:

1. texts are written to the shared folder in parts; each part sends each key once, with the smallest document that
   holds it and whether another one does, to the key's bucket;
2. keys that two documents hold are sent back; only their stretches send their bytes, equal stretches of a few MB of
   text once, for their smallest document (the others are settled where they are);
3. a bucket settles equal stretches, and indexes the others key by key: ``RunIndex`` is a run-compressed
   Burrows-Wheeler transform with the positions at both ends of each run and the common prefix between runs.  From
   these samples it streams, in text order, for each gram the longest match with the string before it in the order and
   the place of that match; grams joined by matches of ``length`` are equal, and all but those of the earliest document
   of such a class are marked;
4. the marked grams go back to their parts, where the covered bytes are cut out.

Numbers are sent by the bytes of their digits (``_packed``), and what a step has sent is dropped once its result is
written: disk has to hold the texts and what one step sends, not what all have sent.

A suffix order over the corpus would have to lie in one place; grams of one key lie in one bucket, which is all that a
match of ``length`` bytes needs, and the order within it is exact, so the result is too.  What a bucket gets is bounded
by the different stretches of a key and the slices that hold it, not by their occurrences.

Cases: a null text is an empty one; texts shorter than ``length`` stay whole; rows with equal doc_id never remove from
each other; a null doc_id counts as smallest; an empty table gives an empty result; columns beyond doc_id and text are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import slices
from .op2_token_store import mix64
from .store import filesystem, run_dir, settle, write_file

MOST = 32  # grams of a stretch: its marks are the bits of one number
NULL = np.iinfo(np.int64).min


def gram_keys(data: np.ndarray, length: int, taps: int) -> np.ndarray:
    """Key of the gram at each position of data (bytes): the smallest hash of the taps-byte strings in it."""
    n, padded = len(data) - taps + 1, np.concatenate([data, np.zeros(16, np.uint8)])
    if len(data) < length:
        return np.zeros(0, np.uint64)
    words = np.empty(len(data) + 8, np.uint64)
    for o in range(8):
        part = padded[o : o + (len(padded) - o) // 8 * 8].view("<u8")
        words[o::8] = part[: len(words[o::8])]
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for o in range(0, taps, 8):
            h = (h ^ words[o : o + n]) * np.uint64(0x9E3779B97F4A7C15 ^ (o * 2 + 2))
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    span, have = length - taps + 1, 1
    while have < span:
        step = min(have, span - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def stretches(texts: list[bytes], length: int, taps: int, block: int = 1 << 20):
    """(text, start, grams, key) of all stretches of all texts, as arrays."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for low in range(0, len(data), block):
        keys = gram_keys(data[low : low + block + length - 1], length, taps)
        if not len(keys):
            continue
        at = low + np.arange(len(keys))
        of = np.searchsorted(begin, at, side="right") - 1
        fits = at + length <= (begin + size)[of]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]) | (fits[1:] != fits[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(keys)))
        cuts = -(-n // MOST)  # a periodic text has long stretches: cut them
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(first, cuts) + k * MOST
        n = np.minimum(MOST, np.repeat(n, cuts) - k * MOST)
        keep = fits[start]
        start, n = start[keep], n[keep]
        out.append((of[start], at[start] - begin[of[start]], n, keys[start]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def part_name(home: str, part: int) -> str:
    return f"{home}/texts/{part:012d}.parquet"


def _write_part(home: str, part: int, ids: list, texts: list[bytes]) -> None:
    sink = pa.BufferOutputStream()
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())}), sink, compression="zstd", use_dictionary=False)
    write_file(part_name(home, part), [sink.getvalue()])


def read_part(home: str, part: int) -> tuple[list, list[bytes]]:
    fs, path = filesystem(part_name(home, part))
    with fs.open_input_file(path) as f:
        table = pq.read_table(f)
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


def leaders(ids: list, texts: list[bytes]) -> list[int]:
    """For each row the row of the part with the same text and the smallest doc_id (the first of equals)."""
    found: dict[bytes, int] = {}
    rank = lambda i: NULL if ids[i] is None else ids[i]
    names = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
    for i, x in enumerate(names):
        if x not in found or rank(i) < rank(found[x]):
            found[x] = i
    return [found[x] for x in names]


def _by_bucket(bucket: np.ndarray):
    """(bucket, slice into the order) after sorting by bucket."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
        if high > low:
            yield int(bucket[low]), slice(low, high)


def _packed(x: np.ndarray, kind: str) -> bytes:
    """Numbers as bytes: the lowest byte of each, then the next of each, and so on; high bytes, mostly equal, lie together."""
    return x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(x, np.uint8).reshape(size, len(x) // size).T.tobytes(), kind)


ENTRIES = "bucket long, part long, bytes long, keys binary, least binary, several binary"


def _reduced(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with the smallest and the largest document."""
    order = np.argsort(key, kind="stable")
    key, low, high = key[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.minimum.reduceat(low, first) if len(first) else low, np.maximum.reduceat(high, first) if len(first) else high


def _sliced(rows: list[int], texts: list[bytes], most: int = 4 << 20):
    """The rows in slices of a few MB of text."""
    low = 0
    while low < len(rows):
        high, total = low, 0
        while high < len(rows) and (high == low or total + len(texts[rows[high]]) <= most):
            total += len(texts[rows[high]])
            high += 1
        yield np.array(rows[low:high])
        low = high


def _numbers(ids: list, rows: np.ndarray) -> np.ndarray:
    return np.array([NULL if ids[i] is None else ids[i] for i in rows.tolist()], np.int64)


def _places(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low half of each key as one number."""
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) << 32 | (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _scan(home: str, length: int, taps: int, buckets: int, most: int):
    """Writes the parts; sends the keys of the stretches of the leading texts to their buckets."""

    def scan(batches):
        task, number, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal number, ids, texts, held
            part = task * 1_000_000 + number
            _write_part(home, part, ids, texts)
            found = [(np.zeros(0, np.int64),) * 3]
            for rows in _sliced(sorted(set(leaders(ids, texts))), texts):
                of, _, _, key = stretches([texts[i] for i in rows], length, taps)
                doc = _numbers(ids, rows)[of]
                found.append(_reduced(_places(key, buckets), doc, doc))
            place, least, largest = _reduced(*(np.concatenate(x) for x in zip(*found, strict=True)))
            out = [(-1, part, held, b"", b"", b"")]  # the part itself, which may have no stretches at all
            out += [(b, part, 0, _packed(np.diff(place[s] & 0xFFFFFFFF, prepend=0), "<u4"), _packed(least[s], "<i8"), np.packbits(least[s] < largest[s]).tobytes()) for b, s in _by_bucket(place >> 32)]
            number, ids, texts, held = number + 1, [], [], 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "part", "bytes", "keys", "least", "several"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids += batch.column("doc_id").to_pylist()
                texts += batch.column("text").to_pylist()
                held = sum(map(len, texts))
                if held >= most:
                    yield flush()
        if ids:
            yield flush()

    return scan


def _joined(table: pa.Table, column: str, kind: str, read=_unpacked) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(read(x, kind) for x in table.column(column).to_pylist())])


SHARED = "part long, bucket long, keys binary"


def _shared():
    """The keys that two documents hold, by part; of a bucket -1, every part with nothing."""

    def shared(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "keys": pa.array([b""] * len(table), pa.binary())})
        per = [len(x) // 4 for x in table.column("keys").to_pylist()]
        key, least = _joined(table, "keys", "<u4", lambda x, t: np.cumsum(_unpacked(x, t), dtype=t)), _joined(table, "least", "<i8")
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), per, strict=True)]).astype(bool)
        part = np.repeat(table.column("part").to_numpy(), per)
        every, low, high = _reduced(key, least, least)
        found = np.searchsorted(every, key)
        both = low < high
        both[found[several]] = True
        wanted = both[found]
        key, part = key[wanted], part[wanted]
        order = np.argsort(part, kind="stable")
        out = [(b, _packed(key[order][s], "<u4")) for b, s in _by_bucket(part[order])]
        return pa.table({"part": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary())})

    return shared


PIECES = "bucket long, part long, docs binary, grams binary, keys binary, data binary, codes binary, rows binary, starts binary, marks binary"


def _distinct(data: bytes, size: np.ndarray) -> np.ndarray:
    """Number of each string among the distinct ones, in order of their first places."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def _full(lens: np.ndarray) -> np.ndarray:
    return (np.int64(1) << lens.astype(np.int64)) - 1


def _cut(home: str, length: int, taps: int, buckets: int, finer: int):
    """The bytes of the different shared stretches of each slice of one part, by bucket.

    A stretch is sent for the smallest document of the slice that holds it, with all its places in that document; the
    places in later documents are settled: their marks go to the part's own bucket, -1 - part.
    """

    def cut(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        per = [len(x) // 4 for x in table.column("keys").to_pylist()]
        want = np.sort(np.repeat(table.column("bucket").to_numpy(), per) << 32 | _joined(table, "keys", "<u4").astype(np.int64))
        ids, texts = read_part(home, part) if len(want) else ([], [])
        out: list[tuple] = []
        for rows in _sliced(sorted(set(leaders(ids, texts))), texts):
            of, at, n, key = stretches([texts[i] for i in rows], length, taps)
            place = _places(key, buckets)
            hit = want[np.minimum(np.searchsorted(want, place), len(want) - 1)] == place
            of, at, n, key = of[hit], at[hit], n[hit], key[hit]
            if not len(of):
                continue
            data = b"".join([texts[rows[o]][a : a + k + length - 1] for o, a, k in zip(of.tolist(), at.tolist(), n.tolist(), strict=True)])
            size, doc = n + length - 1, _numbers(ids, rows)[of]
            code = _distinct(data, size)
            least = np.full(code.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, code, doc)
            lead = np.unique(code, return_index=True)[1]
            later = np.flatnonzero(doc > least[code])
            if len(later):
                out.append((-1 - part, part, *[b""] * 5, _packed(rows[of[later]], "<u4"), _packed(at[later], "<u4"), _packed(_full(n[later]), "<i8")))
            begin, flat = np.cumsum(size) - size, memoryview(data)
            bucket = ((key[lead] >> np.uint64(20)) % np.uint64(finer)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(lead), np.int64)  # of a distinct stretch within its bucket
            held = np.flatnonzero(doc == least[code])
            held = held[np.argsort(bucket[code[held]], kind="stable")]
            cuts = {b: s for b, s in _by_bucket(bucket[code[held]])}
            for b, s in _by_bucket(bucket[order]):
                mine, places = lead[order[s]], held[cuts[b]]
                number[order[s]] = np.arange(len(mine))
                pieces = b"".join([flat[x : x + y] for x, y in zip(begin[mine].tolist(), size[mine].tolist(), strict=True)])
                short = key[mine] ^ key[mine] >> np.uint64(32)  # two keys of one bucket that meet in these 32 bits are indexed together
                out.append((b, part, _packed(least[order[s]], "<i8"), _packed(n[mine], "u1"), _packed(short, "<u4"), pieces, _packed(number[code[places]], "<u4"), _packed(rows[of[places]], "<u4"), _packed(at[places], "<u4"), b""))
        names = ["bucket", "part", "docs", "grams", "keys", "data", "codes", "rows", "starts", "marks"]
        cols = [*zip(*out, strict=True)] or [[]] * len(names)
        return pa.table({c: pa.array(x, pa.int64() if c in ("bucket", "part") else pa.binary()) for c, x in zip(names, cols, strict=True)})

    return cut


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, with samples at the ends of its runs.

    The transform orders the places of all grams of the strings, and one more place of each, by what follows them up to
    their string's end; its column is the byte before each place.  Only the ends of its runs of equal bytes are kept: of
    each run the place at its head, the place at the end of the run before, and the length of their common prefix.  The
    first place of a string has no byte before it and is a run of its own.

    Where two neighbours of the order have the same byte before them, the places of these bytes are neighbours too, with
    one byte more in common.  So in text order, from one run head to the next, the neighbour moves on by one place and
    the common prefix loses one byte: ``statistics`` streams both for all places from the samples alone.  (Places close
    to a string's end are not all there, but no such place lies between two grams that have ``length`` bytes in common.)
    """

    def __init__(self, data: np.ndarray, size: np.ndarray, length: int):
        self.length, self.size = length, size
        per, begin = size - length + 2, np.cumsum(size) - size
        self.string = np.repeat(np.arange(len(size)), per)
        self.offset = np.arange(len(self.string)) - np.repeat(np.cumsum(per) - per, per)
        at, left = begin[self.string] + self.offset, size[self.string] - self.offset
        padded = np.concatenate([data, np.zeros(int(size.max(initial=0)) + 16, np.uint8)])
        eight = np.empty(len(padded) - 8, ">u8")
        for o in range(8):
            part = padded[o : o + (len(padded) - o) // 8 * 8].view(">u8")
            eight[o::8] = part[: len(eight[o::8])]
        eight = eight.astype(np.uint64)
        words = []
        for o in range(0, int(size.max(initial=0)), 8):
            short = (8 * (8 - np.clip(left - o, 0, 8))).astype(np.uint64)
            words.append(np.where(short < 64, eight[at + o] >> (short & np.uint64(63)) << (short & np.uint64(63)), np.uint64(0)))
        order = np.lexsort((self.string, left, *reversed(words)))
        column = np.where(self.offset > 0, padded[at - 1].astype(np.int16), -1)[order]
        new = np.ones(len(order), bool)
        new[1:] = (column[1:] != column[:-1]) | (column[1:] < 0)
        head = np.flatnonzero(new)
        self.head = order[head]
        self.before = np.where(head > 0, order[head - 1], self.head)  # the end of the run before
        self.common = np.where(head > 0, self._common([w[self.head] ^ w[self.before] for w in words], np.minimum(left[self.head], left[self.before])), 0)

    @staticmethod
    def _common(apart: list[np.ndarray], most: np.ndarray) -> np.ndarray:
        """Equal bytes at the front, from the differences of words of eight."""
        out, open_ = np.zeros(len(most), np.int64), np.ones(len(most), bool)
        for x in apart:
            same = sum((x < np.uint64(1 << (8 * b))).astype(np.int64) for b in range(1, 8)) + (x == 0)
            out += np.where(open_, same, 0)
            open_ &= x == 0
        return np.minimum(out, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(longest match with the neighbour before it in the order, place of that neighbour) of every place, in text order."""
        rank = np.argsort(self.head)
        place = self.head[rank]
        last = np.zeros(len(self.string), np.int64)
        last[place] = np.arange(len(place))
        last = np.maximum.accumulate(last)
        moved = np.arange(len(self.string)) - place[last]
        return self.common[rank][last] - moved, self.before[rank][last] + moved

    def repeated(self, doc: np.ndarray) -> np.ndarray:
        """Whether each gram (string by string) also starts in a document smaller than its own; doc: of each string."""
        match, place = self.statistics()
        same = np.where(match >= self.length, place, np.arange(len(match)))
        while True:  # to the first of its class, by doubled steps
            further = same[same]
            if np.array_equal(further, same):
                break
            same = further
        of = doc[self.string]
        least = np.full(len(match), np.iinfo(np.int64).max)
        np.minimum.at(least, same, of)
        return (of > least[same])[self.offset <= (self.size - self.length)[self.string]]


MARKS = "part long, rows binary, starts binary, marks binary"


def _mark(length: int, most: int = 1 << 18):
    def mark(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["part", "rows", "starts", "marks"])
        data, lens = b"".join(table.column("data").to_pylist()), _joined(table, "grams", "u1").astype(np.int64)
        doc, key = _joined(table, "docs", "<i8"), _joined(table, "keys", "<u4")
        size = lens + length - 1
        begin = np.cumsum(size) - size
        code = _distinct(data, size)
        least = np.full(code.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc)
        marks = np.where(doc > least[code], _full(lens), 0)
        # one stretch of each kind, by its earliest document, where its key has several kinds
        lead = np.flatnonzero(doc == least[code])
        lead = lead[np.unique(code[lead], return_index=True)[1]]
        lead = lead[np.argsort(key[lead], kind="stable")]
        k = key[lead]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(k)))
        lead, n = lead[np.repeat(n > 1, n)], n[n > 1]
        flat, found = np.frombuffer(data, np.uint8), np.zeros(len(least), np.int64)
        bounds, low = np.cumsum(n), 0
        ends = np.cumsum(lens[lead])[bounds - 1] if len(n) else np.zeros(0, np.int64)
        while low < len(n):  # whole keys, about ``most`` grams at a time
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
            some = lead[bounds[low] - n[low] : bounds[high - 1]]
            own = size[some]
            text = flat[np.repeat(begin[some] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            hit = RunIndex(text, own, length).repeated(doc[some])
            g = np.repeat(np.arange(len(some)), lens[some])
            j = np.arange(len(g)) - np.repeat(np.cumsum(lens[some]) - lens[some], lens[some])
            np.bitwise_or.at(found, code[some][g[hit]], np.int64(1) << j[hit])
            low = high
        marks |= found[code]
        # the places of each stretch take its marks
        kinds, places = ([len(x) // w for x in table.column(c).to_pylist()] for c, w in (("docs", 8), ("codes", 4)))
        first = np.cumsum([0, *kinds[:-1]])
        mine = marks[np.repeat(first, places) + _joined(table, "codes", "<u4")]
        part, row, start = np.repeat(table.column("part").to_numpy(), places), _joined(table, "rows", "<u4"), _joined(table, "starts", "<u4")
        keep = np.flatnonzero(mine)
        keep = keep[np.argsort(part[keep], kind="stable")]
        out = [(b, _packed(row[keep][s], "<u4"), _packed(start[keep][s], "<u4"), _packed(mine[keep][s], "<i8")) for b, s in _by_bucket(part[keep])]
        cols = [*zip(*out, strict=True)] or [[], [], [], []]
        return pa.table({"part": pa.array(cols[0], pa.int64()), **{c: pa.array(x, pa.binary()) for c, x in zip(("rows", "starts", "marks"), cols[1:], strict=True)}})

    return mark


def _remove(home: str, length: int):
    """doc_id, its text's length, the removed spans and what is left."""

    def remove(table: pa.Table) -> pa.Table:
        ids, texts = read_part(home, table.column("part")[0].as_py())
        row, start, marks = (_joined(table, c, t).astype(np.int64) for c, t in (("rows", "<u4"), ("starts", "<u4"), ("marks", "<i8")))
        order = np.argsort(row, kind="stable")
        row, start, marks = row[order], start[order], marks[order]
        low, high = np.searchsorted(row, np.arange(len(ids))), np.searchsorted(row, np.arange(len(ids)), side="right")
        out = []
        for i, j in enumerate(leaders(ids, texts)):
            text = texts[i]
            if (NULL if ids[i] is None else ids[i]) > (NULL if ids[j] is None else ids[j]) and len(text) >= length:
                out.append((ids[i], len(text), [{"start": 0, "end": len(text)}], b""))
                continue
            m = marks[low[j] : high[j]]
            grams = (start[low[j] : high[j], None] + np.arange(MOST))[(m[:, None] >> np.arange(MOST)) & 1 == 1]
            if not len(grams):
                out.append((ids[i], len(text), [], text))
                continue
            depth = np.zeros(len(text) + 1, np.int32)
            np.add.at(depth, grams, 1)
            np.add.at(depth, grams + length, -1)
            gone = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
            edge = np.flatnonzero(gone[1:] != gone[:-1])
            out.append((ids[i], len(text), [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)], np.frombuffer(text, np.uint8)[~gone[1:-1]].tobytes()))
        cols = [*zip(*out, strict=True)]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()), "spans": pa.array(cols[2], span), "kept": pa.array(cols[3], pa.binary())})

    return remove


def remove_repeats(docs: DataFrame, length: int = 50, taps: int = 24, entries: int = 1_500_000, part_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_bytes, spans (start, end) and kept (bytes) of every row of docs (doc_id, text)."""
    home = run_dir(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total * 2 / (length - taps + 2)) // entries))
    scanned = rows.mapInArrow(_scan(home, length, taps, buckets, part_bytes), ENTRIES)
    shared = settle(scanned.groupBy("bucket").applyInArrow(_shared(), SHARED), f"{home}/shared", drop=True)
    parts = max(1, -(-total // part_bytes))  # a task for each part: its work follows its text, not what the shuffle moves
    pieces = shared.repartition(parts, "part").groupBy("part").applyInArrow(_cut(home, length, taps, buckets, 4 * buckets), PIECES)
    marks = settle(pieces.groupBy("bucket").applyInArrow(_mark(length), MARKS), f"{home}/marks", drop=True)
    every = shared.filter("bucket < 0").select("part", *[F.lit(b"").alias(c) for c in ("rows", "starts", "marks")])
    return marks.unionByName(every).repartition(parts, "part").groupBy("part").applyInArrow(_remove(home, length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op3_run_index(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
