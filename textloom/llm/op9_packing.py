"""Best-fit packing with a swap-based local search.

Documents are encoded, an end id is added, and only those longer than a sequence are cut.  Pieces of one length are
interchangeable, so the packing works on the number of pieces by length, at most one row per length for the whole
table: best fit decreasing fills bins, kept as kinds with their number, and a local search then moves single pieces and
swaps one for one or two for one between any two underfull bins, each step increasing the sum of squared fills, until
the bound on the number of bins is reached or no step is left.  Then each piece takes the place of its rank among all
pieces of its length; blocks of about ``block`` pieces rank their own, after the counts of the blocks before them.

Cases: a null text is an empty one and gives one piece that holds the end id alone; rows with equal doc_id are
separate rows; an empty table gives an empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import crc, encoder, slices, with_end
from .store import run_dir, settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, length: int, end: int):
    def cut(batches):
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = with_end(*enc.encode(batch.column("text")), end)
                rows = []
                for doc, low, high in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    at, k = low, 0
                    step = (high - low) % length or length
                    while at < high:
                        rows.append((doc, k, at - low, step, crc(ids[at : at + step])))
                        at, k, step = at + step, k + 1, length
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def least_bins(counts: dict[int, int], length: int) -> int:
    """A number of bins that no packing of ``counts`` (pieces by size) is below: the bound L2 of Martello and Toth."""
    number = np.zeros(length + 1, np.int64)
    number[list(counts)] = list(counts.values())
    n, total = np.cumsum(number), np.cumsum(number * np.arange(length + 1))
    half, small = length // 2, np.arange(length // 2 + 1)  # pieces below small are left out
    room = length * (n[length - small] - n[half]) - (total[length - small] - total[half])
    rest = total[half] - total[small] + number[small] * small - room
    return int(n[length] - n[half] + max(0, int((-(-rest // length)).max())))


class _Bins:
    """Bins by kind (the sizes in a bin, largest first): their number, and for each room the underfull kinds by a size they hold."""

    def __init__(self, length: int):
        self.length, self.number = length, 0
        self.kinds: dict[tuple, int] = {}
        self.levels: dict[int, dict[int, dict[tuple, None]]] = {}  # room, size (0: any kind), kinds
        self.held: dict[int, int] = {}  # bit s of held[r]: levels[r] has size s
        self.rooms = 0  # bit r: there are levels[r]
        self.tree: dict[int, int] | None = None  # over rooms; bit x: a bin there gets fuller by x in exchange for one of its pieces or nothing
        self.leaves = 1 << length.bit_length()

    def _count(self, kind: tuple, n: int) -> None:
        if not kind or not n:
            return
        before = self.kinds.get(kind, 0)
        self.number += n
        self.kinds[kind] = before + n
        if not before + n:
            del self.kinds[kind]
        room = self.length - sum(kind)
        if not room or (before and before + n):
            return
        level, held = self.levels.setdefault(room, {}), self.held.get(room, 0)
        for s in {0, *kind}:
            if not before:
                level.setdefault(s, {})[kind] = None
            else:
                del level[s][kind]
                if not level[s]:
                    del level[s]
            held = held | 1 << s if s in level else held & ~(1 << s)
        if held != self.held.get(room, 0):
            self.held[room] = held
            self.rooms = self.rooms | 1 << room if held else self.rooms & ~(1 << room)
            if self.tree is not None:
                self._reach(room)

    def _reach(self, room: int) -> None:
        span, takes = 1, self.held[room]
        while span < room:
            more = min(span, room - span)
            takes |= takes << more
            span += more
        at, tree = self.leaves + room, self.tree
        tree[at] = takes << 1
        while at := at >> 1:
            tree[at] = tree.get(2 * at, 0) | tree.get(2 * at + 1, 0)

    def best_fit(self, counts: dict[int, int]) -> None:
        """Best fit decreasing; equal pieces go into all bins of a kind at once, each taking as many as it has room for."""
        for s in sorted(counts, reverse=True):
            n = counts[s]
            while n:
                if fits := self.rooms >> s:
                    room = s + (fits & -fits).bit_length() - 1
                    kind = next(iter(self.levels[room][0]))
                    have = self.kinds[kind]
                else:
                    room, kind, have = self.length, (), n
                each = room // s
                bins = min(have, n // each)
                self._count(kind, -bins)
                self._count(kind + (s,) * each, bins)
                n -= bins * each
                if bins < have and n:
                    self._count(kind, -1)
                    self._count(kind + (s,) * n, 1)
                    n = 0

    def improve(self, rounds: int | None, least: int) -> None:
        """Empty the emptiest bins: each step makes a fuller bin fuller by a move or a swap with an emptier one.

        Every underfull kind is tried with every other one and with its own copies.  Without ``rounds`` it ends when
        there is no step left or, as ``least`` bins can't be undercut, when there are no more than these.
        """
        if self.number <= least:
            return
        self.tree = {}
        for room in self.levels:
            if self.levels[room]:
                self._reach(room)
        done = 0
        while rounds is None or done < rounds:
            done += 1
            gained = False
            for first in [k for room in sorted(self.levels, reverse=True) for k in self.levels[room].get(0, ())]:
                todo = [first]
                while todo:
                    kind = todo.pop()
                    if kind in self.kinds and (left := self._step(kind)) is not None:
                        if self.number <= least:
                            return
                        gained = True
                        todo += [kind, left]
            if not gained:
                return

    def _step(self, a: tuple) -> tuple | None:
        """Take from bins of kind a into the fullest kind that gains by it as much as fits: one piece for none or one, or two."""
        room, own = self.length - sum(a), list(dict.fromkeys(a))
        if not room:
            return None
        singles = sum(1 << s for s in own)
        offer = singles
        for s in own:
            offer |= (singles if a.count(s) > 1 else singles ^ 1 << s) << s
        at = 1
        if not self.tree.get(at, 0) & offer:
            return None
        while at < self.leaves:
            at *= 2
            at += not self.tree.get(at, 0) & offer
        free = at - self.leaves
        if free > room:
            return None
        held, level, alone = self.held[free], self.levels[free], self.kinds[a] < 2
        if free == room and alone:
            for s in (0, *own):
                if len(level[s]) == 1:
                    held &= ~(1 << s)
        best, give, take = 0, (), 0
        for outs in [(s,) for s in own] + [(s, t) for i, s in enumerate(own) for t in own[i if a.count(s) > 1 else i + 1 :]]:
            x = sum(outs)
            low = max(0, x - free)
            if fits := held >> low:
                j = low + (fits & -fits).bit_length() - 1
                if x - j > best:
                    best, give, take = x - j, outs, j
        if not best:
            return None
        b = next((k for k in level[take] if k != a), a)
        bins = self.kinds[a] // 2 if b == a else min(self.kinds[a], self.kinds[b])
        mine, theirs = list(a), [*b, *give]
        for s in give:
            mine.remove(s)
        if take:
            theirs.remove(take)
            mine.append(take)
        mine, theirs = tuple(sorted(mine, reverse=True)), tuple(sorted(theirs, reverse=True))
        self._count(a, -bins)
        self._count(b, -bins)
        self._count(mine, bins)
        self._count(theirs, bins)
        return mine


def pack_counts(counts: dict[int, int], length: int, rounds: int | None = None) -> dict[tuple, int]:
    """Number of bins by kind for ``counts``, the number of pieces by size (1 to length)."""
    bins = _Bins(length)
    bins.best_fit(counts)
    bins.improve(rounds, least_bins(counts, length))
    return bins.kinds


def pack(sizes: list[int], length: int, rounds: int | None = None) -> list[list[int]]:
    """Indices of sizes by bin, in order within it."""
    left = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        left[sizes[i]].append(i)
    kinds = pack_counts({s: len(x) for s, x in left.items()}, length, rounds)
    return [[left[s].pop() for s in kind] for kind, n in kinds.items() for _ in range(n)]


def _places(kinds: dict[tuple, int]) -> np.ndarray:
    """Rows (rank, sequence, offset, each): from this rank on, among all pieces by size, ``each`` pieces a bin lie there."""
    runs, sequence = [], 0
    for kind, bins in sorted(kinds.items(), reverse=True):
        offset = 0
        for s, same in groupby(kind):
            each = len([*same])
            runs.append((s, bins * each, sequence, offset, each))
            offset += s * each
        sequence += bins
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return np.column_stack([np.cumsum(table[:, 1]) - table[:, 1], table[:, 2:]])


def _placed(places: np.ndarray, before: dict[int, int]):
    rank, sequence, offset, each = places.T
    key = [(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")]

    def block(pieces: pa.Table, earlier: pa.Table) -> pa.Table:
        pieces = pieces.combine_chunks().sort_by(key).drop_columns(["block"])
        size = pieces.column("length").to_numpy()
        by_size = np.argsort(size, kind="stable")
        kinds, first, n = np.unique(size[by_size], return_index=True, return_counts=True)
        ahead = dict(zip(earlier.column("length").to_pylist(), earlier.column("earlier").to_pylist(), strict=True))
        base = np.array([before[s] + ahead[s] for s in kinds.tolist()], np.int64)
        own = np.empty(len(size), np.int64)
        own[by_size] = np.arange(len(size)) + np.repeat(base - first, n)
        at = np.searchsorted(rank, own, side="right") - 1
        own -= rank[at]
        seq, off = sequence[at] + own // each[at], offset[at] + own % each[at] * size
        return pieces.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    return block


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 2048, end: int = 0, block: int = 20_000, rounds: int | None = None, seed: int = 5) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    home = run_dir(docs.sparkSession, "pack")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = settle(text.mapInArrow(_pieces(vocabulary, length, end), PIECES), f"{home}/pieces")
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "start", "length", "ids_crc32"), F.lit(blocks)))
    sizes = settle(dealt.groupBy("block", "length").agg(F.count("*").alias("n")), f"{home}/sizes")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()}
    before = dict(zip(counts, accumulate(counts.values(), initial=0), strict=False))
    up_to = Window.partitionBy("length").orderBy("block")
    earlier = sizes.select("block", "length", (F.sum("n").over(up_to) - F.col("n")).alias("earlier"))
    placed = _placed(_places(pack_counts(counts, length, rounds)), before)
    return dealt.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(placed, PIECES + ", sequence_id long, offset long")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
