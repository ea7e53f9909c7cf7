"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds the 64-bit hashes of its distinct k-word shingles.  Sets are banded by size; two sets that can
be similar lie in one band or in neighbouring ones, so every band is a scheme that also takes the sets of the band
below.  In a scheme similar sets differ in at most H elements.  The universe of hashes is cut into segments, and each
segment is given a weight: 1, then a set is indexed by the exact content of the segment, or 2, then also by every
content that is left when one element is deleted (the one-deletion neighbourhood).  Two sets that differ in fewer
elements of a segment than its weight share a key of it.  The weights add up to H + 1 + c, so similar sets share keys
of segments of weight c + 1 or more together.

How many segments of a scheme get weight 2 is chosen by cost (``allocation``): keys to be written against pairs to be
compared in vain, from the number of sets of the scheme and the second moment of the shingles' frequencies, both
counted over all rows.  Weight 2 halves the number of segments, so that they hold twice as many shingles and agree by
chance far less often, for one key per shingle: it pays where very many sets share frequent shingles.

The c spare units pay for costly segments: a set may leave out segments of weight c together that are empty or whose
content very many sets share, and is still found by another one.  Only sets that have more of them are looked up there.

Sets that share a key are chained, neighbours first; chains are verified exactly and joined to components.  Where a
key's sets are still in several components, all pairs across components whose parity sketches (a sound bound of the
difference) allow a link are verified too.  So no link between components is lost, and inside a component none is
needed.  Sets are compared by their 64-bit hashes and named by a 128-bit hash of the whole set, so rows are classes of
equal sets from the start, whatever their doc_ids.

Cases: a null text, or one without words, has an empty set and links with nothing; a text of fewer than k words has
one shingle; equal sets are one class; rows with equal doc_id and different texts are compared each for itself; a row
without doc_id links like any other but gives no component its name (null, if all rows of a component are without);
an empty table gives an empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import slices
from .graph import components
from .op2_token_store import mix64
from .store import carried, remove, restored, run_dir, salted_join, settle, tidy

PERCENT = 80
FIRST = 12  # groups of a set that its list of first ones holds
SLICE = 3 << 20  # bytes of text worked on at once
MOMENTS = 16  # counters of the second moment: its error is about a third


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, offsets); A-Z count as a-z."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = cut.offsets.to_numpy().astype(np.int64)
    book = cut.flatten().dictionary_encode()
    code = book.indices.to_numpy(zero_copy_only=False)
    names = book.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))
    full = np.fromiter(map(bool, names), bool, len(names))[code] if len(names) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(full)])
    return hashes[code[full]] if len(names) else np.zeros(0, np.uint64), ends[bounds - bounds[0]]


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, ends = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0x9DDFEA08EB382D69) + words[j : j + len(rolled)]
        rolled = mix64(rolled, 5)
        out = []
        for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if high - low >= k:
                out.append(np.unique(rolled[low : high - k + 1]))
            elif high > low:
                short = np.uint64(high - low)
                for w in words[low:high]:
                    short = short * np.uint64(0x9DDFEA08EB382D69) + w
                out.append(mix64(np.array([short]), 6))
            else:
                out.append(rolled[:0])
    return out


def tops(most: int) -> np.ndarray:
    """Largest sizes of the bands, up to one that holds ``most``."""
    out = [4]
    while out[-1] < most:
        out.append(out[-1] * 5 // 4)
    return np.array(out)


def differ_of(top: int) -> int:
    """Elements in which similar sets of at most ``top`` elements can differ."""
    return 2 * top * (100 - PERCENT) // (100 + PERCENT)


def spare_of(differ: int) -> int:
    return (differ + 1) // 2 if differ < 4 else 2 + -(-(differ + 1) * 12 // 100)


def allocation(top: int, sets: int, alike: float) -> int:
    """How many segments of the scheme get weight 2: the number of least cost.

    Cost: keys of all sets, and pairs of sets that share a key by chance.  A segment of a set of size n holds a number
    of elements near Poisson(n / segments); ``alike`` is the chance that two shingles of the corpus are equal, and keys
    of one element are the ones that chance makes equal.
    """
    need, n = differ_of(top) + 1 + spare_of(differ_of(top)), 0.8 * top

    def cost(twos: int) -> float:
        segments = need - twos
        mean = n / segments
        one, two = mean * math.exp(-mean), mean * mean / 2 * math.exp(-mean)
        chance = (segments - twos) * one * one + twos * (one + 2 * two) ** 2
        return sets * (segments + twos * mean) + sets * sets / 2 * alike * chance

    return min(range(need // 2 + 1), key=lambda a: (cost(a), a))


class Scheme:
    """Band number i: sets of the band and of the one below."""

    def __init__(self, number: int, top: int, twos: int = 0):
        self.number, self.top, self.twos = number, top, twos
        self.spare = spare_of(differ_of(top))
        self.segments = differ_of(top) + 1 + self.spare - twos  # the first ``twos`` of them have weight 2
        self.bits = -(-top // 64) * 64

    def keys(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set number, key) of each entry, and the spare weight that the empty contents leave each set.

        The lowest bit of a key tells the weight of its segment: 1 for 2.
        """
        m, of = self.segments, np.repeat(np.arange(len(n)), n)
        seg = ((mix64(flat, 1000 + self.number) >> np.uint64(11)) % np.uint64(m)).astype(np.int64)
        at, parts = of * m + seg, mix64(flat, 2000)
        total = np.zeros(len(n) * m, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(total, at, parts)
        count = np.bincount(at, minlength=len(total)).reshape(-1, m)
        two = np.arange(m) < self.twos
        slack = self.spare - (np.where(two, 2, 1) * ((count == 0) | (two & (count == 1)))).sum(1)
        all_of = slack < 0  # these sets are also looked up by empty contents
        exact = np.flatnonzero((count > 0).ravel() | np.repeat(all_of, m))
        less = np.flatnonzero((seg < self.twos) & ((count.ravel()[at] > 1) | all_of[of]))
        with np.errstate(over="ignore"):
            content = np.concatenate([total[exact], total[at[less]] - parts[less]])
        seg = np.concatenate([exact % m, seg[less]])
        key = mix64(content ^ mix64(seg.astype(np.uint64), 3000 + self.number), 4000)
        return np.concatenate([exact // m, of[less]]), key & ~np.uint64(1) | two[seg].astype(np.uint64), slack

    def sketches(self, flat: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Parities of the elements by cell: they differ in no more cells than the sets differ in elements."""
        of = np.repeat(np.arange(len(n)), n)
        at = of * self.bits + (mix64(flat, 5000) % np.uint64(self.bits)).astype(np.int64)
        rows = np.packbits((np.bincount(at, minlength=len(n) * self.bits) & 1).astype(bool)).reshape(len(n), -1)
        return [r.tobytes() for r in rows]


def _by_scheme(sets: list[np.ndarray], rows: list[int], twos: dict[int, int] | None = None):
    """(scheme, rows, flat, sizes): each set in the scheme of its band and in the next."""
    size = np.array([len(sets[i]) for i in rows], np.int64)
    if not len(size):
        return
    top = tops(int(size.max()))
    top = np.append(top, top[-1] * 5 // 4)
    band = np.searchsorted(top, size)
    for s in range(len(top)):
        mine = np.flatnonzero(((band == s) | (band == s - 1)) & (size >= 4))  # smaller sets are similar when equal
        if len(mine):
            yield Scheme(s, int(top[s]), (twos or {}).get(s, 0)), [rows[i] for i in mine], np.concatenate([sets[rows[i]] for i in mine]), size[mine]


def _signature(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


FACTS = "doc_id long, thash long, n long, sig binary, sketches array<struct<scheme:int,sketch:binary>>, moments array<long>"


def _facts(k: int):
    """n, signature and, for both schemes, the sketch of each row; the first row of a slice has its sums of signs."""
    kind = pa.list_(pa.struct([("scheme", pa.int32()), ("sketch", pa.binary())]))

    def facts(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text"), k)
                out: list[list] = [[] for _ in sets]
                for scheme, rows, flat, n in _by_scheme(sets, [*range(len(sets))]):
                    for i, s in zip(rows, scheme.sketches(flat, n), strict=True):
                        out[i].append({"scheme": scheme.number, "sketch": s})
                sigs = [_signature(x) if len(x) else None for x in sets]
                signs = mix64(np.concatenate([np.zeros(0, np.uint64), *sets]), 7000)
                sums = [2 * int(((signs >> np.uint64(r)) & np.uint64(1)).sum()) - len(signs) for r in range(MOMENTS)]
                moments = pa.array([sums, *[None] * (len(sets) - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("thash"), pa.array(map(len, sets), pa.int64()), pa.array(sigs, pa.binary()), pa.array(out, kind), moments], ["doc_id", "thash", "n", "sig", "sketches", "moments"])

    return facts


def _postings(k: int, buckets: int, twos: dict[int, int]):
    """Index entries by bucket, packed: a table of sets, what each has in spare, its entries, and the low halves of the keys."""

    def postings(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text"), k)
                once: dict[bytes, int] = {}  # equal sets of a batch have the same entries
                for i, x in enumerate(sets):
                    if len(x) >= 4:
                        once.setdefault(_signature(x), i)
                sigs = {i: s for s, i in once.items()}
                doc, key, kind, left = [], [], [], []
                for scheme, rows, flat, n in _by_scheme(sets, [*sigs], twos):
                    d, x, slack = scheme.keys(flat, n)
                    doc.append(np.array(rows)[d])
                    key.append(x)
                    kind.append(np.full(len(x), scheme.number, np.uint8))
                    left.append(np.clip(slack, -1, 32767)[d])
                if not doc:
                    continue
                doc, key, kind, left = np.concatenate(doc), np.concatenate(key), np.concatenate(kind), np.concatenate(left)
                at = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((kind, doc, at))
                doc, key, kind, left, at = doc[order], key[order], kind[order], left[order], at[order]
                edges = np.flatnonzero(np.diff(at)) + 1
                rows = []
                for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                    d, first, n = np.unique(doc[low:high] * 256 + kind[low:high], return_index=True, return_counts=True)
                    rows.append((int(at[low]), b"".join([sigs[i] for i in (d >> 8).tolist()]), (d & 255).astype(np.uint8).tobytes(), left[low:high][first].astype("<i2").tobytes(), n.astype("<u4").tobytes(), key[low:high].astype("<u4").tobytes()))
                cols = [*zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "sigs", "schemes", "slacks", "counts", "keys"])

    return postings


def _named(names: np.ndarray) -> pa.Array:
    """16-byte names as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.arange(0, 16 * len(names) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(names).tobytes())])


GROUPS = "gid long, scheme int, node binary, prev binary, size int, weight int, slack int"


def _groups():
    """Sets that share a key: a row for each, with the one before it; groups of the same sets become one."""

    def groups(table: pa.Table) -> pa.Table:
        get = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
        n, kinds, slack = get("counts", "<u4"), get("schemes", np.uint8), get("slacks", "<i2")
        names, node = np.unique(get("sigs", "V16"), return_inverse=True)
        of = np.repeat(np.arange(len(node)), n)
        low = get("keys", "<u4").astype(np.int64)
        key = ((low >> 1) << 9) | (kinds[of].astype(np.int64) << 1) | (low & 1)
        order = np.lexsort((node[of], key))
        key, of = key[order], of[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[of][1:] != node[of][:-1])
        key, of = key[new], of[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        keep = np.repeat(size >= 2, size)
        key, of, size = key[keep], of[keep], size[size >= 2]
        start = np.cumsum(size) - size
        doc, kind, weight = node[of], ((key >> 1) & 255).astype(np.int32), ((key & 1) + 1).astype(np.int32)
        halves = np.ascontiguousarray(names).view("<u8").reshape(-1, 2) if len(names) else np.zeros((0, 2), np.uint64)
        with np.errstate(over="ignore"):
            mark = mix64(halves[:, 0], 8) + mix64(halves[:, 1], 9)
            gid = mix64(np.add.reduceat(mark[doc], start) ^ kind[start].astype(np.uint64), 10).view(np.int64) if len(start) else np.zeros(0, np.int64)
        _, pick, same = np.unique(gid, return_index=True, return_inverse=True)
        total = np.bincount(same, weights=weight[start], minlength=len(pick)).astype(np.int32) if len(pick) else np.zeros(0, np.int32)
        n = size[pick]
        at = np.repeat(start[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        first = np.zeros(len(at), bool)
        first[np.cumsum(n) - n] = True
        prev = pc.if_else(pa.array(first), pa.scalar(None, pa.binary()), _named(names[doc[np.maximum(at - 1, 0)]]))
        return pa.table({"gid": np.repeat(gid[pick], n), "scheme": kind[at], "node": _named(names[doc[at]]), "prev": prev, "size": np.repeat(n, n).astype(np.int32), "weight": np.repeat(total, n), "slack": slack[of[at]].astype(np.int32)})

    return groups


def _sets(k: int):
    def sets(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = shingle_sets(batch.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array([_signature(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "set"])

    return sets


def _verified(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            keep.append(bool(same) and 100 * same >= PERCENT * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _allowed(batches):
    """Pairs that sizes and sketches allow to be similar."""
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        apart = np.fromiter((int(np.bitwise_count(np.frombuffer(a.as_buffer(), np.uint8) ^ np.frombuffer(b.as_buffer(), np.uint8)).sum()) for a, b in zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True)), np.int64, batch.num_rows)
        fine = (apart * (100 + PERCENT) <= (n_a + n_b) * (100 - PERCENT)) & (np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * PERCENT)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fine))


def allowed(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """pairs (a, b, scheme) -> those (a, b) whose sketches of the scheme (each: f_node, f_scheme, n, sketch) allow a link."""
    of = lambda x: each.select(F.col("f_node").alias(x), F.col("f_scheme").alias("scheme"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    joined = pairs.join(of("a"), ["a", "scheme"]).join(of("b"), ["b", "scheme"])
    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_allowed, "a binary, b binary")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, home: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar, by their whole sets: each node's from one document of its class."""
    pairs = settle(pairs.distinct(), f"{home}-pairs")
    need = pairs.select(F.explode(F.array("a", "b")).alias("need")).distinct()
    need = need.join(classes, F.col("need") == F.col("sig")).select(F.col("first.doc_id").alias("r_id"), F.col("first.thash").alias("r_hash")).distinct()
    texts = docs.join(need.hint("merge"), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("thash") == F.col("r_hash")), "left_semi")
    sets = settle(texts.select("doc_id", "text").mapInArrow(_sets(k), "node binary, set binary").dropDuplicates(["node"]), f"{home}-sets")
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    links = settle(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_verified, "a binary, b binary").distinct(), f"{home}-links")
    remove(f"{home}-sets")
    return links


def _pairs(low: np.ndarray, high: np.ndarray, most: int = 1 << 20):
    """(i, j) for all j from low[i] to high[i], in chunks of about ``most``; a row with more partners is a chunk of its own."""
    n = np.maximum(high - low, 0)
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        m = n[at:to]
        i = np.repeat(np.arange(at, to), m)
        yield i, low[i] + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        at = to


def _across():
    """Pairs of each group, or of two parts of one, in different components, that their sketches allow.

    A pair that shares several groups comes from the first of them as far as the sets' lists of first groups tell.
    """

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("scheme", "gid", "p", "q", "part")]).combine_chunks()
        gid, p, q, part, scheme, n = (table.column(c).to_numpy() for c in ("gid", "p", "q", "part", "scheme", "n"))
        comp = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        sketch, node = table.column("sketch").combine_chunks(), table.column("node").combine_chunks()
        early = np.full((len(table), FIRST), np.iinfo(np.int64).max)
        for i, x in enumerate(table.column("early").to_pylist()):
            early[i, : len(x)] = x
        new = np.ones(len(table), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (scheme[1:] != scheme[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(table))
        size = end - start
        # in a group of two parts the rows of p come first, and their partners are those of q
        second = start + np.add.reduceat(((part == p) & (p != q)).astype(np.int64), start) if len(start) else start
        low, high = np.where(p == q, np.arange(len(table)) + 1, np.repeat(second, size)), np.repeat(end, size)
        high = np.where((p != q) & (part != p), low, high)
        out = []
        edges = [0, *(np.flatnonzero(np.diff(scheme)) + 1).tolist(), len(table)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            words = np.frombuffer(b"".join(sketch.slice(a, b - a).to_pylist()), "<u8").reshape(b - a, -1)
            for i, j in _pairs(low[a:b] - a, high[a:b] - a):
                both, less = n[a + i] + n[a + j], np.minimum(n[a + i], n[a + j])
                fine = np.flatnonzero((comp[a + i] != comp[a + j]) & (less * 100 >= (both - less) * PERCENT))
                i, j, both = i[fine], j[fine], both[fine]
                apart = np.zeros(len(i), np.int64)
                for w in range(words.shape[1]):
                    apart += np.bitwise_count(words[i, w] ^ words[j, w])
                near = apart * (100 + PERCENT) <= both * (100 - PERCENT)
                i, j = a + i[near], a + j[near]
                seen = np.zeros(len(i), bool)
                for x in range(FIRST):
                    mine = early[i, x]
                    for y in range(FIRST):
                        seen |= (mine == early[j, y]) & (mine < gid[i])
                out.append(np.stack([i[~seen], j[~seen]]))
        i, j = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
        x, y = node.take(pa.array(i)), node.take(pa.array(j))
        less = pc.less(x, y)
        return pa.table({"a": pc.if_else(less, x, y), "b": pc.if_else(less, y, x)})

    return across


def _classes(docs: DataFrame, k: int, entries: int, hot: int, split: int) -> tuple[DataFrame, DataFrame]:
    """(facts of every row, sig, first row and component name of every class)."""
    home = run_dir(docs.sparkSession, "shingles")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("thash"), "text")
    facts = settle(docs.mapInArrow(_facts(k), FACTS), f"{home}/facts")
    total = facts.agg(F.sum("n")).first()[0] or 0
    # one row per scheme and one per counter: both few, whatever the corpus
    moment = facts.filter("moments is not null").select(F.posexplode("moments")).groupBy("pos").agg(F.sum("col").cast("double").alias("s"))
    alike = max(1.0, moment.agg(F.avg(F.col("s") * F.col("s"))).first()[0] or 1.0) / max(1.0, float(total)) ** 2
    counts = {r[0]: r[1] for r in facts.select(F.explode("sketches.scheme").alias("s")).groupBy("s").count().collect()}
    top = tops(4)
    while len(top) <= max(counts, default=0):
        top = np.append(top, top[-1] * 5 // 4)
    twos = {s: allocation(int(top[s]), n, min(1.0, alike)) for s, n in counts.items()}
    buckets = max(1, -(-int(total * 0.6) // entries))
    packed = docs.select("text").mapInArrow(_postings(k, buckets, twos), "bucket long, sigs binary, schemes binary, slacks binary, counts binary, keys binary")
    groups = settle(packed.groupBy("bucket").applyInArrow(_groups(), GROUPS), f"{home}/groups")
    tidy(docs.sparkSession)
    # the first row of a class names its text: with a doc_id if one has it
    row = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "thash")
    classes = facts.filter("sig is not null").groupBy("sig").agg(F.min(row).alias("first"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    classes = settle(classes, f"{home}/classes")
    each = classes.filter("n >= 4").select(F.col("sig").alias("f_node"), "n", F.inline("sketches")).withColumnRenamed("scheme", "f_scheme")
    chains = groups.filter("prev is not null").select(F.least("prev", "node").alias("a"), F.greatest("prev", "node").alias("b"), "scheme").distinct()
    near = verify(allowed(chains, each), docs, classes, k, f"{home}/chain")
    tidy(docs.sparkSession)
    first = settle(components(near, f"{home}/first"), f"{home}/first-components").withColumnRenamed("node", "c_node")

    # groups as sets, without the rows of light sets in hot groups: those are found by another segment
    whole = groups.groupBy("gid", "scheme", "node").agg(F.sum("weight").alias("weight"), F.first("size").alias("size"), F.first("slack").alias("slack"))
    count = whole.groupBy(F.col("node").alias("h_node"), F.col("scheme").alias("h_scheme")).agg(F.sum(F.when(F.col("size") > hot, F.col("weight")).otherwise(0)).alias("hot"), F.first("slack").alias("slack"))
    used = count.join(each, (F.col("h_node") == F.col("f_node")) & (F.col("h_scheme") == F.col("f_scheme")))
    used = used.join(first, F.col("h_node") == F.col("c_node"), "left").select("h_node", "h_scheme", "n", "sketch", (F.col("hot") <= F.col("slack")).alias("light"), F.coalesce("component", "h_node").alias("comp"))
    used = settle(used, f"{home}/used")
    held = whole.join(used.drop("sketch"), (F.col("node") == F.col("h_node")) & (F.col("scheme") == F.col("h_scheme"))).filter(~(F.col("light") & (F.col("size") > hot)))
    held = settle(held.select("gid", "scheme", "node", "comp"), f"{home}/held")
    # what is written is all that later steps read: the rest, shuffle files included, makes room
    del whole, count, chains, groups, packed
    remove(f"{home}/groups")
    tidy(docs.sparkSession)
    mixed = held.groupBy("gid", "scheme").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low < high")
    mixed = mixed.select("gid", "scheme", F.ceil(F.col("rows") / split).cast("int").alias("parts"))
    # by sorting: the repeated right side is many times what the optimizer takes it for
    rows = settle(salted_join(held, mixed.hint("merge"), ["gid", "scheme"], F.xxhash64("node")), f"{home}/mixed")
    early = rows.groupBy(F.col("node").alias("e_node")).agg(F.slice(F.array_sort(F.collect_set("gid")), 1, FIRST).alias("early"))
    rows = rows.join(early, F.col("node") == F.col("e_node"))
    rows = rows.join(used.select("h_node", "h_scheme", "n", "sketch"), (F.col("node") == F.col("h_node")) & (F.col("scheme") == F.col("h_scheme")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("pq", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("p"), F.greatest("part", o).alias("q")))))
    # small groups share a cell, so that a call of the Python stage is worth its while; parts of a split group have one each
    cells = max(1, rows_of(f"{home}/mixed", docs.sparkSession) // 5_000)
    cell = F.when(F.col("parts") > 1, F.xxhash64("gid", "scheme", "pq")).otherwise(F.pmod(F.xxhash64("gid", "scheme"), F.lit(cells)))
    rows = rows.select(cell.alias("cell"), "gid", "scheme", "node", "comp", "n", "sketch", "early", "part", "pq.p", "pq.q")
    more = rows.groupBy("cell").applyInArrow(_across(), "a binary, b binary").distinct()
    last = verify(more, docs, classes, k, f"{home}/across")
    del rows, more, early, mixed, held, used, first
    for name in ("held", "mixed", "used", "first", "first-components"):
        remove(f"{home}/{name}")
    tidy(docs.sparkSession)
    found = settle(components(near.unionByName(last), f"{home}/last"), f"{home}/last-components")

    # a component is named by its smallest doc_id; its first row is the one that stays where one row is to stay
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    linked = found.join(classes.select("sig", "first"), F.col("node") == F.col("sig")).select("node", "component", "first")
    names = linked.groupBy("component").agg(F.min("first").alias("lead"))
    linked = salted_join(linked.select("node", "component"), names.hint("merge"), ["component"], F.xxhash64("node")).select("node", "lead")
    classes = classes.join(linked, F.col("sig") == F.col("node"), "left").select("sig", "first", F.coalesce("lead", "first").alias("lead"))
    return facts, settle(classes, f"{home}/named")


def rows_of(uri: str, spark) -> int:
    return spark.read.parquet(uri).count()


def near_documents(docs: DataFrame, k: int = 5, entries: int = 500_000, hot: int = 64, split: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    facts, classes = _classes(docs, k, entries, hot, split)
    out = salted_join(facts.select("doc_id", "n", "sig"), classes.select("sig", F.col("lead.doc_id").alias("lead_id")).hint("merge"), ["sig"], F.xxhash64("doc_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("lead_id")).alias("component_id"))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: of those with its smallest doc_id one with the smallest text hash.

    Rows without doc_id and rows without words stay.  Rows with equal doc_id in different components stay, one of each.
    """
    facts, classes = _classes(docs, 5, 500_000, 64, 4096)
    keep = classes.filter("first = lead and not first.bare").select(F.col("first.doc_id").alias("k_id"), F.col("first.thash").alias("k_hash"), F.lit(False).alias("k_all"))
    keep = keep.unionByName(facts.filter("sig is null and doc_id is not null").select(F.col("doc_id").alias("k_id"), F.col("thash").alias("k_hash"), F.lit(True).alias("k_all")).distinct())
    rows = carried(docs, "doc_id", "text").withColumn("_thash", F.xxhash64("text"))
    known = rows.filter("doc_id is not null").join(keep.hint("merge"), (F.col("doc_id").cast("long") == F.col("k_id")) & (F.col("_thash") == F.col("k_hash")))
    known = known.withColumn("_each", F.when(F.col("k_all"), F.monotonically_increasing_id())).dropDuplicates(["k_id", "k_hash", "_each"])
    out = known.select("doc_id", "text", "_carried").unionByName(rows.filter("doc_id is null").select("doc_id", "text", "_carried"))
    return out.select(restored(out, docs.columns, "doc_id", "text"))
