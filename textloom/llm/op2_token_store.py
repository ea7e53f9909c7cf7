"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to shard offsets.

A shard holds a 16-byte head (magic, bytes per id, number of ids) and then the ids of its documents one after another,
little-endian, 2 bytes each where the vocabulary allows it and 4 otherwise.  Documents are in ascending doc_id order
within a shard and shards in ascending order of their numbers.

The index is cut by key hash into parts of about ``keys_per_part`` keys.  A part is a cascade of bit arrays: keys that
hash alone to a bit own it, the others go to the next level; the rank of a key's bit is its slot, so n keys have slots
0..n-1.  A slot stores a fingerprint of the key, the shard, the offset and the length: a lookup is one hash per level,
one rank, one comparison, whatever the number of documents.  A key that was never stored is refused by its fingerprint
(but for one in 2**32).

Cases: a null text is an empty one and holds the end id alone; rows with equal doc_id are told apart by their number
among equals; a null doc_id is a key of its own, before all others; an empty table gives no shards and an empty
result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import crc, encoder, slices, with_end
from .store import by_file, filesystem, run_dir, settle, write_file

HEAD = "<8sII"
MAGIC = b"TLIDS001"
ROWS = "doc_id long, twin int, shard long, offset long, n_tokens long"
_EVEN = 2.0  # bits per key of a level
_LEVELS = 24


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over an array of keys."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def key_of(doc_id: np.ndarray, missing: np.ndarray, twin: np.ndarray) -> np.ndarray:
    """64-bit key of (doc_id or null, number among equal doc_ids).  Distinct ids have distinct keys when twin is 0."""
    base = mix64(doc_id.astype(np.int64).view(np.uint64), 1)
    return np.where(missing | (twin > 0), mix64(base ^ mix64(twin.astype(np.uint64) * np.uint64(2) + missing.astype(np.uint64), 2), 3), base)


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        self.base = np.cumsum([0, *(int(b.sum()) for b in bits)])
        self.rank = [np.cumsum(b) - b for b in bits]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, left = [], keys
        for level in range(_LEVELS):
            if not len(left):
                break
            m = max(64, int(_EVEN * len(left)))
            at = (mix64(left, 100 + level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bits.append(alone)
            left = left[~alone[at]]
        return cls(bits, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 or any slot for a key that is not one of the n."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, b in enumerate(self.bits):
            at = (mix64(keys[open_], 100 + level) % np.uint64(len(b))).astype(np.int64)
            hit = b[at]
            out[open_[hit]] = self.base[level] + self.rank[level][at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.base[-1] + at[hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"rest": self.rest, "sizes": np.array([len(b) for b in self.bits], np.int64), "bits": np.packbits(np.concatenate([np.zeros(0, bool), *self.bits]))}

    @classmethod
    def load(cls, x) -> PerfectHash:
        flat, ends = np.unpackbits(x["bits"]).astype(bool), np.cumsum(x["sizes"])
        return cls([flat[e - n : e] for e, n in zip(ends.tolist(), x["sizes"].tolist(), strict=True)], x["rest"])


def _shard_name(home: str, shard: int) -> str:
    return f"{home}/shards/{shard:012d}.ids"


def _write_shards(home: str, path: str, end: int, most: int):
    """Encodes the rows of a task, in order, into shards of about ``most`` ids each."""

    def write(batches):
        enc, task = encoder(path), TaskContext.get().partitionId()
        width = 2 if max(enc.tok.get_vocab_size(True) - 1, end) < 1 << 16 else 4
        number, held, n_held, rows, before, twin = 0, [], 0, [], (), 0

        def flush():
            nonlocal number, held, n_held, rows
            shard = task * 1_000_000 + number
            write_file(_shard_name(home, shard), [struct.pack(HEAD, MAGIC, width, n_held), *held])
            cols = [*zip(*rows, strict=True)]
            number, held, n_held, rows = number + 1, [], 0, []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array([shard] * len(cols[0]), pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["doc_id", "twin", "shard", "offset", "n_tokens"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = with_end(*enc.encode(batch.column("text")), end)
                for doc, low, high in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    twin = twin + 1 if before == (doc,) else 0
                    before = (doc,)
                    rows.append((doc, twin, n_held + low, high - low))
                held.append(ids.astype(f"<u{width}").tobytes())
                n_held += len(ids)
                if n_held >= most:
                    yield flush()
        if rows:
            yield flush()

    return write


def write_shards(docs: DataFrame, home: str, vocabulary: str, end: int, shard_ids: int = 16 << 20) -> DataFrame:
    """Writes the shards below ``home``; doc_id, twin, shard, offset, n_tokens of every row."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.col("doc_id").asc_nulls_first()
    ordered = text.repartitionByRange(first).sortWithinPartitions(first, F.xxhash64("text"))  # a task that runs again writes the same shard
    return settle(ordered.mapInArrow(_write_shards(home, vocabulary, end, shard_ids), ROWS), f"{home}/rows")


def _keys(table: pa.Table) -> np.ndarray:
    doc = table.column("doc_id")
    missing = doc.is_null().to_numpy()
    return key_of(doc.fill_null(0).to_numpy(), missing, table.column("twin").to_numpy())


def _part_name(home: str, part: int) -> str:
    return f"{home}/index/{part:08d}.npz"


def _build_part(home: str):
    def build(table: pa.Table) -> pa.Table:
        keys, part = _keys(table), table.column("part")[0].as_py()
        index = PerfectHash.build(keys)
        slots, n = index.slots(keys), len(keys)
        assert np.array_equal(np.sort(slots), np.arange(n)), "two rows have one key"
        put = lambda x, t: (a := np.zeros(n, t), a.__setitem__(slots, x))[0]
        out = io.BytesIO()
        np.savez(out, prints=put(mix64(keys, 7) >> np.uint64(32), np.uint32), shard=put(table.column("shard").to_numpy(), np.int64), offset=put(table.column("offset").to_numpy(), np.int64), length=put(table.column("n_tokens").to_numpy(), np.int64), **index.arrays())
        write_file(_part_name(home, part), [out.getvalue()])
        return pa.table({"part": pa.array([part], pa.int64()), "n_keys": pa.array([n], pa.int64())})

    return build


def with_part(keys: DataFrame, parts: int) -> DataFrame:
    return keys.withColumn("part", F.pmod(F.xxhash64("doc_id", "twin"), F.lit(parts)).cast("long"))


def build_index(rows: DataFrame, home: str, keys_per_part: int = 200_000) -> int:
    """Writes the index below ``home``; the number of its parts."""
    parts = max(1, -(-rows.count() // keys_per_part))
    settle(with_part(rows, parts).groupBy("part").applyInArrow(_build_part(home), "part long, n_keys long"), f"{home}/parts")
    return parts


class Part:
    """One part of the index, opened from its file."""

    def __init__(self, home: str, part: int):
        fs, path = filesystem(_part_name(home, part))
        with fs.open_input_file(path) as f:
            x = dict(np.load(io.BytesIO(f.read())))
        self.hash, self.x = PerfectHash.load(x), x

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(found, shard, offset, length) of each key."""
        if not len(self.x["prints"]):
            return np.zeros(len(keys), bool), *(np.zeros((3, len(keys)), np.int64))
        slots = self.hash.slots(keys)
        at = np.maximum(slots, 0)
        found = (slots >= 0) & (self.x["prints"][at] == (mix64(keys, 7) >> np.uint64(32)).astype(np.uint32))
        return found, self.x["shard"][at], self.x["offset"][at], self.x["length"][at]


def _lookup(home: str):
    def find(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        try:
            found, shard, offset, length = Part(home, part).find(_keys(table))
        except FileNotFoundError:  # no key was ever dealt to this part
            found = shard = offset = length = np.zeros(len(table), np.int64)
        keep = pa.array(found.astype(bool))
        return pa.table({"doc_id": table.column("doc_id"), "twin": table.column("twin"), "shard": pa.array(shard), "offset": pa.array(offset), "n_tokens": pa.array(length)}).filter(keep)

    return find


def lookup(keys: DataFrame, home: str, parts: int) -> DataFrame:
    """shard, offset, n_tokens of the keys (doc_id, twin) that the index holds; keys that it doesn't hold give no row."""
    return by_file(with_part(keys.select("doc_id", "twin"), parts), "part", parts).groupBy("part").applyInArrow(_lookup(home), ROWS)


def _read(home: str, most: int):
    """Payloads of one shard's rows, read in ascending offset in stretches of about ``most`` ids."""

    def read(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        fs, path = filesystem(_shard_name(home, table.column("shard")[0].as_py()))
        starts, sizes, sums = table.column("offset").to_numpy(), table.column("n_tokens").to_numpy(), []
        with fs.open_input_file(path) as f:
            magic, width, _ = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
            assert magic == MAGIC, f"{path} is no shard"
            i = 0
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(starts, starts[i] + most)))
                f.seek(struct.calcsize(HEAD) + int(starts[i]) * width)
                data = np.frombuffer(f.read(int(starts[j - 1] + sizes[j - 1] - starts[i]) * width), f"<u{width}")
                sums += [crc(data[a : a + n]) for a, n in zip((starts[i:j] - starts[i]).tolist(), sizes[i:j].tolist(), strict=True)]
                i = j
        return table.append_column("ids_crc32", pa.array(sums, pa.int64()))

    return read


def read_payloads(places: DataFrame, home: str, stretch: int = 2 << 20) -> DataFrame:
    """The places with the crc32 of their ids, from the shards."""
    return by_file(places, "shard", places.agg(F.countDistinct("shard")).first()[0]).groupBy("shard").applyInArrow(_read(home, stretch), ROWS + ", ids_crc32 long")


def shard_bases(rows: DataFrame) -> DataFrame:
    """base (ids in all shards before) of each shard; one row per shard, so the one window is small."""
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(F.col("shard").alias("b_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    home = run_dir(spark, "ids")
    rows = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), home, public_tokenizers.path("word_bpe_49k.json"), 2)
    places = settle(lookup(rows, home, build_index(rows, home)), f"{home}/places")
    places = read_payloads(places, home)
    bases = settle(shard_bases(rows), f"{home}/bases")
    out = places.join(bases, places["shard"] == bases["b_shard"])
    return out.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
