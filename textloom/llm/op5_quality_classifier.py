"""Byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes.  Each byte has a learned vector; filters of 12 bytes slide over them in steps of 4; chunks
of 256 bytes, each reaching 8 bytes into the next one, cover the whole text; a filter's value in a chunk is its
largest; the means and maxima over all chunks go through one hidden layer into one probability.

The net is trained on the driver from a bounded sample, ``max_train`` labelled rows taken in the order of a seeded
hash of doc_id and read whole; scoring reads every text whole, in blocks of bounded size.

Cases: a null text is an empty one and gets the score of a text without bytes; rows with equal doc_id are scored one
by one; a sample without two classes gives a constant score; an empty table gives an empty result; lang, source and
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import slices
from .store import run_dir, settle

SLICE = 8 << 20  # bytes of text scored at once

STEP, TAPS, CHUNK = 4, 3, 64  # bytes a step, steps a filter spans, steps a chunk
BYTES = STEP * CHUNK
REACH = STEP * (TAPS - 1)


def layout(texts: list[bytes], most: int = 1 << 20):
    """Blocks of texts as (indices, bytes padded to whole chunks, first chunk of each text, number of chunks).

    A text longer than ``most`` bytes is a block of its own, which ``pooled`` goes through piece by piece.
    """
    low = 0
    while low < len(texts):
        n, total, high = [], 0, low
        while high < len(texts) and (high == low or total + len(texts[high]) + BYTES <= most):
            n.append(-(-(len(texts[high]) + REACH) // BYTES))
            total += n[-1] * BYTES
            high += 1
        data, at = np.zeros(total, np.uint8), 0
        for text, k in zip(texts[low:high], n, strict=True):
            data[at : at + len(text)] = np.frombuffer(text, np.uint8)
            at += k * BYTES
        n = np.array(n)
        yield range(low, high), data, np.cumsum(n) - n, n
        low = high


class Net:
    """Weights: bytes (256, d), filters (STEP*d, TAPS*f), their bias (f), hidden (2f, h) and out (h)."""

    def __init__(self, seed: int = 3, d: int = 8, f: int = 24, h: int = 16):
        r = np.random.default_rng(seed)
        new = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.f = f
        self.w = {"e": new(256, d, scale=0.5), "c": new(STEP * d, TAPS * f, scale=0.15), "cb": np.zeros(f, np.float32), "h": new(2 * f, h, scale=0.2), "hb": np.zeros(h, np.float32), "o": new(h, scale=0.3), "ob": np.zeros(1, np.float32)}

    def convolve(self, data: np.ndarray) -> np.ndarray:
        """(steps, f) filter values; the last REACH bytes of data have none of their own but are looked at."""
        x = self.w["e"][data].reshape(-1, STEP * self.w["e"].shape[1])
        y = x @ self.w["c"]
        f, n = self.f, len(x) - TAPS + 1
        return y[:n, :f] + y[1 : n + 1, f : 2 * f] + y[2 : n + 2, 2 * f :] + self.w["cb"]

    def pooled(self, data: np.ndarray, last: np.ndarray, block: int = 512) -> np.ndarray:
        """(chunks, f) largest filter values, at least 0, block by block; ``last``: the last chunk of each text.

        The last steps of a last chunk would look into the next text; what they see of their own is padding.
        """
        out, n = np.empty((len(data) // BYTES, self.f), np.float32), len(data)
        for c in range(0, len(out), block):
            part = data[c * BYTES : min(n, (c + block) * BYTES + REACH)]
            if len(part) % BYTES != REACH:
                part = np.concatenate([part, np.zeros(REACH, np.uint8)])
            y = self.convolve(part).reshape(-1, CHUNK, self.f)
            y[last[(last >= c) & (last < c + block)] - c, 1 - TAPS :] = 0
            out[c : c + block] = y.max(1)
        return np.maximum(out, 0)

    def head(self, chunks: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        g = np.concatenate([np.add.reduceat(chunks, first) / n[:, None], np.maximum.reduceat(chunks, first)], axis=1).astype(np.float32)
        z = g @ self.w["h"] + self.w["hb"]
        a = np.maximum(z, 0)
        return g, z, a, 1 / (1 + np.exp(-np.clip(a @ self.w["o"] + self.w["ob"][0], -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for rows, data, first, n in layout(texts):
            out[rows.start : rows.stop] = self.head(self.pooled(data, first + n - 1), first, n)[-1]
        return out

    def gradients(self, data: np.ndarray, first: np.ndarray, n: np.ndarray, want: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f, d = self.w, self.f, self.w["e"].shape[1]
        padded = np.concatenate([data, np.zeros(REACH, np.uint8)])
        y = self.convolve(padded).reshape(-1, CHUNK, f)
        y[first + n - 1, 1 - TAPS :] = 0
        arg, chunks = y.argmax(1), np.maximum(y.max(1), 0)
        g, z, a, p = self.head(chunks, first, n)
        dl = ((p - want) * weight / len(want)).astype(np.float32)
        out = {"o": a.T @ dl, "ob": np.array([dl.sum()], np.float32)}
        dz = np.outer(dl, w["o"]) * (z > 0)
        out |= {"h": g.T @ dz, "hb": dz.sum(0)}
        dg = dz @ w["h"].T
        of = np.repeat(np.arange(len(n)), n)
        dc = (dg[:, :f] / n[:, None])[of]
        top = chunks == np.maximum.reduceat(chunks, first)[of]
        dc += np.where(top, dg[of, f:] / np.maximum(np.add.reduceat(top, first)[of], 1), 0)
        dc *= chunks > 0
        out["cb"] = dc.sum(0)
        at = (np.arange(len(chunks))[:, None] * CHUNK + arg) * STEP  # first byte that each filter saw in each chunk
        dw, de = np.zeros_like(w["c"]), np.zeros_like(w["e"])
        taps = w["c"].reshape(STEP, d, TAPS, f)
        dt = dw.reshape(STEP, d, TAPS, f)
        for t in range(TAPS):
            for s in range(STEP):
                seen = padded[at + t * STEP + s]  # (chunks, f)
                dt[s, :, t] += np.einsum("cfd,cf->df", w["e"][seen], dc)
                for k in range(d):
                    de[:, k] += np.bincount(seen.ravel(), (dc * taps[s, k, t]).ravel(), 256).astype(np.float32)
        return out | {"c": dw, "e": de}

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 1 << 17, rate: float = 4e-3, seed: int = 3) -> Net:
        """Adam over shuffled batches of about ``batch`` bytes; the classes weigh the same."""
        r, labels = np.random.default_rng(seed), np.asarray(labels, float)
        weight = np.where(labels > 0, len(labels) / max(1, labels.sum()), len(labels) / max(1, len(labels) - labels.sum())) / 2
        m, v, step = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0
        total = epochs * max(1, sum(map(len, texts)) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for rows, data, first, n in layout([texts[i] for i in order], batch):
                pick = order[rows.start : rows.stop]
                step += 1
                now = rate * max(0.05, 1 - step / (1.2 * total))
                for k, grad in self.gradients(data, first, n, labels[pick], weight[pick]).items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 4000, max_bytes: int = 64 << 20, seed: int = 11) -> Net | float:
    """The net, or a constant score where the sample has one class or none.

    The sample: at most max_train labelled rows in the order of a hash, and of those as many as hold max_bytes together.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_train)
    so_far = Window.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("so_far", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(so_far)).filter(F.col("so_far") <= max_bytes).drop("so_far").toArrow()
    y = rows.column("quality").to_numpy() if len(rows) else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    return Net().train([x or b"" for x in rows.column("text").to_pylist()], y)


def _scores(net: Net | float):
    def score(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts = [x or b"" for x in batch.column("text").to_pylist()]
                got = np.full(len(texts), net) if isinstance(net, float) else net.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64())], ["doc_id", "held_out", "score"])

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    net = fit(docs, labels, max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = settle(rows.mapInArrow(_scores(net), "doc_id long, held_out boolean, score double"), f"{run_dir(docs.sparkSession, 'quality')}/scores")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
