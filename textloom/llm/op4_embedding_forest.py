"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors are one class.  A tree splits at every level by a random direction and a threshold; vectors within
``spill`` standard deviations of a threshold go both ways.  Leaves are compared whole: cosines of all pairs in a leaf,
in double precision, so a link is never wrong and is missed only if the two vectors share no leaf of any tree
(tests measure the recall against brute force).  A pair that shares several leaves is counted in the first of them.
Leaves of more than ``split`` classes are compared as pairs of parts, each in a task of its own.

The directions and thresholds are fitted on at most ``sample`` classes; every vector is indexed.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing, but have a row; so do
vectors of another length with those; a null vec_id is a row that links with nothing; repeated vec_ids are separate
rows with the result of their class; an empty table gives an empty result; label and other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import run_dir, salted_join, settle


class Forest:
    """Trees of one depth over unit vectors of one length: a direction per tree and level, a threshold per node."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, spill: float, seed: int, fitted: int = 64):
        r = np.random.default_rng(seed)
        self.directions = r.standard_normal((trees, depth, sample.shape[1]))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.margin = np.zeros((trees, depth))
        self.median = np.zeros((trees, depth))
        self.node: list[list[np.ndarray]] = []
        for t in range(trees):
            p, at, levels = sample @ self.directions[t].T, np.zeros(len(sample), np.int64), []
            for level in range(depth):
                x = p[:, level]
                self.margin[t, level], self.median[t, level] = spill * x.std(), np.median(x)
                if len(sample) >> level >= fitted:
                    order = np.lexsort((x, at))
                    ends = np.searchsorted(at[order], np.arange((1 << level) + 1))
                    mid = (ends[:-1] + ends[1:]) // 2
                    levels.append(np.where(np.diff(ends) > 1, x[order][np.minimum(mid, len(x) - 1)], self.median[t, level]))
                cut = levels[level][at] if level < len(levels) else self.median[t, level]
                at = at * 2 + (x >= cut)
            self.node.append(levels)

    def leaves(self, vectors: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a vector belongs to."""
        p = vectors @ self.directions[tree].T
        row, at = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for level in range(p.shape[1]):
            x, m = p[row, level], self.margin[tree, level]
            cut = self.node[tree][level][at] if level < len(self.node[tree]) else self.median[tree, level]
            left, right = x < cut + m, x >= cut - m
            row, at = np.concatenate([row[left], row[right]]), np.concatenate([at[left] * 2, at[right] * 2 + 1])
        return row, at


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(forest: Forest):
    """Adds ``leaves``: the numbers, over all trees, of the leaves that a vector belongs to, ascending."""

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, base, rows, leaves = _unit(batch.column("vector")), 0, [], []
            for t in range(len(forest.directions)):
                row, leaf = forest.leaves(x, t)
                rows.append(row)
                leaves.append(leaf + base)
                base += 1 << forest.directions.shape[1]
            row, leaf = np.concatenate(rows), np.concatenate(leaves)
            order = np.lexsort((leaf, row))
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), batch.column("vector"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf[order], pa.int64()))], ["id", "n", "vector", "leaves"])

    return index


def _earlier(a: list, b: list, leaf: int) -> np.ndarray | None:
    """Pairs of rows that share a leaf before ``leaf``."""
    number: dict[int, int] = {}
    for row in a:
        for x in row:
            if x < leaf:
                number.setdefault(x, len(number))
    if not number:
        return None

    def matrix(rows):
        m = np.zeros((len(rows), len(number)), np.float32)
        for i, row in enumerate(rows):
            for x in row:
                if x in number:
                    m[i, number[x]] = 1
        return m

    return matrix(a) @ matrix(b).T > 0


def _compare(least: float):
    def compare(table: pa.Table) -> pa.Table:
        """Rows of one leaf, or of two parts of it: links and a link to the smallest id found to be connected."""
        table = table.combine_chunks().sort_by("id")
        leaf, p, q = (table.column(c)[0].as_py() for c in ("leaf", "p", "q"))
        part = table.column("part").to_numpy()
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        x, lists = _unit(table.column("vector").chunk(0) if table.column("vector").num_chunks else table.column("vector").combine_chunks()), table.column("leaves").to_pylist()
        a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
        links, pairs, size = np.zeros(len(ids), np.int64), [], 1024
        for i in range(0, len(a), size):
            for j in range(i if p == q else 0, len(b), size):
                r, c = a[i : i + size], b[j : j + size]
                near = x[r] @ x[c].T >= least
                near &= ~(r[:, None] == c[None, :])
                if not near.any():
                    continue
                rr, cc = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                near = near[np.ix_(rr, cc)]
                r, c = r[rr], c[cc]
                if (before := _earlier([lists[k] for k in r], [lists[k] for k in c], leaf)) is not None:
                    near &= ~before
                links[r] += near @ n[c]
                if p != q or i != j:
                    links[c] += n[r] @ near
                pairs.append((r, c, near))
        label = np.arange(len(ids))  # ids ascend, so the smallest row is the smallest id
        while True:
            new = label.copy()
            for r, c, near in pairs:
                np.minimum.at(new, r, np.where(near, new[c][None, :], len(ids)).min(1))
                np.minimum.at(new, c, np.where(near, new[r][:, None], len(ids)).min(0))
            if np.array_equal(new, label):
                break
            label = new
        keep = (links > 0) | (label != np.arange(len(ids)))
        return pa.table({"id": ids[keep], "links": links[keep], "root": ids[label[keep]]})

    return compare


def near_vectors(vectors: DataFrame, least: float = 0.95, trees: int = 6, leaf_rows: int = 400, spill: float = 0.2, sample: int = 20_000, split: int = 4096, seed: int = 29) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    spark, home = vectors.sparkSession, run_dir(vectors.sparkSession, "forest")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.withColumn("vector", F.when(F.coalesce(fine, F.lit(False)), F.col("vector")))
    v = v.withColumn("key", F.when(F.col("vector").isNotNull(), F.sha2(F.array_join("vector", ","), 256)))
    members = settle(v.select("vec_id", "key"), f"{home}/members")
    classes = settle(v.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")), f"{home}/classes")
    found = []
    for length, rows in sorted((r["length"], r["rows"]) for r in classes.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("rows")).collect()):
        own = classes.filter(F.size("vector") == length).select("id", "n", "vector")
        fit = own.orderBy(F.xxhash64("id")).limit(sample).select("vector").toArrow().column("vector").combine_chunks()
        forest = Forest(_unit(fit), trees, max(0, int(np.ceil(np.log2(max(1, rows / leaf_rows))))), spill, seed)
        schema = "id long, n long, vector array<double>, leaves array<long>"
        indexed = settle(own.mapInArrow(_index(forest), schema), f"{home}/indexed-{length}")
        sizes = settle(indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > split).select("leaf", F.ceil(F.col("rows") / split).alias("parts")), f"{home}/large-{length}")
        for t in range(trees):  # one tree at a time: the vectors lie on disk about twice, not once per tree and spill
            low, high = t << forest.directions.shape[1], (t + 1) << forest.directions.shape[1]
            dealt = indexed.withColumn("leaf", F.explode(F.filter("leaves", lambda x: (x >= low) & (x < high))))
            dealt = salted_join(dealt, sizes, ["leaf"], F.xxhash64("id"), "left")
            dealt = dealt.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("parts"))).cast("int"))
            others = F.transform(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")), lambda o: F.struct(F.least("part", o).alias("p"), F.greatest("part", o).alias("q")))
            dealt = dealt.withColumn("pq", F.explode(F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(others)))
            dealt = dealt.select("id", "n", "vector", "leaves", "leaf", "part", "pq.p", "pq.q")
            found.append(settle(dealt.groupBy("leaf", "p", "q").applyInArrow(_compare(least), "id long, links long, root long"), f"{home}/found-{length}-{t}"))
    if not found:
        found = [spark.createDataFrame([], "id long, links long, root long")]
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), home)
    each = classes.select("key", "id", "n").join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    each = each.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = salted_join(members, each, ["key"], F.xxhash64("vec_id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_forest(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
