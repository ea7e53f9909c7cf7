"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target number of words; the words of the corpus are the seats, which go to sources, and within a
source to its shards, by highest quotients; each shard then takes its quota from its documents in a seeded order, going
round again when the quota is larger than the shard.  Seats of more words than one would round small sources and shards
away; the divisor is searched by bisection, so the number of seats costs nothing.

Cases: a null text has size 0; a null source is a source of its own, last in order; a source of size 0 has target 0;
repeated rows are separate rows (equal ones are interchangeable); an empty table gives an empty result; columns beyond
doc_id, text and source are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import carried, restored, run_dir, salted_join, settle

WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(weights, caps, seats: int) -> np.ndarray:
    """Seats by highest quotients w/(2s+1), never above caps; equal quotients go to the lower index.

    A divisor found by bisection gives all seats but a few; the rest are dealt one by one from a heap.
    """
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    caps = np.where(w > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    at = lambda d: np.minimum(caps, np.floor(w / d + 0.5).astype(np.int64))
    low, high = 0.0, 2.0 * w.max() + 1.0  # at(high) is all zero; low stands for an infinitely small divisor
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if w.max() / mid < 2**52 and at(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    got = at(high)
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, n_docs) -> the same with ``target``: shares by weight, capped, the excess shared again.

    Sources in order of fill level cap*size/weight: those before the first one that the level of the rest does not
    reach are capped.  One row per source, so the unpartitioned windows see the source dimension only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("top", F.col("source_size").cast("double") * cap)
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    w = w.withColumn("level", F.min_by(F.when(F.col("level") * F.col("w") <= F.col("top"), F.col("level")), F.when(F.col("level") * F.col("w") <= F.col("top"), F.col("top") / F.col("w"))).over(whole))
    return w.select("source", "source_size", "n_docs", F.coalesce(F.least("top", F.col("level") * F.col("w")), F.lit(0.0)).alias("target"))


def _source_seats(cap: int):
    def seats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
        return pdf.assign(seats=sainte_lague(pdf["target"], pdf["source_size"].astype("int64") * cap, int(round(pdf["target"].sum()))))

    return seats


def _shard_seats(cap: int):
    def seats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        return pdf.assign(quota=sainte_lague(pdf["shard_size"], pdf["shard_size"].astype("int64") * cap, int(pdf["seats"].iloc[0])))

    return seats


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, docs_per_shard: int = 4_000, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    spark, home = docs.sparkSession, run_dir(docs.sparkSession, "mix")
    sized = settle(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), f"{home}/sized")
    sized = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = settle(source_targets(sources, weights, cap), f"{home}/sources")
    seats = sources.groupBy().applyInPandas(_source_seats(cap), "source string, source_size long, n_docs long, target double, seats long")
    seats = settle(seats, f"{home}/seats")
    dealt = salted_join(sized, seats, ["source"], F.col("h"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / docs_per_shard))))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    quotas = shards.groupBy("source").applyInPandas(_shard_seats(cap), "source string, shard long, shard_size long, seats long, quota long")
    quotas = settle(quotas, f"{home}/quotas").select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", "quota")
    rows = dealt.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    order = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("shard_size") > 0
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = F.expr("quota div shard_size") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") % F.col("shard_size") - before))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.when(whole, taken).otherwise(0).cast("long").alias("taken"))


def op6_mixing_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, then the first words of a document taken in part.

    Rows are matched with the mix by doc_id, source and size; rows equal in all three are numbered on both sides, so
    each takes what the mix takes of one of them.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = [c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    key = lambda i, s, n: F.xxhash64(i, s, n)
    mixed = mix(docs).select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "taken", key("doc_id", "source", "size").alias("m_key"))
    mixed = mixed.withColumn("m_number", F.row_number().over(Window.partitionBy("m_key").orderBy("m_id", "m_source", "m_size", "taken")))
    rows = carried(docs, *own).withColumn("_size", size).withColumn("_key", key("doc_id", "source", "_size"))
    rows = rows.withColumn("_number", F.row_number().over(Window.partitionBy("_key").orderBy("doc_id", "source", "_size", F.xxhash64("text"))))
    rows = rows.join(mixed.hint("merge"), (F.col("_key") == F.col("m_key")) & (F.col("_number") == F.col("m_number"))).filter("taken > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("m_size")).cast("int"))))
    left = F.col("taken") - (F.col("_copy") - 1) * F.col("m_size")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, left.cast("int")), "")
    rows = rows.withColumn("text", F.when(left >= F.col("m_size"), F.col("text")).otherwise(head))
    if "n_chars" in own:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(restored(rows, docs.columns, *own))
