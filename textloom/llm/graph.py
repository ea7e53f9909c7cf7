"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import remove, salted_join, settle


def components(links: DataFrame, home: str) -> DataFrame:
    """links (a, b) -> (node, component): component is the smallest node reachable; nodes without links give no row.

    Large star and small star by turns (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): each node
    hands its larger neighbours, then its smaller ones, to the smallest it knows; the links end as one star for each
    component.  Every round is written to the shared folder; the rows of a hub are salted.
    """
    now = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark, turn = settle(now, f"{home}/links-0"), None, 0
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, turn = seen, turn + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_join(both.filter("v > u"), least, ["u"], F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, f"{home}/large-{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], F.xxhash64("v")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        small = small.select("x.u", "x.v").filter("u <> v").distinct()
        now = settle(small, f"{home}/links-{turn}")
        remove(f"{home}/links-{turn - 1}")
        remove(f"{home}/large-{turn}")
