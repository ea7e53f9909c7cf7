"""Half-open spans of code points: finding, merging, testing, blanking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

URL = r"(?:https?://|\bwww\.)[^\s<>\"']+"
TAG = r"<(?:!--[\s\S]*?-->|/?[A-Za-z][^<>]*>)"
COMMENT = r"<!--[\s\S]*?-->"


def find_spans(docs: DataFrame, text: str, pattern: str, kind: str) -> DataFrame:
    """doc_id, s, e, kind, hit of every match.  Positions are sums over the pieces between matches."""
    cut, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(cut.alias("gap"), hits.alias("hit"))).alias("n", "x")).filter("x.hit is not null")
    rows = rows.select("doc_id", "n", F.length("x.gap").alias("gap"), F.col("x.hit").alias("hit"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.sum(F.col("gap") + F.length("hit")).over(w))
    return rows.select("doc_id", (F.col("e") - F.length("hit")).alias("s"), "e", F.lit(kind).alias("kind"), "hit")


def trim_urls(spans: DataFrame) -> DataFrame:
    """Without the punctuation that ends a sentence rather than a bare address, and a closing bracket without its opener."""
    hit = F.regexp_replace("hit", r"[?!.,:*_~;]+\z", "")
    odd = hit.endswith(")") & (F.regexp_count(hit, F.lit(r"\)")) > F.regexp_count(hit, F.lit(r"\(")))
    hit = F.when(odd, F.regexp_replace(hit, r"\)\z", "")).otherwise(hit)
    return spans.withColumn("hit", hit).withColumn("e", F.col("s") + F.length("hit"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """doc_id, s, e of the unions of touching spans."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    rows = spans.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(w))
    return rows.groupBy("doc_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def overlapping(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """The ranges (doc_id, lo, hi) that overlap a span."""
    other = spans.select(F.col("doc_id").alias("o_doc"), "s", "e")
    return ranges.join(other, (F.col("doc_id") == F.col("o_doc")) & (F.col("s") < F.col("hi")) & (F.col("e") > F.col("lo")), "left_semi")


def blanked(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``visible``: text with merged spans replaced by as many blanks."""
    merged = merge_spans(spans).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("holes"))
    rows = docs.join(merged, "doc_id", "left")
    step = lambda a, h: F.struct(F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, (h["s"] - a["at"]).cast("int")), F.repeat(F.lit(" "), (h["e"] - h["s"]).cast("int"))).alias("out"), h["e"].cast("int").alias("at"))
    filled = F.aggregate("holes", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)))
    return rows.withColumn("visible", F.when(F.col("holes").isNull(), F.col(text)).otherwise(filled)).drop("holes")
