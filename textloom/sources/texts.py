"""Readers: files, decoding, lines, front matter, word lists, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip

LINE_END = r"\r\n|\r|\n"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path and content of every file below ``path``; hidden files and folders are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", "content").filter(~F.col("path").rlike(r"/\.[^/]"))


def admissible(path: Column) -> Column:
    """Relative paths without dot components; '-' stands for standard input."""
    return (path == "-") | (~path.startswith("/") & ~path.rlike(r"(^|/)\.[^/]*"))


def decode(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds text (one byte order mark dropped, line ends as \\n; null where the bytes are no UTF-8), bom and eol."""
    valid = F.call_function("is_valid_utf8", F.call_function("try_validate_utf8", F.col(content).cast("string")))
    raw = F.when(F.coalesce(valid, F.lit(False)), F.col(content).cast("string"))
    bom = F.coalesce(raw.startswith("﻿"), F.lit(False))
    body = F.when(bom, F.substr(raw, F.lit(2))).otherwise(raw)
    crlf, cr, lf = body.contains("\r\n"), body.rlike("\r(?!\n)"), body.rlike("(?<!\r)\n")
    count = crlf.cast("int") + cr.cast("int") + lf.cast("int")
    eol = F.when(count > 1, "mixed").when(crlf, "crlf").when(cr, "cr").when(lf, "lf").otherwise("none")
    return files.withColumns({"text": F.regexp_replace(body, "\r\n?", "\n"), "bom": bom, "eol": F.when(body.isNotNull(), eol)})


def physical_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), raw, start (code points before it), ending.  The last line may be empty."""
    ends = F.regexp_extract_all("text", F.lit(LINE_END), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(F.split("text", LINE_END, -1).alias("raw"), ends.alias("ending"))).alias("pos", "x"))
    rows = rows.select("doc_id", (F.col("pos") + 1).cast("int").alias("line"), F.col("x.raw").alias("raw"), F.coalesce("x.ending", F.lit("")).alias("ending"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("raw") + F.length("ending")).over(before), F.lit(0)).cast("long"))


def text_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, line, raw without offsets: no shuffle."""
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", LINE_END, -1)).alias("pos", "raw")).select("doc_id", *keep, (F.col("pos") + 1).cast("int").alias("line"), "raw")


def front_matter(lines: DataFrame) -> DataFrame:
    """doc_id, last (line of the closing ---), entries (key to value, the last of equal keys) of documents that have it."""
    fence = F.col("raw") == "---"
    close = lines.filter(fence & (F.col("line") > 1)).groupBy("doc_id").agg(F.min("line").alias("last"))
    opened = lines.filter(fence & (F.col("line") == 1)).select("doc_id")
    inner = lines.join(close.join(opened, "doc_id"), "doc_id").filter((F.col("line") > 1) & (F.col("line") < F.col("last")))
    pair = inner.select("doc_id", "last", "line", F.regexp_extract("raw", r"^([^:\s][^:]*):", 1).alias("key"), strip(F.regexp_extract("raw", r"^[^:\s][^:]*:(.*)\z", 1)).alias("value"))
    latest = pair.filter("key <> ''").groupBy("doc_id", "last", "key").agg(F.max_by("value", "line").alias("value"))
    found = latest.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("entries"))
    return close.join(opened, "doc_id").join(found, "doc_id", "left").select("doc_id", "last", F.coalesce("entries", F.create_map().cast("map<string,string>")).alias("entries"))


def word_list(lines: DataFrame, most: int = 10_000) -> DataFrame:
    """doc_id, line, word, replacement of a list of words: comments and blank rows skipped, a tab before the second column."""
    rows = lines.withColumn("row", strip("raw")).filter((F.col("row") != "") & ~F.col("row").startswith("#"))
    cut = F.split("row", "\t")
    out = rows.select("doc_id", "line", strip(F.get(cut, F.lit(0))).alias("word"), F.when(F.size(cut) > 1, strip(F.get(cut, F.lit(1)))).alias("replacement"))
    return out.filter((F.col("word") != "") & F.when(F.col("line") > most, F.raise_error(F.lit(f"a word list has more than {most} rows")).cast("boolean")).otherwise(True))


def index_table(lines: DataFrame, heading: str) -> DataFrame:
    """doc_id, row_no, name (a back-quoted first cell), summary of the table below a heading with this title."""
    title = F.when(F.col("raw").rlike(r"^#{1,6} "), strip(F.regexp_replace("raw", r"^#{1,6} ", "")))
    filled = lines.withColumn("title", F.last(title, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line")))
    rows = filled.filter((F.col("title") == heading) & F.col("raw").rlike(r"^\s*\|"))
    cells = F.split(F.regexp_replace("raw", r"^\s*\||\|\s*\z", ""), r"\|")
    rows = rows.select("doc_id", "line", F.regexp_extract(strip(F.get(cells, F.lit(0))), r"^`([^`]+)`\z", 1).alias("name"), strip(F.coalesce(F.get(cells, F.lit(1)), F.lit(""))).alias("summary")).filter("name <> ''")
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).drop("line")


def batch_paths(paths: DataFrame, ignored: DataFrame) -> DataFrame:
    """The paths that no row of ``ignored`` names."""
    return paths.join(ignored.select("path"), "path", "left_anti")
