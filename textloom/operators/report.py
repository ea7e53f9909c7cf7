"""Findings as they are shown: order, phrases, JSON rows and readable reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.texts import decode, read_files, text_lines, word_list


def ordered(findings: DataFrame, *ties: str) -> DataFrame:
    """Adds seq: the place of a finding among those of its document, by line and then by ``ties``."""
    return findings.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", *ties)))


def phrases(words: Column, most: int = 3, left: str = "「", right: str = "」", more: str = "ほか%sか所") -> Column:
    """The first words in marks, and how many there are besides."""
    shown = F.array_join(F.transform(F.slice(words, 1, most), lambda w: F.concat(F.lit(left), w, F.lit(right))), "")
    return F.concat(shown, F.when(F.size(words) > most, F.format_string(more, (F.size(words) - most).cast("string"))).otherwise(""))


def json_rows(findings: DataFrame, *columns: str) -> DataFrame:
    """doc_id and findings: a JSON array of the document's findings in their order (column seq)."""
    row = F.struct("seq", F.struct(*columns).alias("x"))
    got = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    return got.select("doc_id", F.to_json(F.transform("all", lambda r: r["x"])).alias("findings"))


def report(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id and report: the numbers by severity, then each finding with its snippet; empty without findings.

    findings: doc_id, seq, line, severity, rule, message, snippet; counts: doc_id, error, warn, info.
    """
    quoted = F.filter(F.transform(F.split("snippet", "\n"), lambda x: F.regexp_replace(x, r"\s+\z", "")), lambda x: x != "")
    head = F.concat(F.lit("L"), F.col("line").cast("string"), F.lit(" ["), F.upper("severity"), F.lit("] "), F.col("rule"), F.lit(": "), F.coalesce("message", F.lit("")))
    block = F.concat_ws("\n", head, F.array_join(F.transform(quoted, lambda x: F.concat(F.lit("  > "), x)), "\n"))
    block = F.when(F.size(quoted) > 0, block).otherwise(head)
    got = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "seq", block.alias("b")))).alias("all"))
    first = F.format_string("内訳: error %d件、warn %d件、info %d件", *[F.col(c).cast("long") for c in ("error", "warn", "info")])
    body = F.concat_ws("\n\n", first, F.array_join(F.transform("all", lambda r: r["b"]), "\n\n"))
    return counts.join(got, "doc_id", "left").select("doc_id", F.when(F.col("all").isNull(), "").otherwise(body).alias("report"))


def overlapping(text: Column, pattern: str) -> Column:
    """Every match of ``pattern``, also those that overlap: one for each place where it matches."""
    return F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1))


def technical_terms(text: Column, pattern: str, general: list[str]) -> Column:
    """The different terms of a text that aren't general ones."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.array(*[F.lit(g) for g in general]))


def records(lines: DataFrame, raw: str, shape: str) -> DataFrame:
    """The fields of the objects of a JSON array in column ``raw``, one row each."""
    return lines.select("*", F.explode(F.from_json(raw, f"array<struct<{shape}>>")).alias("_x")).select(*[c for c in lines.columns if c != raw], "_x.*")


def built_in_list(spark, own: list[str], path: str | None = None) -> DataFrame:
    """word, problem: a list of the program, or the one of a file that replaces it.

    Without the file the list of the program holds; so it does where the file is no UTF-8, with a row that says so.
    """
    words = spark.createDataFrame([(w, None) for w in own], "word string, problem string")
    if path is None:
        return words
    try:
        files = decode(read_files(spark, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return words
    bad = files.filter("text is null").select(F.lit(None).cast("string").alias("word"), F.concat(F.lit("not UTF-8: "), "path").alias("problem"))
    listed = word_list(text_lines(files.filter("text is not null").select(F.col("path").alias("doc_id"), "text")))
    flag = bad.select(F.lit(1).alias("broken")).limit(1)
    read = listed.select("word", F.lit(None).cast("string").alias("problem")).join(flag, F.lit(True), "left_anti")
    return read.unionByName(words.join(flag, F.lit(True), "left_semi")).unionByName(bad)
