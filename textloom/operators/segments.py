"""From lines to sentences, paragraphs and runs; all of it DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import BLANK, strip


def pieces(text: Column, ends: str) -> Column:
    """text cut after each character of the class ``ends``, trimmed, empty pieces dropped."""
    return F.filter(F.transform(F.split(text, f"(?<=[{ends}])"), strip), lambda x: x != "")


def sentence_records(lines: DataFrame, text: str = "raw", ends: str = "。！？", least: int = 4) -> DataFrame:
    """doc_id, line, seq, sentence of at least ``least`` characters; other columns of lines are kept."""
    rows = lines.select(*[c for c in lines.columns if c != text], F.posexplode(pieces(F.col(text), ends)).alias("pos", "sentence"))
    return rows.filter(F.length("sentence") >= least).withColumn("seq", F.col("pos") + 1).drop("pos")


def multi_sentence_lines(lines: DataFrame, text: str = "raw", ends: str = "。！？", closers: str = "」）』") -> DataFrame:
    """Lines where something other than ends, closers and blanks follows an end."""
    return lines.filter(F.col(text).rlike(f"[{ends}](?![{ends}{closers}\\s]*\\z)"))


def islands(rows: DataFrame, by: list[str], order: str, same: Column) -> DataFrame:
    """Adds island: a number that grows where ``same`` (a row like the one before it) is false."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("island", F.sum(F.when(same, 0).otherwise(1)).over(w))


def ending_runs(sentences: DataFrame, kind: Column, by: list[str], order: str = "seq", at: int = 3) -> DataFrame:
    """The ``at``-th sentence of every run of at least ``at`` sentences with one kind; a null kind breaks runs."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = sentences.withColumn("kind", kind)
    # the at-th of a run: the at - 1 before it have its kind, the one before those hasn't; all in one window
    rows = rows.withColumns({f"_{n}": F.coalesce(F.lag("kind", n).over(w) == F.col("kind"), F.lit(False)) for n in range(1, at + 1)})
    hit = ~F.col(f"_{at}")
    for n in range(1, at):
        hit = hit & F.col(f"_{n}")
    return rows.filter(F.col("kind").isNotNull() & hit).drop(*[f"_{n}" for n in range(1, at + 1)])


def with_neighbours(sentences: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return sentences.withColumns({"before": F.lag("sentence").over(w), "after": F.lead("sentence").over(w)})


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines equal to an earlier one of the document, with the first of them."""
    w = Window.partitionBy("doc_id", "raw").orderBy("line")
    rows = lines.filter(F.col("raw").rlike(f"(?!{BLANK})[\\s\\S]"))
    rows = rows.withColumn("first_line", F.first("line").over(w))
    return rows.filter("line > first_line").select("doc_id", "line", "first_line", "raw")


def paragraphs(lines: DataFrame, text: str = "raw") -> DataFrame:
    """doc_id, paragraph, first_line, n_lines, body: runs of non-blank lines, joined without a mark."""
    full = lines.filter(F.col(text).rlike(f"(?!{BLANK})[\\s\\S]"))
    w = Window.partitionBy("doc_id").orderBy("line")
    rows = islands(full, ["doc_id"], "line", F.coalesce(F.lag("line").over(w) == F.col("line") - 1, F.lit(False)))
    got = rows.groupBy("doc_id", F.col("island").alias("paragraph")).agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("line", F.col(text).alias("t")))).alias("x"))
    return got.withColumn("body", F.array_join(F.transform("x", lambda r: r["t"]), "")).drop("x")


def line_at(positions: DataFrame, lines: DataFrame) -> DataFrame:
    """positions (doc_id, pos) with the line that holds each: the last one that starts at or before it."""
    w = Window.partitionBy("doc_id").orderBy("start")
    ranges = lines.select(F.col("doc_id").alias("l_doc"), "line", "start", F.lead("start").over(w).alias("next"))
    inside = (F.col("pos") >= F.col("start")) & (F.col("next").isNull() | (F.col("pos") < F.col("next")))
    return positions.join(ranges, (F.col("doc_id") == F.col("l_doc")) & inside).drop("l_doc", "start", "next")


def sentences_in_context(lines: DataFrame, text: str, ends: str = "。！？!?", kinds: tuple[str, ...] = ("paragraph", "list"), before: tuple[str, ...] = ("paragraph", "list", "heading")) -> DataFrame:
    """doc_id, block, line, raw, pos, sentence of the ``kinds``, with the sentences around each.

    following: the next piece of the same block, else empty.  previous: the whole sentence before it, put together over
    line breaks; the first sentence of a block has the last one of the block above, if that is one of ``before``.
    ``lines`` holds whole documents (doc_id, block, line, kind, raw and the ``text`` column) without blank lines.
    """
    rows = lines.select("doc_id", "block", "kind", "line", "raw", F.posexplode_outer(pieces(F.col(text), ends)).alias("pos", "sentence"))
    rows = rows.withColumns({"pos": F.coalesce("pos", F.lit(0)), "sentence": F.coalesce("sentence", F.lit(""))})
    block = Window.partitionBy("doc_id", "block").orderBy("line", "pos")
    done = F.coalesce(F.lag(F.col("sentence").rlike(f"[{ends}]\\z")).over(block), F.lit(False)).cast("int")
    rows = rows.withColumn("done", done).withColumns({"nth": F.sum("done").over(block), "following": F.coalesce(F.lead("sentence").over(block), F.lit(""))})
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("line", "pos", "sentence"))), lambda x: x["sentence"])
    whole = rows.groupBy("doc_id", "block", "nth").agg(F.first("kind").alias("kind"), F.array_join(in_order, "").alias("whole"))
    above = Window.partitionBy("doc_id").orderBy("block", "nth")
    whole = whole.withColumn("previous", F.when(F.lag("kind").over(above).isin(*before), F.lag("whole").over(above)).otherwise(""))
    out = rows.filter(F.col("kind").isin(*kinds) & (F.col("sentence") != "")).join(whole.select("doc_id", "block", "nth", "previous"), ["doc_id", "block", "nth"])
    return out.select("doc_id", "block", "line", "raw", "pos", "sentence", "following", "previous")


def joined_parts(lines: DataFrame, by: list[str], text: str, cut: Column) -> DataFrame:
    """by, part, x, joined: the text of lines in a row, joined without a mark; lines that ``cut`` part them and are left out.

    x holds line, v (the text), raw and start, the place of v in joined, of every line of the part in order.
    """
    w = Window.partitionBy(*by).orderBy("line")
    rows = lines.select(*by, "line", "raw", F.col(text).alias("v"), cut.cast("int").alias("cut")).withColumn("part", F.sum("cut").over(w))
    rows = rows.filter("cut = 0 and v <> ''")
    before = Window.partitionBy(*by, "part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("v")).over(before), F.lit(0)))
    whole = rows.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("line", "v", "raw", "start"))).alias("x"))
    return whole.withColumn("joined", F.array_join(F.transform("x", lambda r: r["v"]), ""))


def lines_of_matches(parts: DataFrame, by: list[str], pattern: str) -> DataFrame:
    """by, line, raw of the lines in which a match over the joined text of ``joined_parts`` begins."""
    between, hits = F.split("joined", pattern, -1), F.regexp_extract_all("joined", F.lit(pattern), F.lit(0))
    size = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda t, s: t + F.length(s))
    starts = F.transform(F.sequence(F.lit(1), F.size(hits)), lambda n: size(between, n) + size(hits, n - 1))
    line = lambda p: F.array_max(F.filter("x", lambda r: r["start"] <= p))
    return parts.filter(F.col("joined").rlike(pattern)).select(*by, F.explode(F.array_distinct(F.transform(starts, line))).alias("r")).select(*by, "r.line", "r.raw")
