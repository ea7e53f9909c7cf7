"""Rules as rows: patterns, word lists, allow lists, caps, counts and the score of a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import BLANK, penalty_score, per_thousand, squeeze

FINDING = "doc_id long, rule string, line int, severity string, label string, words array<string>, snippet string, seq long"


def doc_metrics(lines: DataFrame, text: str = "raw") -> DataFrame:
    """char_count, total_lines, list_lines, bold_count and prose_chars of each document, over its non-blank lines."""
    full = F.col(text).rlike(f"(?!{BLANK})[\\s\\S]")
    listed = F.col(text).rlike(r"^\s*([-*+]|[0-9]+\.)\s+") & ~F.col(text).rlike(r"[-*+]\s+\[.*?\]\(https?://")
    kind = F.col("kind") if "kind" in lines.columns else F.lit("paragraph")
    n = F.length(squeeze(F.col(text)))
    got = lines.groupBy("doc_id").agg(
        F.sum(F.when(full, n).otherwise(0)).alias("char_count"), F.sum(full.cast("long")).alias("total_lines"), F.sum((full & listed).cast("long")).alias("list_lines"),
        F.sum(F.when(full & ~kind.isin("heading", "heading_underline", "thematic_break"), n).otherwise(0)).alias("prose_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(full & F.col(text).contains("*"), F.struct("line", F.col(text).alias("t"))))), lambda x: x["t"]), "\n").alias("starred"),
    )
    # bold may span lines, but a line without an asterisk between them lies inside the pair, so it doesn't change the count
    return got.withColumn("bold_count", F.regexp_count("starred", F.lit(r"\*\*[^*]+\*\*")).cast("long")).drop("starred")


def text_metrics(docs: DataFrame) -> DataFrame:
    """The same numbers for whole texts whose lines all count as paragraphs: one row in, one row out, no shuffle."""
    full = F.filter(F.split("text", r"\r\n|\r|\n", -1), lambda x: x.rlike(f"(?!{BLANK})[\\s\\S]"))
    listed = lambda x: x.rlike(r"^\s*([-*+]|[0-9]+\.)\s+") & ~x.rlike(r"[-*+]\s+\[.*?\]\(https?://")
    chars = F.length(squeeze(F.col("text"))).cast("long")
    starred = F.array_join(F.filter("full", lambda x: x.contains("*")), "\n")
    rows = docs.select("doc_id", "text", full.alias("full"))
    return rows.select(
        "doc_id", chars.alias("char_count"), F.size("full").cast("long").alias("total_lines"), F.size(F.filter("full", listed)).cast("long").alias("list_lines"),
        chars.alias("prose_chars"), F.regexp_count(starred, F.lit(r"\*\*[^*]+\*\*")).cast("long").alias("bold_count"),
    )


def metric_rules(metrics: DataFrame, chars: int = 300, bold: float = 3.0, lists: float = 0.25) -> DataFrame:
    """excess_bold and excess_list of documents with enough text."""
    rate, share = per_thousand(F.col("bold_count"), F.col("char_count")), F.coalesce(F.try_divide(F.col("list_lines") * 1.0, F.col("total_lines")), F.lit(0.0))
    rules = F.array(F.struct(F.lit("excess_bold").alias("rule"), (rate > bold).alias("hit")), F.struct(F.lit("excess_list").alias("rule"), (share > lists).alias("hit")))
    rows = metrics.filter(F.col("char_count") > chars).select("doc_id", F.inline(rules)).filter("hit")
    return rows.select("doc_id", "rule", F.lit(1).alias("line"), F.lit("info").alias("severity"))


def lexicon_hits(lines: DataFrame, words: list[str], text: str = "raw") -> DataFrame:
    """Lines that hold words of a list: the distinct ones in order.  Longer words win where several begin."""
    pattern = "|".join(_quoted(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))
    rows = lines.filter(reduce(lambda a, b: a | b, [F.col(text).contains(w) for w in words]))
    return rows.withColumn("words", F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).filter(F.size("words") > 0)


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in word)


def allow(findings: DataFrame, allowed: list[str]) -> DataFrame:
    """Findings without the allowed words; those that have no other words left are dropped."""
    left = F.array_except("words", F.array(*[F.lit(w) for w in allowed]).cast("array<string>"))
    return findings.withColumn("words", left).filter(F.size("words") > 0)


def allow_by_rule(findings: DataFrame, allowed: list[str], rules: list[str], partial: list[str]) -> DataFrame:
    """Findings of ``rules`` that the allowed words don't cover; findings of other rules stay as they are.

    A rule in ``partial`` loses its allowed words and goes when none is left.  Any other goes as a whole: when its label
    (the quoted part, without waves and a note in brackets) is allowed, or every one of its other words is.
    """
    ok = F.array(*[F.lit(w) for w in allowed]).cast("array<string>")
    quoted = F.regexp_extract("label", "「([^」]+)」", 1)
    shown = F.when(quoted != "", quoted).otherwise(F.col("label"))
    name = F.regexp_replace(F.regexp_replace(shown, r"[ 　]*[（(][^）)]*[）)]\z", ""), r"^[〜~ 　]+|[〜~ 　]+\z", "")
    rest = F.array_except("words", F.array("label", shown, name))
    left = F.array_except("words", ok)
    covered = F.array_contains(ok, shown) | F.array_contains(ok, name) | ((F.size(rest) > 0) & (F.size(F.array_except(rest, ok)) == 0))
    goes = F.when(~F.col("rule").isin(rules), False).when(F.col("rule").isin(partial), (F.size("words") > 0) & (F.size(left) == 0)).otherwise(covered)
    return findings.filter(~goes).withColumn("words", F.when(F.col("rule").isin(rules) & F.col("rule").isin(partial), left).otherwise(F.col("words")))


def removed_by_allow(findings: DataFrame, allowed: list[str], rules: list[str]) -> DataFrame:
    """rule, removed of every rule in ``rules``: findings that ``allow`` drops, 0 where there are none."""
    left = F.array_except("words", F.array(*[F.lit(w) for w in allowed]).cast("array<string>"))
    counts = findings.filter(F.size(left) == 0).groupBy("rule").agg(F.count(F.lit(1)).alias("removed"))
    dim = findings.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return dim.join(counts, "rule", "left").select("rule", F.coalesce("removed", F.lit(0)).alias("removed"))


def capped(findings: DataFrame, most: int = 3, order: str = "line") -> DataFrame:
    """The first ``most`` findings of each document, each with the number of all of them."""
    rows = findings.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(order)))
    rows = rows.withColumn("n_all", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return rows.filter(F.col("nth") <= most)


def dense(findings: DataFrame, least: int = 3, nth: int = 3) -> DataFrame:
    """doc_id, line (of the nth), n_lines of documents with at least ``least`` lines."""
    lines = findings.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("at"))
    return lines.filter(F.size("at") >= least).select("doc_id", F.element_at("at", nth).alias("line"), F.size("at").cast("long").alias("n_lines"))


def severity_counts(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, error, warn, info, n_findings of every document, also of those without findings."""
    counts = findings.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")], F.count(F.lit(1)).alias("n_findings"))
    out = docs.select("doc_id").join(counts, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("error", "warn", "info", "n_findings")])


# Fixed values of the score: weights of severities, of rules that count once per document, and rules left out.
SEVERITY_WEIGHTS = {"error": 3, "warn": 2, "info": 1}
DOCUMENT_WEIGHTS = {"excess_bold": 2, "excess_list": 2, "bold_label_list": 1}
UNCOUNTED = ["negative_parallelism_density"]
UNSCORED = [
    "calque", "metaphor_label", "say_hedge", "thin_evaluation", "katakana_term", "dialogue_period", "narrative_density",
    "copy_comma_noun", "bare_verb_chain", "project_term", "renyo_noun", "ai_phrase",
]


def scores(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """metrics' doc_id with counts by severity, no_rule_findings and penalty_score; one aggregation of the findings."""
    weigh = lambda table, col: reduce(lambda a, kv: F.when(F.col(col) == kv[0], kv[1]).otherwise(a), table.items(), F.lit(0))
    scored, document = ~F.col("rule").isin(UNSCORED), F.col("rule").isin(list(DOCUMENT_WEIGHTS))
    counts = findings.groupBy("doc_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")], F.count(F.lit(1)).alias("n_findings"), F.count_if(scored).alias("n_scored"),
        F.sum(F.when(scored, weigh(DOCUMENT_WEIGHTS, "rule")).otherwise(0)).alias("document_weight"),
        F.sum(F.when(scored & ~document & ~F.col("rule").isin(UNCOUNTED), weigh(SEVERITY_WEIGHTS, "severity")).otherwise(0)).alias("line_weight"),
    )
    rows = metrics.select("doc_id", "prose_chars").join(counts, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    score = penalty_score(zero("n_scored"), zero("line_weight"), zero("document_weight"), F.col("prose_chars"))
    return rows.select("doc_id", *[zero(c).alias(c) for c in ("error", "warn", "info", "n_findings")], (zero("n_findings") == 0).alias("no_rule_findings"), score.alias("penalty_score"))


def gate(counts: DataFrame, strict: bool = False, fail_on: str | None = None) -> DataFrame:
    """Adds gate_hit: any finding (strict), or one of at least the severity ``fail_on`` (warn, error)."""
    hit = F.lit(False)
    if strict:
        hit = hit | (F.col("n_findings") > 0)
    if fail_on:
        hit = hit | (F.col("error") > 0) | ((F.col("warn") > 0) if fail_on == "warn" else F.lit(False))
    return counts.withColumn("gate_hit", hit)
