"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one text: its words, symbols, repeated lines and repeated 3-word windows.  The corpus rule counts,
for each host and normalised line, the distinct documents (by text) that hold the line; lines above the limit are
boilerplate and are removed; a document that loses more than ``max_lost`` of its words that way is rejected.

The limit is ``max(min_docs, share * distinct documents of the host)``, so it follows the corpus at every size, and
exact copies of a text count once: copying a good document does not condemn it.

Cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; rows with the
same doc_id are separate rows and each is returned; an empty table gives an empty result; other columns are kept by
``filter_rules`` and not read by ``quality_rules``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import carried, restored, run_dir, salted_join, settle

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, not once per element of a lambda below it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.  Windows are compared by a 64-bit hash within one text.

    Only texts with an equal pair of windows are sorted by (hash, position); a window is marked if a neighbour in
    that order has its hash; each marked window adds the words up to the next marked one, three at most.
    """

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def marked(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def of(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(placed, marked), covered)).otherwise(0)

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(words) >= 3, let(words, lambda w: let(windows(w), of))).otherwise(0)


def norm_line(line: Column) -> Column:
    """Lines that differ in case or blanks only are one line.  Only lines with other blanks than single spaces are rewritten."""
    low = F.lower(line)
    return F.trim(F.when(low.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(low, BLANKS, " ")).otherwise(low))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, host, thash and the base counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64("text").alias("thash"), text.alias("text"), words_of(F.col("text")).alias("words"), held.alias("held"))
    return base.select(
        "doc_id", "host", "thash", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("held") - F.size(F.array_distinct("held"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def host_lines(docs: DataFrame) -> DataFrame:
    """host, thash, line (hash), n_times, n_words of each distinct non-blank normalised line of each distinct text of a host."""
    rows = docs.select(F.col("source").alias("host"), F.xxhash64("text").alias("thash"), F.explode(F.split("text", "\n")).alias("line"))
    rows = rows.select("host", "thash", norm_line(F.col("line")).alias("line")).filter("line <> ''")
    rows = rows.select("host", "thash", F.xxhash64("line").alias("line"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"))
    return rows.groupBy("host", "thash", "line").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_words").alias("n_words"))


def frequent_lines(lines: DataFrame, docs: DataFrame, share: float = 0.05, min_docs: int = 5) -> DataFrame:
    """host, line, n_docs of the lines that more than max(min_docs, share * documents) distinct documents of the host hold."""
    totals = docs.select(F.col("source").alias("host"), F.xxhash64("text").alias("thash")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    return salted_join(counts, totals, ["host"], F.col("line")).filter(F.col("n_docs") > F.greatest(F.lit(float(min_docs)), share * F.col("host_docs"))).select("host", "line", "n_docs")


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.7, share: float = 0.05, min_docs: int = 5) -> DataFrame:
    """One row per row of docs: counts, n_lost_words, n_lost_lines, base_failed and kept."""
    return _verdicts(docs, run_dir(docs.sparkSession, "rules"), min_words, max_repeat, max_lost, share, min_docs)[0]


def _verdicts(docs: DataFrame, home: str, min_words: int = 50, max_repeat: int = 50, max_lost: float = 0.7, share: float = 0.05, min_docs: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``quality_rules`` with the tables of lines and of frequent lines, both written below ``home``."""
    lines = settle(host_lines(docs), f"{home}/lines")
    frequent = settle(frequent_lines(lines, docs, share, min_docs), f"{home}/frequent")
    hit = salted_join(lines, frequent, ["host", "line"], F.col("thash"))
    lost = hit.groupBy("host", "thash").agg(F.sum(F.col("n_words") * F.col("n_rows")).alias("lost_words"), F.sum("n_rows").alias("lost_lines"))
    base = with_base(docs)
    # exact copies on one host share one row of ``lines``, whose counts are those of all copies together
    copies = docs.groupBy(F.col("source").alias("host"), F.xxhash64("text").alias("thash")).agg(F.count(F.lit(1)).alias("copies"))
    lost = lost.join(copies.withColumnsRenamed({"host": "c_host", "thash": "c_thash"}), F.col("host").eqNullSafe(F.col("c_host")) & (F.col("thash") == F.col("c_thash")))
    lost = lost.select(F.col("host").alias("l_host"), F.col("thash").alias("l_thash"), F.expr("lost_words div copies").alias("n_lost_words"), F.expr("lost_lines div copies").alias("n_lost_lines"))
    rows = base.join(lost, base["host"].eqNullSafe(F.col("l_host")) & (base["thash"] == F.col("l_thash")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    n = F.coalesce(F.col("n_lost_words"), F.lit(0))
    rows = rows.select(
        "doc_id", "host", "thash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        n.alias("n_lost_words"), F.coalesce("n_lost_lines", F.lit(0)).alias("n_lost_lines"), (~failed & (n <= max_lost * F.col("n_words"))).alias("kept"),
    )
    return rows, lines, frequent


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host", "thash")


def rules_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, without their lines above the limit."""
    home = run_dir(spark, "rules-stage")
    rows, lines, frequent = _verdicts(docs, home)
    verdict = settle(rows.filter("kept").select("doc_id", "host", "thash", "n_lost_lines").distinct(), f"{home}/kept")
    bad = verdict.filter("n_lost_lines > 0").select(F.col("host").alias("v_host"), F.col("thash").alias("v_thash")).distinct()
    held = salted_join(lines, frequent, ["host", "line"], F.col("thash")).join(bad, F.col("host").eqNullSafe(F.col("v_host")) & (F.col("thash") == F.col("v_thash")), "left_semi")
    drop = held.groupBy(F.col("host").alias("d_host"), F.col("thash").alias("d_thash")).agg(F.collect_set("line").alias("gone"))
    keep = verdict.select(F.col("doc_id").alias("k_id"), F.col("host").alias("k_host"), F.col("thash").alias("k_thash"))
    keep = keep.join(drop, F.col("k_host").eqNullSafe(F.col("d_host")) & (F.col("k_thash") == F.col("d_thash")), "left")
    own = [c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    here = carried(docs, *own).withColumn("_thash", F.xxhash64("text"))
    rows = here.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col("k_id")) & F.col("source").eqNullSafe(F.col("k_host")) & (F.col("_thash") == F.col("k_thash")))
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(norm_line(x))))
    rows = rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in own:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(restored(rows, docs.columns, *own))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), held AS (
  SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT * FROM held WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), marked AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM marked, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), norm AS (
  SELECT rid, source, text, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS nl FROM lines
), totals AS (
  SELECT source, count(DISTINCT text) AS m FROM d GROUP BY source
), freq AS (
  SELECT n.source, nl FROM (SELECT source, nl, count(DISTINCT text) AS c FROM norm GROUP BY source, nl) n
  JOIN totals t ON n.source IS NOT DISTINCT FROM t.source WHERE c > greatest(5.0, 0.05 * m)
), lost AS (
  SELECT rid, sum(len(string_split(n.nl, ' '))) AS lw, count(*) AS ll FROM norm n
  JOIN freq f ON n.source IS NOT DISTINCT FROM f.source AND n.nl = f.nl GROUP BY rid
), b AS (
  SELECT d.doc_id, len(d.words)::BIGINT AS n_words, length(array_to_string(d.words, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(lw, 0)::BIGINT AS n_lost_words, coalesce(ll, 0)::BIGINT AS n_lost_lines
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)
), v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b)
SELECT *, (NOT base_failed AND n_lost_words <= 0.7 * n_words) AS kept FROM v
"""
