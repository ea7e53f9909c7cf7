r"""Line dedup by winnowing over line hashes.

A text is a sequence of its non-blank lines, normalised (case and blanks) and hashed.  Fingerprints are hashes of
``k`` lines in a row; of every ``w`` fingerprints in a row the smallest is selected, so two texts that share a run of
``w + k - 1`` lines share a selected fingerprint.  Fingerprints found at two positions or more are joined with their
positions; each is extended both ways to the runs of ``w + k - 1`` lines around it; a run equal to one that starts at
an earlier (doc_id, line) is deleted.  Overlaps count, and runs are judged on the input, not on what is left.

With ``words`` a shorter run counts too when its lines have that many words together; such runs are few and are compared
as they are, without fingerprints.  The pipeline's stage does so; the query does not, since its SQL knows runs of 3 lines.

Cases: a null text stays null, a text of fewer than ``w + k - 1`` non-blank lines stays as it is unless ``words`` is
given; blank lines are neither counted nor deleted; rows with equal doc_id are at equal positions, so neither is earlier and identical rows
get the same result; a null doc_id comes first; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .op8_quality_rules import let, norm_line
from .store import carried, restored, run_dir, salted_join, settle


def named(*of: Column) -> Column:
    """A 128-bit name, so that runs are told apart in a corpus of any size."""
    return F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b"))


def winnowed(grams: Column, w: int) -> Column:
    """Positions of the smallest of every w grams in a row, the first of equals."""
    best = lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - w + 1), lambda s: s + F.array_position(F.slice(g, s, w), F.array_min(F.slice(g, s, w))).cast("int") - 1)
    return F.when(F.size(grams) >= w, F.array_distinct(best(grams)))


def line_hashes(docs: DataFrame, counted: bool = False) -> DataFrame:
    """doc_id, thash, hs (hashes of the non-blank normalised lines) and, if counted, ws (their words) of every row."""
    norm = lambda t: F.filter(F.transform(F.split(t, "\n"), norm_line), lambda x: x != "")
    if not counted:
        return docs.select("doc_id", F.xxhash64("text").alias("thash"), F.transform(norm(F.col("text")), lambda x: F.xxhash64(x)).alias("hs"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("thash"), F.transform(norm(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.regexp_count(x, F.lit(" ")) + 1).alias("w"))).alias("x"))
    return rows.select("doc_id", "thash", F.col("x.h").alias("hs"), F.col("x.w").alias("ws"))


def wordy_runs(texts: DataFrame, run: int, words: int) -> DataFrame:
    """doc_id, thash, s, r (hash), n (lines) of every run of fewer than ``run`` lines that has ``words`` words or more."""

    def of(n: int) -> Column:
        total = lambda s: F.aggregate(F.slice("ws", s, n), F.lit(0), lambda a, b: a + b)
        starts = F.when(F.size("hs") >= n, F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("hs") - (n - 1))), lambda s: total(s) >= words)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("s"), named(F.lit(n), F.slice("hs", s, n)).alias("r"), F.lit(n).alias("n")))

    return texts.select("doc_id", "thash", F.inline(F.concat(*[of(n) for n in range(1, run)])))


def repeated_lines(docs: DataFrame, w: int, k: int, home: str, words: int | None = None) -> DataFrame:
    """doc_id, thash, at (sorted positions, from 1, among the non-blank lines, that are to be deleted)."""
    run = w + k - 1
    known = settle(line_hashes(docs, words is not None).filter(F.size("hs") >= (run if words is None else 1)).distinct(), f"{home}/texts")
    texts = known.filter(F.size("hs") >= run)
    grams = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - k + 1)), lambda i: F.xxhash64(F.slice(h, i, k)))
    prints = texts.select("doc_id", "thash", F.size("hs").alias("n"), let(grams(F.col("hs")), lambda g: F.transform(winnowed(g, w), lambda p: F.struct(p.alias("p"), F.get(g, p - 1).alias("g")))).alias("fp"))
    prints = settle(prints.select("doc_id", "thash", "n", F.inline("fp")), f"{home}/prints")
    shared = prints.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g")
    near = salted_join(prints, shared, ["g"], F.xxhash64("doc_id", "p")).select("doc_id", "thash", F.explode(F.sequence(F.greatest(F.lit(1), F.col("p") - (w - 1)), F.least(F.col("p"), F.col("n") - (run - 1)))).alias("s"))
    near = near.groupBy("doc_id", "thash").agg(F.collect_set("s").alias("ss"))
    t2 = texts.select(F.col("doc_id").alias("t_id"), F.col("thash").alias("t_hash"), "hs")
    near = near.join(t2, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("thash") == F.col("t_hash")))
    runs = near.select("doc_id", "thash", F.explode(F.transform("ss", lambda s: F.struct(s.alias("s"), named(F.lit(run), F.slice("hs", s, run)).alias("r")))).alias("x")).select("doc_id", "thash", "x.*")
    runs = runs.withColumn("n", F.lit(run))
    if words is not None and run > 1:
        runs = runs.unionByName(wordy_runs(known, run, words))
    runs = settle(runs, f"{home}/runs")
    first = runs.groupBy("r").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    later = salted_join(runs, first, ["r"], F.xxhash64("doc_id", "s")).filter(F.struct("doc_id", "s") > F.col("first"))
    gone = later.select("doc_id", "thash", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("p"))
    return gone.groupBy("doc_id", "thash").agg(F.sort_array(F.collect_set("p")).alias("at"))


def dedup_lines(docs: DataFrame, w: int = 2, k: int = 2, words: int | None = None) -> DataFrame:
    """docs with their later repeated runs deleted from ``text``, and n_lines (non-blank), n_removed and n_runs.

    Columns of docs with these three names are replaced.
    """
    home = run_dir(docs.sparkSession, "lines")
    gone = settle(repeated_lines(docs, w, k, home, words), f"{home}/gone").withColumnsRenamed({"doc_id": "_id", "thash": "_hash", "at": "_at"})
    rows = carried(docs, "doc_id", "text").withColumn("_thash", F.xxhash64("text"))
    # always by sorting: whether the deletions fit a broadcast must not decide how much the texts move
    rows = rows.join(gone.hint("merge"), rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["_thash"] == gone["_hash"]), "left")
    held = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("x"), x.rlike(r"[^\x20\x09-\x0D]").alias("full")))

    def left(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda v, i: F.when(v["full"], i).otherwise(-1)), lambda i: i >= 0)
        cut = lambda pl: F.transform(F.col("_at"), lambda p: F.get(pl, p - 1))
        kept = lambda c: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), c)
        return F.array_join(F.transform(let(let(places, cut), kept), lambda i: F.get(lines, i)["x"]), "\n")

    n = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    runs = F.size(F.filter(F.transform("_at", lambda p, i: F.coalesce(p - F.get(F.col("_at"), i - 1) > 1, F.lit(True))), lambda x: x))
    return rows.select(
        *restored(rows, [c for c in docs.columns if c not in ("text", "n_lines", "n_removed", "n_runs")], "doc_id"), F.when(F.col("_at").isNull(), F.col("text")).otherwise(let(held, left)).alias("text"),
        F.coalesce(F.when(F.col("text").isNull(), 0).otherwise(n), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_at").isNull(), 0).otherwise(F.size("_at")).cast("long").alias("n_removed"), F.when(F.col("_at").isNull(), 0).otherwise(runs).cast("long").alias("n_runs"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str, words: int = 50) -> DataFrame:
    own = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    out = dedup_lines(carried(docs, *own).withColumnRenamed("_carried", "_rest"), words=words).withColumnRenamed("_rest", "_carried")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(restored(out, docs.columns, *own))


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, text, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
), norm AS (
  SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS nl FROM raw
), num AS (
  SELECT doc_id, pos, line, nl, CASE WHEN nl <> '' THEN count(*) FILTER (WHERE nl <> '') OVER (PARTITION BY doc_id ORDER BY pos) END AS p FROM norm
), runs AS (
  SELECT a.doc_id, a.p AS s, a.nl || chr(10) || b.nl || chr(10) || c.nl AS r FROM num a
  JOIN num b ON b.doc_id = a.doc_id AND b.p = a.p + 1 JOIN num c ON c.doc_id = a.doc_id AND c.p = a.p + 2
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY r ORDER BY doc_id, s) AS n FROM runs) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, s + k AS p FROM later, (SELECT unnest([0, 1, 2]) AS k)),
g AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE f) AS n_runs FROM
  (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 1, true) AS f FROM gone) GROUP BY doc_id),
k AS (
  SELECT n.doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM num n LEFT JOIN gone o ON n.doc_id = o.doc_id AND n.p = o.p
  WHERE o.p IS NULL GROUP BY n.doc_id
), c AS (SELECT doc_id, count(p) AS n_lines FROM num GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
