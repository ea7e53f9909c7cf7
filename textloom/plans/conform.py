"""Conformance of a collection of files: violations(check, path, message) from relations of files, indexes and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import semver, strip
from textloom.sources.texts import front_matter, text_lines

NAME = r"^[a-z0-9]+(-[a-z0-9]+)*\z"


def _violations(rows: DataFrame, check: str, tests: dict[str, Column]) -> DataFrame:
    found = F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in tests.items()]), lambda x: x.isNotNull())
    return rows.select(F.lit(check).alias("check"), "path", F.explode(found).alias("message"))


def _with_front_matter(files: DataFrame) -> DataFrame:
    """files(path, kind, name, text) with n_lines, entries, headings."""
    docs = files.select(F.col("path").alias("doc_id"), "text")
    lines = text_lines(docs)
    fm = front_matter(lines).select(F.col("doc_id").alias("path"), "entries")
    heads = lines.filter(F.col("raw").rlike(r"^#+ ")).groupBy(F.col("doc_id").alias("path")).agg(F.collect_list("raw").alias("headings"))
    n = F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n") | (F.col("text") == ""), 1).otherwise(0)
    return files.withColumn("n_lines", n).join(fm, "path", "left").join(heads, "path", "left").withColumn("headings", F.coalesce("headings", F.array().cast("array<string>")))


def rule_files(files: DataFrame, limit: int = 30, scope: str = "対象外") -> DataFrame:
    """Rule files: name, front matter with trigger and description, size, a first-level heading, a scope section."""
    rows = _with_front_matter(files.filter("kind = 'rule'"))
    lacks = lambda k: F.col("entries").isNotNull() & (F.coalesce(F.col("entries")[k], F.lit("")) == "")
    return _violations(rows, "rules", {
        "name is not lower case letters, digits and hyphens": ~F.col("name").rlike(NAME), "no front matter": F.col("entries").isNull(), "no trigger": lacks("trigger"), "no description": lacks("description"),
        "too many lines": F.col("n_lines") > limit, "no heading": ~F.exists("headings", lambda h: h.startswith("# ")), "no scope section": ~F.exists("headings", lambda h: h.rlike(rf"^##\s*{scope}")),
    })


def skill_files(files: DataFrame, limit: int = 200) -> DataFrame:
    """Skill folders: name, presence of the document, its front matter's name and description, its size."""
    rows = _with_front_matter(files.filter("kind = 'skill'"))
    have = F.col("text").isNotNull()
    return _violations(rows, "skills", {
        "name is not lower case letters, digits and hyphens": ~F.col("name").rlike(NAME), "no document": ~have, "no front matter": have & F.col("entries").isNull(),
        "name differs from the folder": F.col("entries").isNotNull() & ~F.coalesce(F.col("entries")["name"] == F.col("name"), F.lit(False)),
        "no description": F.col("entries").isNotNull() & (F.coalesce(F.col("entries")["description"], F.lit("")) == ""), "too many lines": have & (F.col("n_lines") > limit),
    })


def section_sizes(lines: DataFrame, limit: int = 5) -> DataFrame:
    """doc_id, section, title, body_lines of the second-level sections with more than ``limit`` non-blank lines."""
    head = F.col("raw").startswith("## ")
    rows = lines.withColumn("section", F.sum(head.cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))).filter("section > 0")
    got = rows.groupBy("doc_id", "section").agg(F.max(F.when(head, strip(F.expr("substr(raw, 4)")))).alias("title"), F.sum((~head & (strip(F.col("raw")) != "")).cast("long")).alias("body_lines"))
    return got.filter(F.col("body_lines") > limit)


def two_way(actual: DataFrame, listed: DataFrame) -> DataFrame:
    """name, problem of names on one side only: 'unlisted' or 'orphan'."""
    a, b = actual.select("name").distinct(), listed.select("name").distinct()
    return a.join(b, "name", "left_anti").withColumn("problem", F.lit("unlisted")).unionByName(b.join(a, "name", "left_anti").withColumn("problem", F.lit("orphan")))


def plan_status(lines: DataFrame, label: str = "状態", running: str = "進行中", others: str = "完了|中断") -> DataFrame:
    """doc_id, problem of check lists without a status line, or still running with all items checked."""
    checked, open_ = F.col("raw").rlike(r"^\s*[-*]\s+\[[xX]\]"), F.col("raw").rlike(r"^\s*[-*]\s+\[ \]")
    status = F.regexp_extract("raw", rf"^{label}[:：]\s*({running}|{others})", 1)
    got = lines.groupBy("doc_id").agg(F.bool_or(checked | open_).alias("has_list"), F.bool_or(open_).alias("has_open"), F.min_by(status, F.when(status != "", F.col("line"))).alias("status")).filter("has_list")
    problem = F.when(F.col("status").isNull(), "no status line").when((F.col("status") == running) & ~F.col("has_open"), "all items checked but still running")
    return got.select("doc_id", problem.alias("problem")).filter("problem is not null")


def json_contract(rows: DataFrame, raw: str, required: dict[str, str], optional: dict[str, str] | None = None) -> DataFrame:
    """rows with ``problems``: keys of a JSON object that are missing or of another type.

    Types are string (not blank), number, boolean, array, object; a null value counts as missing.
    """
    parsed = F.try_parse_json(raw)
    shape = F.when(parsed.isNotNull(), F.schema_of_variant(parsed))
    rows = rows.withColumns({"_v": parsed, "_shape": shape})
    tests = [F.when(F.col("_v").isNull(), "not JSON").when(~F.col("_shape").startswith("OBJECT"), "not an object")]
    kinds = {"string": ["STRING"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
    for need, keys in ((True, required), (False, optional or {})):
        for key, kind in keys.items():
            got = F.try_variant_get(F.col("_v"), f"$.{key}", "variant")
            seen = F.when(got.isNotNull() & ~F.is_variant_null(got), F.schema_of_variant(got))
            right = F.lit(False)
            for k in kinds[kind]:
                right = right | seen.startswith(k)
            if kind == "string":
                right = right & (strip(F.try_variant_get(F.col("_v"), f"$.{key}", "string")) != "")
            wrong = F.when(seen.isNotNull() & ~right, f"{key}: not a {kind}")
            test = F.when(seen.isNull(), f"{key}: missing").otherwise(wrong) if need else wrong
            tests.append(F.when(F.col("_shape").startswith("OBJECT"), test))
    return rows.withColumn("problems", F.filter(F.array(*tests), lambda x: x.isNotNull())).drop("_v", "_shape")


def version_checks(rows: DataFrame) -> DataFrame:
    """rows(id, base, head, structural) with verdict and the version that a bump would give.

    A structural change (a deleted or renamed file) needs a higher minor or major version, any other a higher version.
    """
    b, h = semver(F.col("base")), semver(F.col("head"))
    higher = h > b
    minor = F.struct(h["major"], h["minor"]) > F.struct(b["major"], b["minor"])
    verdict = F.when(b.isNull() | h.isNull(), "not a version").when(b == h, "not changed").when(~higher, "not higher").when(F.col("structural") & ~minor, "needs a minor version").otherwise("ok")
    dotted = lambda *x: F.concat_ws(".", *[c.cast("string") for c in x])
    bump = F.when(b.isNull(), None).when(F.col("structural"), dotted(b["major"], b["minor"] + 1, F.lit(0))).otherwise(dotted(b["major"], b["minor"], b["patch"] + 1))
    return rows.withColumns({"verdict": verdict, "planned": F.when(verdict == "ok", F.col("head")).otherwise(bump)})


def structural(changes: DataFrame, by: str) -> DataFrame:
    """by, structural: whether any change (status, path) deletes or renames."""
    return changes.groupBy(by).agg(F.bool_or(F.col("status").rlike("^[DR]")).alias("structural"))


def totals(violations: DataFrame, checks: list[str]) -> DataFrame:
    """check, n, passed of every check, also of those without violations."""
    dim = violations.sparkSession.createDataFrame([(c,) for c in checks], "check string")
    counts = violations.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("passed"))


def line_multisets(pairs: DataFrame) -> DataFrame:
    """pair_id, side, raw, extra: lines that one side has more often than the other."""
    side = lambda c, s: pairs.select("pair_id", F.explode(F.split(c, "\n")).alias("raw"), F.lit(s).alias("d"))
    rows = side("orig", 1).unionByName(side("rewrite", -1)).groupBy("pair_id", "raw").agg(F.sum("d").alias("d")).filter("d <> 0")
    return rows.select("pair_id", F.when(F.col("d") > 0, "orig").otherwise("rewrite").alias("side"), "raw", F.abs("d").alias("extra"))


def damaged_lines(lines: DataFrame) -> DataFrame:
    """Lines with the replacement character or a conflict marker at their start."""
    return lines.filter(F.col("raw").contains("�") | F.col("raw").rlike(r"^(<{7} |={7}\z|>{7} )"))


def status_gaps(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys whose status differs, or is there on one side only."""
    a, b = expected.select(key, F.col("status").alias("expected")), actual.select(key, F.col("status").alias("actual"))
    return a.join(b, key, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def insert_row(docs: DataFrame, heading: str, name: str, summary: str) -> DataFrame:
    """docs (doc_id, text) with a row for ``name`` in the table below ``heading``, before the first row of a later name.

    A document without such a table, or whose table has the name already, stays as it is.
    """
    lines = text_lines(docs)
    title = F.when(F.col("raw").rlike(r"^#{1,6} "), strip(F.regexp_replace("raw", r"^#{1,6} ", "")))
    rows = lines.withColumn("title", F.last(title, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line")))
    own = F.when((F.col("title") == heading) & F.col("raw").startswith("|"), F.nullif(F.regexp_extract("raw", r"^\|\s*`([^`]+)`\s*\|", 1), F.lit("")))
    table = (F.col("title") == heading) & F.col("raw").startswith("|")
    place = rows.withColumn("own", own).groupBy("doc_id").agg(F.min(F.when(F.col("own") > name, F.col("line"))).alias("before"), F.max(F.when(table, F.col("line"))).alias("last"), F.bool_or(F.coalesce(F.col("own") == name, F.lit(False))).alias("there"))
    new = place.filter("last is not null and not there").select("doc_id", F.coalesce(F.col("before") - 0.5, F.col("last") + 0.5).alias("line"), F.lit(f"| `{name}` | {summary} |").alias("raw"))
    every = lines.select("doc_id", F.col("line").cast("double").alias("line"), "raw").unionByName(new)
    return every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("x")).select("doc_id", F.array_join(F.transform("x", lambda r: r["raw"]), "\n").alias("text"))


def name_problems(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (name) that are no valid names or that a file has already."""
    taken = files.select(F.col("name").alias("t_name")).distinct()
    rows = names.join(taken, F.col("name") == F.col("t_name"), "left")
    problem = F.when(~F.col("name").rlike(NAME), "not lower case letters, digits and hyphens").when(F.col("t_name").isNotNull(), "exists already")
    return rows.select("name", problem.alias("problem")).filter("problem is not null")


def id_sync(spec: DataFrame, code: DataFrame, pattern: str) -> DataFrame:
    """Ids that texts of one side (text) name and those of the other don't: two anti-joins of extracted ids."""
    ids = lambda d: d.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("name"))
    return two_way(ids(spec), ids(code))


def unresolved(threads: DataFrame, raw: str) -> DataFrame:
    """id of the entries of a JSON array that are not marked as resolved."""
    kind = "array<struct<id:string,isResolved:boolean>>"
    return threads.select(F.explode(F.from_json(raw, kind)).alias("x")).filter(~F.coalesce(F.col("x.isResolved"), F.lit(False))).select(F.col("x.id").alias("id"))
