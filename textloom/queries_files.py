"""Registered queries of files, collections, results and endings, each with its SQL.

Texts that need a shape which the tables don't have (front matter, check lists, index tables) are put together from the
columns of whole tables, row by row, and then read by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.operators import findings as fnd
from textloom.operators import report as rep
from textloom.operators import segments as seg
from textloom.plans import conform as cfm
from textloom.plans import diff as dff
from textloom.sources import texts

ENDS = ".!?"
TERMS = r"[A-Za-z]{9,}"
GENERAL = ["something", "different", "important"]


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pairs(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _table(spark, d, "conversations").withColumn("rewrite", F.lead("text").over(w)).filter("rewrite is not null")
    return rows.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("pair_id"), F.col("text").alias("orig"), "rewrite")


def decoded_pages(spark, d):
    """Bytes of pages, with a byte order mark before every third, decoded: mark, kind of line ends, length, digest."""
    html = F.col("html").cast("binary")
    marked = F.when(F.col("page_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), html)).otherwise(html)
    out = texts.decode(_table(spark, d, "pages").select("page_id", marked.alias("content")))
    return out.select("page_id", "bom", "eol", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def front_matter_rows(spark, d):
    """Front matter of documents that begin with their own columns; the last of equal keys counts."""
    rows = _table(spark, d, "documents")
    head = F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\nsource: none\nsource:  "), F.col("source"), F.lit(" \n---\n"), F.col("text"))
    got = texts.front_matter(texts.text_lines(rows.select("doc_id", head.alias("text"))))
    return got.select("doc_id", "last", F.col("entries")["lang"].alias("lang"), F.col("entries")["source"].alias("source"))


def index_rows(spark, d):
    """Rows of the table below one heading of two, by the heading that holds last."""
    rows = _table(spark, d, "documents")
    row = lambda a, b: F.concat(F.lit("| `"), a, F.lit("` | "), b, F.lit(" |\n"))
    page = F.concat(F.lit("# Other\n"), row(F.lit("no"), F.lit("no")), F.lit("## Files\n| name | note |\n|---|---|\n"), row(F.col("lang"), F.col("source")), row(F.col("source"), F.col("lang")), F.lit("# End\n| `no` | no |"))
    return texts.index_table(texts.text_lines(rows.select("doc_id", page.alias("text"))), "Files").select("doc_id", "row_no", "name", "summary")


def batch_paths(spark, d):
    """Documents that no label names: a batch without what is to be ignored."""
    path = lambda t: _table(spark, d, t).select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return texts.batch_paths(path("documents"), path("labels"))


def line_lookup(spark, d):
    """The line of the middle character of each document, by the lines' starts."""
    docs = _table(spark, d, "documents").select("doc_id", "text")
    at = docs.filter("length(text) > 0").select("doc_id", F.floor(F.length("text") / 2).cast("long").alias("pos"))
    return seg.line_at(at, texts.physical_lines(docs).select("doc_id", "line", "start")).select("doc_id", "pos", "line")


def _files(spark, d) -> DataFrame:
    """Documents as rule files and skill folders: some with front matter, heading and scope section, some without."""
    rows = _table(spark, d, "documents")
    k = F.col("doc_id") % 4
    name = F.concat(F.when(k == 3, "Bad_").otherwise("d-"), F.col("doc_id").cast("string"))
    head = F.concat(F.lit("---\nname: d-"), F.col("doc_id").cast("string"), F.lit("\ntrigger: "), F.when(k == 1, F.lit("")).otherwise(F.col("lang")), F.lit("\ndescription: "), F.when(k == 2, F.lit("")).otherwise(F.col("source")), F.lit("\n---\n# Title\n## 対象外\n"))
    text = F.when(k == 0, F.col("text")).otherwise(F.concat(head, F.col("text")))
    return rows.select(F.concat(F.lit("rules/"), F.col("doc_id").cast("string")).alias("path"), name.alias("name"), text.alias("text"))


def rule_files(spark, d):
    return cfm.rule_files(_files(spark, d).withColumn("kind", F.lit("rule"))).select("path", "message")


def skill_files(spark, d):
    return cfm.skill_files(_files(spark, d).withColumn("kind", F.lit("skill")), limit=20).select("path", "message")


def plan_status(spark, d):
    """Check lists made of labels: no status line, or running with every item checked."""
    box = lambda c: F.when(F.col(c) == 1, "- [x] ").otherwise("- [ ] ")
    status = F.when(F.col("doc_id") % 3 == 0, "no status").when(F.col("doc_id") % 3 == 1, "状態: 進行中").otherwise("状態: 完了")
    text = F.concat_ws("\n", status, F.concat(box("quality"), F.lit("quality")), F.concat(box("toxic"), F.lit("toxic")))
    return cfm.plan_status(texts.text_lines(_table(spark, d, "labels").select("doc_id", text.alias("text"))))


def structural_changes(spark, d):
    """Parts with a returned line, read as deletions, among their changes."""
    changes = _table(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") == "R", "D").otherwise("M").alias("status"))
    return cfm.structural(changes, "l_partkey")


def id_sync(spark, d):
    """Long words that only the benchmark or only the documents use."""
    return cfm.id_sync(_table(spark, d, "benchmark").select("text"), _table(spark, d, "documents").select("text"), r"[a-z]{11,}")


def name_problems(spark, d):
    names = _table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 5 == 0, "No_").otherwise("n-"), F.col("doc_id").cast("string")).alias("name"))
    return cfm.name_problems(names, _table(spark, d, "labels").select(F.concat(F.lit("n-"), F.col("doc_id").cast("string")).alias("name")))


def inserted_rows(spark, d):
    """Index tables with a row put in before the first later name, and not twice."""
    rows = _table(spark, d, "documents")
    text = F.concat(F.lit("# Files\n| `aa` | x |\n| `"), F.col("lang"), F.lit("` | y |\n| `zz` | z |"))
    return cfm.insert_row(rows.select("doc_id", text.alias("text")), "Files", "es", "new").select("doc_id", "text")


def json_fields(spark, d):
    """Names out of a JSON array of objects, one row each."""
    rows = _table(spark, d, "documents").select("doc_id", F.to_json(F.array(F.struct(F.col("lang").alias("name"), F.col("n_chars").alias("size")), F.struct(F.col("source").alias("name"), F.lit(None).cast("long").alias("size")))).alias("raw"))
    return rep.records(rows, "raw", "name:string,size:long")


def digests(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def overlapping_matches(spark, d):
    """Every place where two vowels stand one letter apart, places that overlap included."""
    found = rep.overlapping(F.col("text"), "[aeiou][a-z][aeiou]")
    return _table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("found_md5"))


def technical_documents(spark, d):
    """Documents with at least 12 different long words that aren't general ones."""
    rows = _table(spark, d, "documents").select("doc_id", F.array_sort(rep.technical_terms(F.col("text"), TERMS, GENERAL)).alias("terms"))
    return rows.filter(F.size("terms") >= 12).select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def _findings(spark, d) -> DataFrame:
    """Lines with listed words, as findings."""
    lines = texts.text_lines(_table(spark, d, "documents").select("doc_id", "text"))
    hits = fnd.lexicon_hits(lines, ["stupid", "idiot", "hate", "kill", "trash", "moron", "entire", "from"])
    rule = F.when(F.array_contains("words", "from"), "common").otherwise("harsh")
    return hits.select("doc_id", "line", rule.alias("rule"), F.when(rule == "common", "info").otherwise("warn").alias("severity"), "words", strip("raw").alias("snippet"))


def ordered_findings(spark, d):
    rows = rep.ordered(_findings(spark, d), "rule")
    return rows.select("doc_id", "seq", "line", "rule")


def phrase_labels(spark, d):
    """The first two listed words of a line in marks, and how many there are besides."""
    return _findings(spark, d).select("doc_id", "line", rep.phrases(F.col("words"), 2, "<", ">", " and %s more").alias("label"))


def finding_json(spark, d):
    rows = rep.ordered(_findings(spark, d), "rule")
    return rep.json_rows(rows, "line", "rule", "severity")


def finding_reports(spark, d):
    """Readable reports of all documents, as digests."""
    found = rep.ordered(_findings(spark, d), "rule").withColumn("message", F.array_join("words", ", "))
    out = rep.report(found, fnd.severity_counts(found, _table(spark, d, "documents")))
    return out.select("doc_id", F.length("report").alias("n_chars"), F.md5("report").alias("report_md5"))


def severity_counts(spark, d):
    return fnd.severity_counts(_findings(spark, d), _table(spark, d, "documents"))


def turn_moved_sentences(spark, d):
    """Sentences of a turn that come again in the next one, sentences named by their last word."""
    last = F.regexp_extract("sentence", r"([A-Za-z]+)[.!?]?\z", 1)
    return dff.moved_sentences(dff.side_sentences(_pairs(spark, d), ENDS).withColumn("sentence", last))


def _marks(spark, d) -> DataFrame:
    return dff.logic_points(dff.side_sentences(_pairs(spark, d), ENDS), {"opening": r"^(The|And|Is) ", "asking": r"\?\z", "long": r".{60}"})


def turn_kinds_changed(spark, d):
    """Kinds of sentences that a turn or the one after it has alone."""
    return dff.kinds_changed(_marks(spark, d))


def turn_comma_sentences(spark, d):
    out = dff.comma_sentences(dff.side_sentences(_pairs(spark, d), ENDS), " ", 5, 2)
    return out.select("pair_id", "seq", "commas", F.length("sentence").alias("n_chars"))


def ending_units(spark, d):
    """Units of whole documents by their last letter, list rows and table cells apart, dashes as ends."""
    rows = _table(spark, d, "documents").select("doc_id", "text")
    got = dff.ending_units(rows, lambda s: F.regexp_extract(s, r"([a-z]?)[.!?]?\z", 1), ends=ENDS)
    return got.groupBy("doc_id", "where", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("n_whole"))


#: doc_id, text, rule that is found in it (none: the text is a near miss)
RULES_JP = [
    (1, "まとめると、三点ある。", "summary_restatement"), (2, "本記事では手順を示す。", "meta_intro"), (3, "理由は3つあります。", "count_declaration"), (4, "もちろん、例外もある。", "short_mochiron"),
    (5, "もちろん、できます。", None), (6, "速い。\n軽い。\n安い。\n使える。", "fragment_run"), (7, "使い心地は抜群です。", "thin_evaluation"), (8, "まずは小さく始めましょう。", "meta_filler"), (9, "まずは小さく切る。", None),
    (10, "今日——正確には昨日——連絡した。", "dash_insertion"), (11, "―― 出典：白書", None), (12, "―― 夏目漱石『こころ』", None), (13, "— John Smith, The Book", None), (14, "― SOURCE: report", None), (15, "雨、風、雪──", "dash_list_ending"),
    (16, "今日は晴れた。明日は雨だ。", "one_sentence_per_line"), (17, "景気は回復するという見立てです。", "ai_phrase"), (18, "日銀は回復するという見立てです。", None), (19, "設計に潜むリスクを探す。", "ai_phrase"), (20, "油断が招く事故を防ぐ。", "ai_phrase"),
    (21, "先生が招く客を待つ。", None), (22, "今や欠かせない存在だ。", "ai_phrase"), (23, "画面を開いて、担当者を確認。", "ai_phrase"), (24, "規則について、内容を確認。", None),
]


def jp_forms_golden(spark, d):
    """Golden: one text for each further rule, and near misses that no rule finds."""
    from textloom.plans.lint import lint

    found = lint(spark.createDataFrame([r[:2] for r in RULES_JP], "doc_id long, text string"))[0]
    return found.filter(F.col("rule").isin(*{r for _, _, r in RULES_JP if r})).select("doc_id", "rule").distinct()


def bold_findings(spark, d):
    """Bold marks of the documents that may be shown as they stand; rows only, since pairing marks is sequential."""
    from textloom.operators.bold import bold_marks

    return bold_marks(_table(spark, d, "documents"))


def turn_bold_changes(spark, d):
    """Bold problems that the next turn adds, with the marks of turns put around each first word; rows only."""
    from textloom.operators.bold import bold_changes

    mark = lambda c, a, b: F.regexp_replace(c, r"(\w+)", f"{a}$1{b}").alias(c)
    return bold_changes(_pairs(spark, d).select("pair_id", mark("orig", "**", "**"), mark("rewrite", "**(", ")**")))


#: text, and what is to be done about its bold marks (none: they are fine)
BOLD_JP = [
    (1, "これが**『題』**の話です。", "かっこの内側だけを太字にする"), (2, "**題**の話です。", None), (3, "話は**必ず読む。**次へ進みます。", "句読点を太字の外に出す"), (4, "道は**「右」と「左」**に分かれます。", "文字に接する側に半角スペースを入れる"),
    (5, "次は**大事 **です", "太字の内側の空白を取る"), (6, "`**「語」**を`", None), (7, "**前の段落\n\n後の段落**", None), (8, "```\n語**「語」**語\n```", None), (9, "\\*\\*語\\*\\*", None), (10, "- **一つ目\n- 二つ目**", None),
    (11, "一行目\n二行目は**「ここから\nここまで」**と続く。", "かっこの内側だけを太字にする"),
]


def jp_bold_golden(spark, d):
    """Golden: what is to be done about the bold marks of short texts."""
    from textloom.operators.bold import bold_marks

    return bold_marks(spark.createDataFrame([r[:2] for r in BOLD_JP], "doc_id long, text string")).select("doc_id", "how")


ENDINGS_JP = [
    (1, None, "設定を確認します。\n次に保存してください。"), (2, "勧め", "私が確認します。"), (3, "決まり", "早めに始めましょう。\nこれが重要です。"),
    (4, "説明", "読みましょう。\n結果は良かったです。"), (5, "説明", "結果は良かったです。\n読みましょう。"), (6, None, "雨です。\n風です。\n波が立つ。"), (7, None, "雨が降る。\n風が吹く。\n波です。"),
    (8, None, "```\n書きましょう。\n```\n| 確認します。 | 値 |\n- 保存します。"),
]


def jp_stance_golden(spark, d):
    """Golden: flags of the stance of short texts."""
    rows = spark.createDataFrame(ENDINGS_JP, "doc_id long, stance string, text string")
    out = []
    for stance in (None, "勧め", "決まり", "説明"):
        mine = rows.filter(F.col("stance").eqNullSafe(stance)).drop("stance")
        out.append(dff.stance_flags(dff.ending_units(mine, markdown=True), stance))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("doc_id", "flag", F.size("sentences").cast("long").alias("n"))


_DOC_LINES = "l AS (SELECT doc_id, generate_subscripts(x, 1)::INT AS line, unnest(x) AS raw FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS x FROM documents))"
_WORDS = rf"""{_DOC_LINES}, h AS (SELECT doc_id, line, raw, regexp_extract_all(raw, 'entire|stupid|idiot|moron|trash|from|hate|kill') AS found FROM l),
f AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13)) AS snippet, list_transform(list_sort(list_transform(list_distinct(found), lambda x: (list_position(found, x), x))), lambda t: t[2]) AS words,
  CASE WHEN list_contains(found, 'from') THEN 'common' ELSE 'harsh' END AS rule, CASE WHEN list_contains(found, 'from') THEN 'info' ELSE 'warn' END AS severity FROM h WHERE len(found) > 0)"""
_TURNS = """p AS (SELECT conv_id * 1000000 + turn AS pair_id, text AS orig, nxt AS rewrite FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)"""


def oracle(sides: str) -> dict[str, str]:
    """SQL by query; ``sides`` is the text of the CTEs up to ss(pair_id, side, seq, sentence)."""
    marks = rf"""WITH {sides}, k AS (SELECT pair_id, side, 'opening' AS kind FROM ss WHERE regexp_matches(sentence, '^(The|And|Is) ')
UNION ALL SELECT pair_id, side, 'asking' FROM ss WHERE regexp_matches(sentence, '\?$') UNION ALL SELECT pair_id, side, 'long' FROM ss WHERE regexp_matches(sentence, '.{{60}}'))"""
    return {
        "decoded_pages": r"""SELECT page_id, page_id % 3 = 0 AS bom, CASE WHEN a::INT + b::INT + c::INT > 1 THEN 'mixed' WHEN a THEN 'crlf' WHEN b THEN 'cr' WHEN c THEN 'lf' ELSE 'none' END AS eol,
  length(t) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT page_id, contains(html, chr(13) || chr(10)) AS a, contains(replace(html, chr(13) || chr(10), ''), chr(13)) AS b,
  contains(replace(html, chr(13) || chr(10), ''), chr(10)) AS c, replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM pages)""",
        "front_matter_rows": "SELECT doc_id, 5 AS last, lang, source FROM documents",
        "index_rows": "SELECT doc_id, 1 AS row_no, lang AS name, source AS summary FROM documents UNION ALL SELECT doc_id, 2, source, lang FROM documents",
        "batch_paths": "SELECT 'docs/' || doc_id || '.md' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "line_lookup": "SELECT doc_id, length(text) // 2 AS pos, len(regexp_extract_all(substr(text, 1, (length(text) // 2)::BIGINT), chr(10)))::INT + 1 AS line FROM documents WHERE length(text) > 0",
        "rule_files": r"""WITH f AS (SELECT doc_id, doc_id % 4 AS k, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n, text FROM documents),
x AS (SELECT doc_id, k, CASE WHEN k = 0 THEN n ELSE n + 7 END AS n FROM f)
SELECT 'rules/' || doc_id AS path, unnest(list_filter([CASE WHEN k = 3 THEN 'name is not lower case letters, digits and hyphens' END, CASE WHEN k = 0 THEN 'no front matter' END, CASE WHEN k = 1 THEN 'no trigger' END,
  CASE WHEN k = 2 THEN 'no description' END, CASE WHEN n > 30 THEN 'too many lines' END, CASE WHEN k = 0 THEN 'no heading' END, CASE WHEN k = 0 THEN 'no scope section' END], lambda x: x IS NOT NULL)) AS message FROM x""",
        "skill_files": r"""WITH f AS (SELECT doc_id, doc_id % 4 AS k, len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) OR text = '' THEN 1 ELSE 0 END AS n FROM documents)
SELECT 'rules/' || doc_id AS path, unnest(list_filter([CASE WHEN k = 3 THEN 'name is not lower case letters, digits and hyphens' END, CASE WHEN k = 0 THEN 'no front matter' END,
  CASE WHEN k = 3 THEN 'name differs from the folder' END, CASE WHEN k = 2 THEN 'no description' END, CASE WHEN CASE WHEN k = 0 THEN n ELSE n + 7 END > 20 THEN 'too many lines' END], lambda x: x IS NOT NULL)) AS message FROM f""",
        "plan_status": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no status line' ELSE 'all items checked but still running' END AS problem FROM labels WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND quality = 1 AND toxic = 1)",
        "structural_changes": "SELECT l_partkey, bool_or(l_returnflag = 'R') AS structural FROM lineitem GROUP BY l_partkey",
        "id_sync": r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{11,}')) AS name FROM benchmark), b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{11,}')) AS name FROM documents)
SELECT name, 'unlisted' AS problem FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'orphan' FROM b WHERE name NOT IN (SELECT name FROM a)""",
        "name_problems": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'No_' ELSE 'n-' END || doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'not lower case letters, digits and hyphens' ELSE 'exists already' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id IN (SELECT doc_id FROM labels)",
        "inserted_rows": r"""SELECT doc_id, '# Files' || chr(10) || '| `aa` | x |' || chr(10) || CASE WHEN lang > 'es' THEN '| `es` | new |' || chr(10) ELSE '' END || '| `' || lang || '` | y |' || chr(10)
  || CASE WHEN lang < 'es' THEN '| `es` | new |' || chr(10) ELSE '' END || '| `zz` | z |' AS text FROM documents""",
        "json_fields": "SELECT doc_id, lang AS name, n_chars AS size FROM documents UNION ALL SELECT doc_id, source, NULL FROM documents",
        "digests": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
        "overlapping_matches": """WITH x AS (SELECT doc_id, list_filter(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)), lambda w: regexp_full_match(w, '[aeiou][a-z][aeiou]')) AS f FROM documents)
SELECT doc_id, len(f) AS n, md5(array_to_string(f, ' ')) AS found_md5 FROM x""",
        "technical_documents": f"""WITH x AS (SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(text, '{TERMS}')), lambda w: w NOT IN ('something', 'different', 'important'))) AS t FROM documents)
SELECT doc_id, len(t) AS n_terms, array_to_string(t, ' ') AS terms FROM x WHERE len(t) >= 12""",
        "ordered_findings": f"WITH {_WORDS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, rule)::INT AS seq, line, rule FROM f",
        "phrase_labels": f"WITH {_WORDS} SELECT doc_id, line, array_to_string(list_transform(words[1:2], lambda w: '<' || w || '>'), '') || CASE WHEN len(words) > 2 THEN ' and ' || (len(words) - 2) || ' more' ELSE '' END AS label FROM f",
        "finding_json": f"""WITH {_WORDS} SELECT doc_id, '[' || string_agg('{{"line":' || line || ',"rule":"' || rule || '","severity":"' || severity || '"}}', ',' ORDER BY line) || ']' AS findings FROM f GROUP BY doc_id""",
        "finding_reports": f"""WITH {_WORDS}, r AS (SELECT doc_id, '内訳: error 0件、warn ' || count(*) FILTER (WHERE severity = 'warn') || '件、info ' || count(*) FILTER (WHERE severity = 'info') || '件' || chr(10) || chr(10)
  || string_agg('L' || line || ' [' || upper(severity) || '] ' || rule || ': ' || array_to_string(words, ', ') || chr(10) || '  > ' || snippet, chr(10) || chr(10) ORDER BY line) AS t FROM f GROUP BY doc_id)
SELECT doc_id, length(coalesce(t, '')) AS n_chars, md5(coalesce(t, '')) AS report_md5 FROM documents LEFT JOIN r USING (doc_id)""",
        "severity_counts": f"""WITH {_WORDS}, c AS (SELECT doc_id, count(*) FILTER (WHERE severity = 'warn') AS w, count(*) FILTER (WHERE severity = 'info') AS i FROM f GROUP BY doc_id)
SELECT doc_id, 0 AS error, coalesce(w, 0) AS warn, coalesce(i, 0) AS info, coalesce(w + i, 0) AS n_findings FROM documents LEFT JOIN c USING (doc_id)""",
        "turn_moved_sentences": f"""WITH {sides}, w AS (SELECT pair_id, side, seq, regexp_extract(sentence, '([A-Za-z]+)[.!?]?$', 1) AS sentence FROM ss), n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, sentence ORDER BY seq) AS nth FROM w)
SELECT a.pair_id, a.sentence, a.seq AS orig_seq, b.seq AS rewrite_seq FROM n a JOIN n b ON a.pair_id = b.pair_id AND a.sentence = b.sentence AND a.nth = b.nth AND a.side = 'orig' AND b.side = 'rewrite'""",
        "turn_kinds_changed": f"""{marks}, g AS (SELECT pair_id, list_sort(list_distinct(coalesce(list(kind) FILTER (WHERE side = 'orig'), []))) AS o, list_sort(list_distinct(coalesce(list(kind) FILTER (WHERE side = 'rewrite'), []))) AS r FROM k GROUP BY pair_id),
x AS (SELECT pair_id, list_filter(o, lambda y: NOT list_contains(r, y)) AS lost, list_filter(r, lambda y: NOT list_contains(o, y)) AS added FROM g) SELECT * FROM x WHERE len(lost) > 0 OR len(added) > 0""",
        "turn_comma_sentences": rf"""WITH {sides}, n AS (SELECT *, len(regexp_extract_all(sentence, ' ')) AS commas FROM ss WHERE side = 'rewrite'), m AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY seq) AS place FROM n WHERE commas >= 5)
SELECT pair_id, seq, commas, length(sentence) AS n_chars FROM m WHERE place <= 2""",
        "ending_units": rf"""WITH {_DOC_LINES}, t AS (SELECT doc_id, trim(raw, ' ' || chr(9) || chr(13)) AS t FROM l), b AS (SELECT doc_id, t, regexp_matches(t, '^(?:[*\-・]|[0-9]+[.)])\s+') AS listed FROM t WHERE t <> '' AND NOT starts_with(t, '#') AND t <> '---' AND NOT starts_with(t, '|')),
s AS (SELECT doc_id, listed, unnest(list_filter(list_transform(regexp_extract_all(regexp_replace(t, '^(?:[*\-・]|[0-9]+[.)])\s+', ''), '[^.!?]*[.!?]|[^.!?]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')) AS s FROM b),
p AS (SELECT doc_id, listed, regexp_matches(s, '[.!?]$') AS stopped, string_split_regex(s, '[—―]{{1,2}}') AS parts FROM s), u AS (SELECT doc_id, listed, stopped, len(parts) AS m, generate_subscripts(parts, 1) AS i, unnest(parts) AS x FROM p),
k AS (SELECT doc_id, listed, stopped OR i < m AS whole, trim(x, ' ' || chr(9)) AS x, regexp_extract(trim(x, ' ' || chr(9)), '([a-z]?)[.!?]?$', 1) AS kind FROM u)
SELECT doc_id, CASE WHEN listed THEN '箇条書き' ELSE '地の文' END AS "where", kind, count(*) AS n, count(*) FILTER (WHERE whole) AS n_whole FROM k WHERE x <> '' AND kind <> '' GROUP BY ALL""",
        "jp_bold_golden": f"SELECT * FROM (VALUES {', '.join(f"({i}, '{h}')" for i, _, h in BOLD_JP if h)}) t(doc_id, how)",
        "jp_forms_golden": f"SELECT * FROM (VALUES {', '.join(f"({i}, '{r}')" for i, _, r in RULES_JP if r)}) t(doc_id, rule)",
        "jp_stance_golden": "SELECT * FROM (VALUES (1, 'act_and_ask', 2), (2, 'act_in_advice', 1), (3, 'advice_in_rules', 2), (4, 'advice_in_report', 1), (6, 'plain_in_polite', 1), (7, 'polite_in_plain', 1)) t(doc_id, flag, n)",
    }


QUERIES = {f.__name__: f for f in (
    decoded_pages, front_matter_rows, index_rows, batch_paths, line_lookup, rule_files, skill_files, plan_status, structural_changes, id_sync, name_problems, inserted_rows, json_fields, digests,
    overlapping_matches, technical_documents, ordered_findings, phrase_labels, finding_json, finding_reports, severity_counts, turn_moved_sentences, turn_kinds_changed, turn_comma_sentences, ending_units, jp_stance_golden, jp_forms_golden, jp_bold_golden, bold_findings, turn_bold_changes,
)}
