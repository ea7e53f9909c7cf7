"""Registered queries over the driver's tables, each with its SQL.

The tables hold no Japanese and almost no Markdown, so these queries run the operators with terminators, words and
patterns that occur there; the Japanese rules themselves are held against fixtures in tests/.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import queries_files as more
from textloom.functions.text import around, strip
from textloom.operators import findings as fnd
from textloom.operators import segments as seg
from textloom.operators import spans as spn
from textloom.plans import conform as cfm
from textloom.plans import diff as dff
from textloom.sources import texts

ENDS = ".!?"
WORDS = ["stupid", "idiot", "hate", "kill", "trash", "moron", "entire", "from"]
ALLOWED = ["from", "entire"]
MARKERS = {"the": r"\bthe\b", "question": r"\?", "and": r"\band\b", "stop": r"\."}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return texts.text_lines(_docs(spark, d).select("doc_id", "text"))


def line_scan(spark, d):
    return texts.physical_lines(_docs(spark, d).select("doc_id", "text"))


def doc_metrics(spark, d):
    return fnd.text_metrics(_docs(spark, d))


def metric_rules(spark, d):
    return fnd.metric_rules(fnd.text_metrics(_docs(spark, d)))


def _sentences(spark, d):
    return seg.sentence_records(_lines(spark, d), ends=ENDS)


def _last_letter():
    return F.nullif(F.regexp_extract("sentence", r"([a-z])[.!?]\z", 1), F.lit(""))


def line_metrics(spark, d):
    """The metrics from a relation of lines, as the lint plan has them."""
    return fnd.doc_metrics(_lines(spark, d))


def sentence_records(spark, d):
    return _sentences(spark, d).select("doc_id", "line", "seq", "sentence")


def ending_runs(spark, d):
    return seg.ending_runs(_sentences(spark, d), _last_letter(), ["doc_id", "line"]).select("doc_id", "line", "seq", "kind")


def penalty_score(spark, d):
    """Metric rules and runs of sentence endings as findings; counts and score of every document."""
    metrics = fnd.text_metrics(_docs(spark, d))
    runs = ending_runs(spark, d).select("doc_id", F.lit("sentence_end_repetition").alias("rule"), "line", F.lit("warn").alias("severity"))
    return fnd.gate(fnd.scores(fnd.metric_rules(metrics).unionByName(runs), metrics), fail_on="warn")


def repeated_lines(spark, d):
    return seg.repeated_lines(_lines(spark, d))


def next_sentence_context(spark, d):
    rows = seg.with_neighbours(_sentences(spark, d), ["doc_id", "line"])
    return rows.select("doc_id", "line", "seq", F.length("before").alias("n_before"), F.length("after").alias("n_after"))


def sentence_neighbours(spark, d):
    """Sentences of every third block of three lines, with the next of the block and the whole one before."""
    block = F.floor((F.col("line") - 1) / 3)
    kind = F.when(block % 3 == 0, "paragraph").when(block % 3 == 2, "heading").otherwise("table")
    rows = _lines(spark, d).filter(strip("raw") != "").withColumns({"block": block, "kind": kind})
    got = seg.sentences_in_context(rows, "raw", ENDS, ("paragraph", "table"), ("paragraph", "heading"))
    return got.select("doc_id", "line", "pos", "following", "previous")


def matches_over_lines(spark, d):
    """Lines where a full stop meets a capital once lines without figures are joined, within blocks of 20 lines."""
    rows = _lines(spark, d).filter(strip("raw") != "").withColumns({"block": F.floor((F.col("line") - 1) / 20), "t": F.col("raw")})
    parts = seg.joined_parts(rows, ["doc_id", "block"], "t", F.col("raw").rlike("[0-9]"))
    return seg.lines_of_matches(parts, ["doc_id", "block"], r"[a-z]\.[A-Z]").select("doc_id", "block", "line")


def allowed_by_rule(spark, d):
    """Word findings less the allowed words: one rule loses words, one goes as a whole, the third is left alone."""
    rows = _word_findings(spark, d).withColumn("label", F.concat(F.lit("「"), F.get("words", F.lit(0)), F.lit("」")))
    got = fnd.allow_by_rule(rows, ["from", "hate", "stupid"], ["common", "harsh"], ["common"])
    return got.select("doc_id", "line", "rule", "words")


def lexicon_hits(spark, d):
    return fnd.lexicon_hits(_lines(spark, d), WORDS).select("doc_id", "line", "words")


def _word_findings(spark, d):
    hits = fnd.lexicon_hits(_lines(spark, d), WORDS)
    return hits.withColumn("rule", F.when(F.array_contains("words", "from"), "common").when(F.array_contains("words", "entire"), "uncommon").otherwise("harsh"))


def lexicon_allowed(spark, d):
    return fnd.allow(_word_findings(spark, d), ALLOWED).select("doc_id", "line", "rule", "words")


def allow_removed_counts(spark, d):
    return fnd.removed_by_allow(_word_findings(spark, d), ALLOWED, ["common", "uncommon", "harsh"])


def capped_hits(spark, d):
    return fnd.capped(_word_findings(spark, d)).select("doc_id", "line", "nth", "n_all")


def hit_density(spark, d):
    return fnd.dense(_word_findings(spark, d))


def multi_sentence_lines(spark, d):
    return seg.multi_sentence_lines(_lines(spark, d), ends=ENDS, closers=")").select("doc_id", "line")


def paragraphs(spark, d):
    return seg.paragraphs(_lines(spark, d)).select("doc_id", "paragraph", "first_line", "n_lines", F.length("body").alias("n_chars"))


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def bare_url_spans(spark, d):
    return spn.trim_urls(spn.find_spans(_pages(spark, d), "text", spn.URL, "bare_url"))


def html_tokens(spark, d):
    return spn.find_spans(_pages(spark, d), "text", spn.TAG, "html_token").select("doc_id", "s", "e", "kind")


def _all_spans(spark, d):
    return bare_url_spans(spark, d).unionByName(spn.find_spans(_pages(spark, d), "text", spn.TAG, "html_token")).select("doc_id", "s", "e")


def merged_masks(spark, d):
    return spn.merge_spans(_all_spans(spark, d))


def masked_text(spark, d):
    """Text outside tags: as long as the page, blanks where a span was."""
    return spn.blanked(_pages(spark, d), _all_spans(spark, d)).select("doc_id", F.md5("visible").alias("visible_md5"), F.length("visible").alias("n_chars"))


def urls_near_tags(spark, d):
    """Addresses with a tag within 40 characters after them: the interval semi-join."""
    urls = bare_url_spans(spark, d).select("doc_id", F.col("s").alias("lo"), (F.col("e") + 40).alias("hi"))
    return spn.overlapping(urls, spn.find_spans(_pages(spark, d), "text", spn.TAG, "html_token"))


def _pairs(spark, d):
    """Neighbouring turns of conversations as (orig, rewrite)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = spark.read.parquet(f"{d}/conversations.parquet").withColumn("rewrite", F.lead("text").over(w)).filter("rewrite is not null")
    return rows.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("pair_id"), F.col("text").alias("orig"), "rewrite")


def turn_diff_words(spark, d):
    return dff.word_changes(_pairs(spark, d), "[A-Za-z]{4,}")


def turn_marker_delta(spark, d):
    return dff.marker_changes(_pairs(spark, d), MARKERS)


def turn_structure(spark, d):
    return dff.structure(_pairs(spark, d), ENDS)


def turn_comma_rates(spark, d):
    return dff.comma_rates(_pairs(spark, d), ",", ENDS, more=1, tenths=1)


def turn_ending_counts(spark, d):
    return dff.ending_counts(dff.side_sentences(_pairs(spark, d), ENDS), F.regexp_extract("sentence", r"([a-z]?)[.!?]?\z", 1))


def turn_logic_points(spark, d):
    return dff.logic_points(dff.side_sentences(_pairs(spark, d), ENDS), {"opening": r"^(The|And|Is) ", "announcing": r" (the|this) [a-z]+[.]\z"})


def turn_line_multisets(spark, d):
    return cfm.line_multisets(_pairs(spark, d))


def turn_heading_shapes(spark, d):
    """Headings of neighbouring turns, taking a turn's first sentence of each line as a heading.  Rows only: the pairing is greedy."""
    mark = lambda c: F.array_join(F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit("# "), F.substring_index(x, ".", 1))), "\n").alias(c)
    return dff.heading_shapes(dff.headings(_pairs(spark, d).select("pair_id", mark("orig"), mark("rewrite"))))


def turn_opcodes(spark, d):
    """Character alignment; rows only, since SQL has no difflib."""
    return dff.opcodes(_pairs(spark, d))


def turn_ending_changes(spark, d):
    return dff.ending_changes(dff.side_sentences(_pairs(spark, d), ENDS), F.regexp_extract("sentence", r"([a-z]?)[.!?]?\z", 1))


def bigram_pairing(spark, d):
    """For each benchmark item the most similar document, both as whole texts and all pairs compared, in an Arrow stage."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return dff.best_texts(items, _docs(spark, d).select(F.col("doc_id").alias("id"), "text"), 0.2)


def label_sync(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("name"))
    return cfm.two_way(docs, spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("name")))


def props_contract(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "props")
    return cfm.json_contract(rows, "props", {"k": "number", "missing": "string"}, {"v": "array"}).select("event_id", "problems")


def size_limits(spark, d):
    """Documents with more than 12 lines or 4,000 characters."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("path"), F.size(F.split("text", "\n")).alias("n"), F.length("text").alias("c"))
    return cfm._violations(rows, "size", {"too many lines": F.col("n") > 12, "too many characters": F.col("c") > 4000})


def status_counts(spark, d):
    return cfm.totals(size_limits(spark, d).select(F.col("message").alias("check")), ["too many lines", "too many characters", "no text"])


def status_gaps(spark, d):
    """Documents whose quality label isn't what their language would let expect."""
    want = _docs(spark, d).select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("status"))
    return cfm.status_gaps(want, spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("status")), "doc_id")


VERSIONS = [(1, "1.2.3", "1.2.4", False), (2, "1.2.3", "1.3.0", True), (3, "1.2.3", "1.2.9", True), (4, "1.2.3", "1.2.3", False), (5, "1.10.0", "1.9.9", False), (6, "1.x", "2.0.0", False), (7, "0.9.9", "1.0.0", True)]


def semver_check(spark, d):
    rows = spark.createDataFrame(VERSIONS, "id int, base string, head string, structural boolean")
    return cfm.version_checks(rows).select("id", "verdict", "planned")


def section_sizes(spark, d):
    """Lines of a document after each line that holds a bar or a double mark, as sections of more than 1 line."""
    head = F.when(F.col("raw").rlike(r"\||!!"), F.concat(F.lit("## "), F.substring("raw", 1, 20))).otherwise(F.col("raw"))
    return cfm.section_sizes(_lines(spark, d).withColumn("raw", head), limit=1).select("doc_id", "section", "body_lines")


def context_snippets(spark, d):
    """18 characters on both sides of the first listed word of a document."""
    docs = _docs(spark, d).select("doc_id", "text")
    hits = spn.find_spans(docs, "text", r"\b(?:stupid|idiot|hate|moron|trash)\b", "word")
    first = hits.groupBy("doc_id").agg(F.min(F.struct("s", "e")).alias("x"))
    return docs.join(first, "doc_id").select("doc_id", around(F.col("text"), F.col("x.s").cast("int"), F.col("x.e").cast("int")).alias("snippet"))


def lint_envelope(spark, d):
    """The whole lint plan over the documents: parse, all rules, counts, score.  No SQL: the parse is sequential."""
    from textloom.plans.lint import envelope

    return envelope(_docs(spark, d).select("doc_id", "text"))


JP = [
    (1, "重要なのは、速さだ。"), (2, "量ではなく質を選ぶ。"), (3, "等身大の言葉で書く。"), (4, "仕様が壊れる。"), (5, "作成・推敲を行う。"), (6, "完了🎉しました。"), (7, "## まとめ"), (8, "次のとおり："),
    (9, "新しいソリューションを示す。"), (10, "結果の確かめを行う。"), (11, "読む、書く、直す。"), (12, "速い。"),
]


def jp_rules_golden(spark, d):
    """Golden: hand-written expectations for the Japanese rules, since the tables hold no Japanese."""
    from textloom.plans.lint import lint

    return lint(spark.createDataFrame(JP, "doc_id long, text string"))[0].select("doc_id", "rule", "line", "severity")


JP_PAIRS = [(1, "大切です。必ず確認してください。", "確認します。"), (2, "速度を測定する。", "速度を計測する。性能も見る。"), (3, "同じ文です。", "同じ文です。")]


def jp_diff_golden(spark, d):
    """Golden: marker counts that change between two Japanese texts."""
    pairs = spark.createDataFrame(JP_PAIRS, "pair_id long, orig string, rewrite string")
    return dff.marker_changes(pairs, {"依頼": "(?:て|で)ください", "評価": "大切|重要|大事|不可欠|欠かせ|肝心|肝要", "念押し": "のです|んです|こそ|まさに|必ず|絶対|常に"})


def jp_words_golden(spark, d):
    """Golden: content words that one side lacks."""
    return dff.word_changes(spark.createDataFrame(JP_PAIRS, "pair_id long, orig string, rewrite string"))


_L = r"""raw_lines AS (
  SELECT doc_id, generate_subscripts(l, 1)::INT AS line, unnest(l) AS raw FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents)
)"""
_FULL = r"regexp_matches(raw, '[^\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')"
_METRICS = rf"""{_L}, m AS (
  SELECT doc_id, sum(CASE WHEN {_FULL} THEN length(regexp_replace(raw, '\s+', '', 'g')) ELSE 0 END)::BIGINT AS char_count,
    count(*) FILTER (WHERE {_FULL}) AS total_lines,
    count(*) FILTER (WHERE {_FULL} AND regexp_matches(raw, '^\s*([-*+]|[0-9]+\.)\s+') AND NOT regexp_matches(raw, '[-*+]\s+\[.*?\]\(https?://')) AS list_lines,
    len(regexp_extract_all(coalesce(string_agg(CASE WHEN {_FULL} THEN raw END, chr(10) ORDER BY line), ''), '\*\*[^*]+\*\*'))::BIGINT AS bold_count
  FROM raw_lines GROUP BY doc_id
)"""
_RULES = r"""mr AS (
  SELECT doc_id, 'excess_bold' AS rule, 1 AS line, 'info' AS severity FROM m WHERE char_count > 300 AND bold_count * 1000.0::DOUBLE / char_count > 3.0
  UNION ALL SELECT doc_id, 'excess_list', 1, 'info' FROM m WHERE char_count > 300 AND list_lines * 1.0::DOUBLE / total_lines > 0.25
)"""
_S = rf"""{_L}, cut AS (
  SELECT doc_id, line, generate_subscripts(p, 1) AS pos, unnest(p) AS sentence FROM (
    SELECT doc_id, line, list_filter(list_transform(regexp_extract_all(raw, '[^.!?]*[.!?]|[^.!?]+'), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS p FROM raw_lines)
), s AS (SELECT doc_id, line, pos::INT AS seq, sentence FROM cut WHERE length(sentence) >= 4)"""
_RUNS = rf"""{_S}, k AS (SELECT *, nullif(regexp_extract(sentence, '([a-z])[.!?]$', 1), '') AS kind FROM s),
f AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id, line ORDER BY seq) THEN 0 ELSE 1 END AS new FROM k),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, line ORDER BY seq) AS island FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, island ORDER BY seq) AS nth FROM g),
runs AS (SELECT doc_id, line, seq, kind FROM n WHERE kind IS NOT NULL AND nth = 3)"""
_HITS = rf"""{_L}, h AS (
  SELECT doc_id, line, regexp_extract_all(raw, 'entire|stupid|idiot|moron|trash|from|hate|kill') AS found FROM raw_lines
), w AS (
  SELECT doc_id, line, list_transform(list_sort(list_transform(list_distinct(found), lambda x: (list_position(found, x), x))), lambda t: t[2]) AS words FROM h WHERE len(found) > 0
), f AS (
  SELECT *, CASE WHEN list_contains(words, 'from') THEN 'common' WHEN list_contains(words, 'entire') THEN 'uncommon' ELSE 'harsh' END AS rule,
    list_filter(words, lambda x: x NOT IN ('from', 'entire')) AS rest FROM w
)"""


def _positions(pattern: str, name: str) -> str:
    return rf"""{name} AS (
  SELECT doc_id, n, h, sum(g + length(h)) OVER (PARTITION BY doc_id ORDER BY n) AS e FROM (
    SELECT doc_id, generate_subscripts(hs, 1) AS n, unnest(hs) AS h, unnest(list_transform(gs[1:len(hs)], lambda x: length(x))) AS g FROM (
      SELECT page_id AS doc_id, regexp_extract_all(html, {pattern}) AS hs, string_split_regex(html, {pattern}) AS gs FROM pages)))"""


_URL = "'(?:https?://|\\bwww\\.)[^\\s<>\"'']+'"
_TAG = r"'<(?:!--[\s\S]*?-->|/?[A-Za-z][^<>]*>)'"
_SPANS = rf"""{_positions(_URL, "u0")}, u1 AS (SELECT doc_id, e - length(h) AS s, regexp_replace(h, '[?!.,:*_~;]+$', '') AS h FROM u0),
u AS (SELECT doc_id, s, CASE WHEN h LIKE '%)' AND len(regexp_extract_all(h, '\)')) > len(regexp_extract_all(h, '\(')) THEN h[:-2] ELSE h END AS h FROM u1),
{_positions(_TAG, "t0")}, t AS (SELECT doc_id, e - length(h) AS s, e FROM t0),
a AS (SELECT doc_id, s, s + length(h) AS e FROM u UNION ALL SELECT doc_id, s, e FROM t)"""
_MERGED = rf"""{_SPANS}, r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM r),
merged AS (SELECT doc_id, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM i GROUP BY doc_id, island)"""
_P = r"""p AS (
  SELECT conv_id * 1000000 + turn AS pair_id, text AS orig, nxt AS rewrite FROM (
    SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL
)"""
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\*\*(.+?)\*\*', '\1', 'g'), '(?m)^[ \t]*(?:[*\-・]|[0-9]+[.)])[ \t]+', '', 'g'), '(?m)^#+[ \t]*', '', 'g'), '[ \t]+', ' ', 'g'))"
_SIDES = rf"""{_P}, sides AS (SELECT pair_id, 'orig' AS side, {_NORMAL.format(c="orig")} AS t FROM p UNION ALL SELECT pair_id, 'rewrite', {_NORMAL.format(c="rewrite")} FROM p),
ss AS (
  SELECT pair_id, side, (generate_subscripts(x, 1) - 1)::INT AS seq, unnest(x) AS sentence FROM (
    SELECT pair_id, side, list_filter(list_transform(regexp_extract_all(t, '[^.!?\n]*[.!?]|[^.!?\n]+'), lambda y: trim(y, ' ' || chr(9) || chr(10))), lambda y: y <> '') AS x FROM sides)
)"""


def _side_counts(c: str) -> str:
    listed = r"regexp_matches(x, '^[ \t]*(?:[*\-・]|[0-9]+[.)])[ \t]+')"
    rows = f"list_transform(string_split({c}, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '' WHEN {listed} THEN 'l' ELSE 'p' END)"
    return rf"""len(list_filter(list_transform({rows}, lambda x, i: x = 'p' OR (x = 'l' AND (i = 1 OR ({rows})[i - 1] <> 'l'))), lambda b: b))::BIGINT AS paragraphs_{c},
    len(list_filter(list_transform(regexp_extract_all({c}, '[^.!?\n]*[.!?]|[^.!?\n]+'), lambda y: trim(y, ' ' || chr(9))), lambda y: y <> ''))::BIGINT AS sentences_{c},
    regexp_matches({c}, '(?m)^[ \t]*(?:[*\-・]|[0-9]+[.)])[ \t]+\S') AS has_list_{c}"""



ORACLE_SQL = {
    "line_scan": r"""WITH x AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l, regexp_extract_all(text, '\r\n|\r|\n') AS t FROM documents),
y AS (SELECT doc_id, generate_subscripts(l, 1)::INT AS line, unnest(l) AS raw, unnest(list_concat(t, [''])) AS ending FROM x)
SELECT *, coalesce(sum(length(raw) + length(ending)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM y""",
    "doc_metrics": f"WITH {_METRICS} SELECT *, char_count AS prose_chars FROM m",
    "line_metrics": f"WITH {_METRICS} SELECT *, char_count AS prose_chars FROM m",
    "metric_rules": f"WITH {_METRICS}, {_RULES} SELECT * FROM mr",
    "sentence_records": f"WITH {_S} SELECT * FROM s",
    "ending_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "penalty_score": f"""WITH {_METRICS}, {_RULES}, {_RUNS[len(_L) + 2 :]},
fs AS (SELECT doc_id, rule, severity FROM mr UNION ALL SELECT doc_id, 'sentence_end_repetition', 'warn' FROM runs),
c AS (SELECT doc_id, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS nf, sum(CASE WHEN severity = 'info' THEN 2 ELSE 0 END) AS dw, sum(CASE WHEN severity = 'warn' THEN 2 ELSE 0 END) AS lw FROM fs GROUP BY doc_id),
z AS (SELECT m.doc_id, 0::BIGINT AS error, coalesce(warn, 0)::BIGINT AS warn, coalesce(info, 0)::BIGINT AS info, coalesce(nf, 0)::BIGINT AS n_findings, coalesce(dw, 0) AS dw, coalesce(lw, 0) AS lw, greatest(char_count, 1000)::HUGEINT AS mm FROM m LEFT JOIN c USING (doc_id))
SELECT doc_id, error, warn, info, n_findings, n_findings = 0 AS no_rule_findings,
  CASE WHEN n_findings = 0 THEN 100 ELSE greatest(1, least(99, (2 * 4000 * mm + (40 + dw) * mm + 1000 * lw) // (2 * ((40 + dw) * mm + 1000 * lw)))) END::BIGINT AS penalty_score, warn > 0 AS gate_hit FROM z""",
    "repeated_lines": rf"WITH {_L}, r AS (SELECT doc_id, line, min(line) OVER (PARTITION BY doc_id, raw) AS first_line, raw FROM raw_lines WHERE {_FULL}) SELECT * FROM r WHERE line > first_line",
    "next_sentence_context": f"WITH {_S} SELECT doc_id, line, seq, length(lag(sentence) OVER w) AS n_before, length(lead(sentence) OVER w) AS n_after FROM s WINDOW w AS (PARTITION BY doc_id, line ORDER BY seq)",
    "sentence_neighbours": rf"""WITH {_S[: _S.rindex(", s AS")]}, p AS (
  SELECT doc_id, line, pos::INT - 1 AS pos, sentence, (line - 1) // 3 AS block, CASE (line - 1) // 3 % 3 WHEN 0 THEN 'paragraph' WHEN 2 THEN 'heading' ELSE 'table' END AS kind FROM cut),
q AS (SELECT *, coalesce(lag(regexp_matches(sentence, '[.!?]$')) OVER w, false)::INT AS done, coalesce(lead(sentence) OVER w, '') AS following FROM p WINDOW w AS (PARTITION BY doc_id, block ORDER BY line, pos)),
e AS (SELECT *, sum(done) OVER (PARTITION BY doc_id, block ORDER BY line, pos) AS nth FROM q),
g AS (SELECT doc_id, block, nth, kind, string_agg(sentence, '' ORDER BY line, pos) AS whole FROM e GROUP BY doc_id, block, nth, kind),
h AS (SELECT doc_id, block, nth, CASE WHEN lag(kind) OVER a IN ('paragraph', 'heading') THEN lag(whole) OVER a ELSE '' END AS previous FROM g WINDOW a AS (PARTITION BY doc_id ORDER BY block, nth))
SELECT doc_id, line, pos, following, previous FROM e JOIN h USING (doc_id, block, nth) WHERE kind <> 'heading'""",
    "matches_over_lines": rf"""WITH {_L}, c AS (SELECT doc_id, (line - 1) // 20 AS block, line, raw, regexp_matches(raw, '[0-9]')::INT AS cut FROM raw_lines WHERE {_FULL}),
d AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, block ORDER BY line) AS part FROM c),
e AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, block, part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d WHERE cut = 0),
j AS (SELECT doc_id, block, part, string_agg(raw, '' ORDER BY line) AS t FROM e GROUP BY doc_id, block, part),
k AS (SELECT *, list_transform(regexp_extract_all(t, '[a-z]\.[A-Z]'), lambda x: length(x)) AS hs, list_transform(string_split_regex(t, '[a-z]\.[A-Z]'), lambda x: length(x)) AS gs FROM j),
m AS (SELECT doc_id, block, part, unnest(list_transform(range(1, len(hs) + 1), lambda n: coalesce(list_sum(gs[1:n]), 0) + coalesce(list_sum(hs[1:n - 1]), 0))) AS p FROM k),
x AS (SELECT doc_id, block, part, p, max(line) AS line FROM m JOIN e USING (doc_id, block, part) WHERE start <= p GROUP BY doc_id, block, part, p)
SELECT DISTINCT doc_id, block, line FROM x""",
    "allowed_by_rule": f"""WITH {_HITS}, x AS (SELECT doc_id, line, rule, words, list_filter(words, lambda w: w NOT IN ('from', 'hate', 'stupid')) AS kept FROM f)
SELECT doc_id, line, rule, CASE WHEN rule = 'common' THEN kept ELSE words END AS words FROM x
WHERE CASE rule WHEN 'common' THEN len(kept) > 0 WHEN 'harsh' THEN words[1] NOT IN ('from', 'hate', 'stupid') AND (len(words) = 1 OR len(list_filter(words[2:], lambda w: w NOT IN ('from', 'hate', 'stupid'))) > 0) ELSE true END""",
    "lexicon_hits": f"WITH {_HITS} SELECT doc_id, line, words FROM w",
    "lexicon_allowed": f"WITH {_HITS} SELECT doc_id, line, rule, rest AS words FROM f WHERE len(rest) > 0",
    "allow_removed_counts": f"WITH {_HITS} SELECT r.rule, count(f.doc_id) AS removed FROM (SELECT unnest(['common', 'uncommon', 'harsh']) AS rule) r LEFT JOIN f ON f.rule = r.rule AND len(rest) = 0 GROUP BY r.rule",
    "capped_hits": f"WITH {_HITS} SELECT * FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line)::INT AS nth, count(*) OVER (PARTITION BY doc_id) AS n_all FROM f) WHERE nth <= 3",
    "hit_density": f"WITH {_HITS} SELECT doc_id, list_sort(list(DISTINCT line))[3] AS line, count(DISTINCT line) AS n_lines FROM f GROUP BY doc_id HAVING count(DISTINCT line) >= 3",
    "multi_sentence_lines": rf"WITH {_L} SELECT doc_id, line FROM raw_lines WHERE regexp_matches(raw, '[.!?][.!?)\s]*[^.!?)\s]')",
    "paragraphs": rf"""WITH {_L}, f AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM raw_lines WHERE {_FULL}),
b AS (SELECT doc_id, min(line) AS first_line, count(*) AS n_lines, sum(length(raw))::INT AS n_chars FROM f GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS paragraph, first_line, n_lines, n_chars FROM b""",
    "bare_url_spans": f"WITH {_SPANS} SELECT doc_id, s, s + length(h) AS e, 'bare_url' AS kind, h AS hit FROM u",
    "html_tokens": f"WITH {_SPANS} SELECT doc_id, s, e, 'html_token' AS kind FROM t",
    "merged_masks": f"WITH {_MERGED} SELECT * FROM merged",
    "masked_text": f"""WITH {_MERGED}, lagged AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM merged),
parts AS (SELECT l.doc_id, string_agg(substr(html, (b + 1)::BIGINT, (s - b)::BIGINT) || repeat(' ', (e - s)::BIGINT), '' ORDER BY s) AS v, max(e) AS last FROM lagged l JOIN pages ON page_id = l.doc_id GROUP BY l.doc_id)
SELECT page_id AS doc_id, md5(coalesce(v || substr(html, (last + 1)::BIGINT), html)) AS visible_md5, length(html) AS n_chars FROM pages LEFT JOIN parts ON page_id = doc_id""",
    "urls_near_tags": f"WITH {_SPANS} SELECT doc_id, s AS lo, s + length(h) + 40 AS hi FROM u WHERE EXISTS (SELECT 1 FROM t WHERE t.doc_id = u.doc_id AND t.s < u.s + length(u.h) + 40 AND t.e > u.s)",
    "turn_diff_words": rf"""WITH {_P}, x AS (SELECT pair_id, list_sort(list_filter(list_distinct(regexp_extract_all(rewrite, '[A-Za-z]{{4,}}')), lambda w: NOT contains(orig, w))) AS new_words,
  list_sort(list_filter(list_distinct(regexp_extract_all(orig, '[A-Za-z]{{4,}}')), lambda w: NOT contains(rewrite, w))) AS lost_words FROM p) SELECT * FROM x WHERE len(new_words) > 0 OR len(lost_words) > 0""",
    "turn_marker_delta": rf"""WITH {_P}, k AS (SELECT unnest([{{'kind': 'the', 'p': '\bthe\b'}}, {{'kind': 'question', 'p': '\?'}}, {{'kind': 'and', 'p': '\band\b'}}, {{'kind': 'stop', 'p': '\.'}}], recursive := true)),
x AS (SELECT pair_id, kind, len(regexp_extract_all(orig, k.p)) AS n_orig, len(regexp_extract_all(rewrite, k.p)) AS n_rewrite FROM p, k) SELECT * FROM x WHERE n_orig <> n_rewrite""",
    "turn_structure": f"""WITH {_P}, x AS (SELECT pair_id, {_side_counts("orig")}, {_side_counts("rewrite")} FROM p)
SELECT *, has_list_orig AND NOT has_list_rewrite AS list_dropped, paragraphs_rewrite < paragraphs_orig AS paragraphs_merged, sentences_orig <> sentences_rewrite AS sentences_changed FROM x""",
    "turn_comma_rates": rf"""WITH {_SIDES}, x AS (SELECT pair_id, sum(CASE WHEN side = 'orig' THEN len(regexp_extract_all(sentence, ',')) ELSE 0 END)::BIGINT AS commas_orig, count(*) FILTER (WHERE side = 'orig') AS n_orig,
  sum(CASE WHEN side = 'rewrite' THEN len(regexp_extract_all(sentence, ',')) ELSE 0 END)::BIGINT AS commas_rewrite, count(*) FILTER (WHERE side = 'rewrite') AS n_rewrite FROM ss GROUP BY pair_id)
SELECT *, commas_rewrite - commas_orig >= 1 AND n_orig > 0 AND n_rewrite > 0 AND 10 * (commas_rewrite * n_orig - commas_orig * n_rewrite) >= n_orig * n_rewrite AS rose FROM x""",
    "turn_ending_counts": rf"""WITH {_SIDES}, x AS (SELECT pair_id, side, regexp_extract(sentence, '([a-z]?)[.!?]?$', 1) AS kind, count(*) AS n, min(seq) AS first_seq FROM ss GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY n DESC, first_seq)::INT AS place FROM x""",
    "turn_logic_points": rf"""WITH {_SIDES} SELECT pair_id, side, seq, 'opening' AS kind FROM ss WHERE regexp_matches(sentence, '^(The|And|Is) ')
UNION ALL SELECT pair_id, side, seq, 'announcing' FROM ss WHERE regexp_matches(sentence, ' (the|this) [a-z]+[.]$')""",
    "turn_line_multisets": f"""WITH {_P}, x AS (SELECT pair_id, unnest(string_split(orig, chr(10))) AS raw, 1 AS d FROM p UNION ALL SELECT pair_id, unnest(string_split(rewrite, chr(10))), -1 FROM p),
y AS (SELECT pair_id, raw, sum(d)::BIGINT AS d FROM x GROUP BY ALL HAVING sum(d) <> 0) SELECT pair_id, CASE WHEN d > 0 THEN 'orig' ELSE 'rewrite' END AS side, raw, abs(d) AS extra FROM y""",
    "bigram_pairing": """WITH l AS (SELECT DISTINCT item_id AS l_id, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS g FROM benchmark),
r AS (SELECT DISTINCT doc_id AS r_id, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS g FROM documents),
nl AS (SELECT l_id, count(*) AS n FROM l GROUP BY l_id), nr AS (SELECT r_id, count(*) AS n FROM r GROUP BY r_id),
x AS (SELECT l_id, r_id, count(*) AS bo FROM l JOIN r USING (g) GROUP BY l_id, r_id), y AS (SELECT l_id, r_id, bo, nl.n + nr.n - bo AS u FROM x JOIN nl USING (l_id) JOIN nr USING (r_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY bo::DOUBLE / u DESC, r_id) AS n FROM y WHERE bo >= 0.2 * u)
SELECT l_id, r_id, bo AS "both", u AS "union" FROM z WHERE n = 1""",
    "label_sync": "SELECT DISTINCT doc_id AS name, 'unlisted' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'orphan' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "props_contract": """SELECT event_id, list_filter([CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN NULL WHEN json_type(props, '$.k') IS NULL THEN 'k: missing' ELSE 'k: not a number' END,
  CASE WHEN json_type(props, '$.missing') IS NULL THEN 'missing: missing' END, CASE WHEN json_type(props, '$.v') NOT IN ('ARRAY') THEN 'v: not a array' END], lambda x: x IS NOT NULL) AS problems FROM events""",
    "jp_rules_golden": """SELECT * FROM (VALUES (1, 'meta_filler', 1, 'warn'), (2, 'negative_parallelism', 1, 'info'), (3, 'slop_vocabulary', 1, 'warn'), (4, 'metaphor_verb', 1, 'warn'), (5, 'nakaguro_parallel', 1, 'warn'),
  (6, 'emoji_prohibited', 1, 'warn'), (7, 'short_summary_heading', 1, 'info'), (8, 'trailing_colon', 1, 'warn'), (9, 'katakana_term', 1, 'info'), (10, 'renyo_noun', 1, 'info'), (11, 'bare_verb_chain', 1, 'info')) t(doc_id, rule, line, severity)""",
    "jp_diff_golden": "SELECT * FROM (VALUES (1, '依頼', 1, 0), (1, '評価', 1, 0), (1, '念押し', 1, 0)) t(pair_id, kind, n_orig, n_rewrite)",
    "jp_words_golden": "SELECT * FROM (VALUES (1, [], ['大切']), (2, ['性能', '計測'], ['測定'])) t(pair_id, new_words, lost_words)",
    "size_limits": "SELECT 'size' AS \"check\", doc_id AS path, unnest(list_filter([CASE WHEN len(string_split(text, chr(10))) > 12 THEN 'too many lines' END, CASE WHEN length(text) > 4000 THEN 'too many characters' END], lambda x: x IS NOT NULL)) AS message FROM documents",
    "status_counts": """WITH v AS (SELECT CASE WHEN len(string_split(text, chr(10))) > 12 THEN 1 ELSE 0 END AS a, CASE WHEN length(text) > 4000 THEN 1 ELSE 0 END AS b FROM documents),
x AS (SELECT 'too many lines' AS "check", sum(a)::BIGINT AS n FROM v UNION ALL SELECT 'too many characters', sum(b)::BIGINT FROM v UNION ALL SELECT 'no text', 0) SELECT *, n = 0 AS passed FROM x""",
    "status_gaps": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.s AS expected, l.quality AS actual FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS s FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.s IS DISTINCT FROM l.quality",
    "semver_check": """WITH v AS (SELECT * FROM (VALUES (1, '1.2.3', '1.2.4', false), (2, '1.2.3', '1.3.0', true), (3, '1.2.3', '1.2.9', true), (4, '1.2.3', '1.2.3', false), (5, '1.10.0', '1.9.9', false), (6, '1.x', '2.0.0', false), (7, '0.9.9', '1.0.0', true)) t(id, base, head, st)),
p AS (SELECT *, CASE WHEN regexp_full_match(base, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN list_transform(string_split(base, '.'), lambda x: x::INT) END AS b, CASE WHEN regexp_full_match(head, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN list_transform(string_split(head, '.'), lambda x: x::INT) END AS h FROM v),
q AS (SELECT *, CASE WHEN b IS NULL OR h IS NULL THEN 'not a version' WHEN b = h THEN 'not changed' WHEN h < b THEN 'not higher' WHEN st AND NOT (h[1:2] > b[1:2]) THEN 'needs a minor version' ELSE 'ok' END AS verdict FROM p)
SELECT id, verdict, CASE WHEN verdict = 'ok' THEN head WHEN b IS NULL THEN NULL WHEN st THEN b[1] || '.' || (b[2] + 1) || '.0' ELSE b[1] || '.' || b[2] || '.' || (b[3] + 1) END AS planned FROM q""",
    "section_sizes": rf"""WITH {_L}, h AS (SELECT *, regexp_matches(raw, '\||!!') AS head FROM raw_lines), s AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM h)
SELECT doc_id, section, count(*) FILTER (WHERE NOT head AND {_FULL}) AS body_lines FROM s WHERE section > 0 GROUP BY doc_id, section HAVING count(*) FILTER (WHERE NOT head AND {_FULL}) > 1""",
    "context_snippets": r"""WITH x AS (SELECT doc_id, text, regexp_extract(text, '\b(?:stupid|idiot|hate|moron|trash)\b') AS w, string_split_regex(text, '\b(?:stupid|idiot|hate|moron|trash)\b')[1] AS pre FROM documents)
SELECT doc_id, substr(text, greatest(length(pre) - 18, 0) + 1, length(pre) + length(w) + 18 - greatest(length(pre) - 18, 0)) AS snippet FROM x WHERE w <> ''""",
}

QUERIES = {f.__name__: f for f in (
    penalty_score, line_scan, doc_metrics, line_metrics, metric_rules, sentence_records, ending_runs, repeated_lines, next_sentence_context, sentence_neighbours, allowed_by_rule, matches_over_lines, lexicon_hits, lexicon_allowed, allow_removed_counts, capped_hits,
    hit_density, multi_sentence_lines, paragraphs, bare_url_spans, html_tokens, merged_masks, masked_text, urls_near_tags, turn_diff_words, turn_marker_delta, turn_structure, turn_comma_rates,
    turn_ending_counts, turn_logic_points, turn_line_multisets, turn_heading_shapes, turn_opcodes, turn_ending_changes, bigram_pairing, label_sync, props_contract, size_limits, status_counts, status_gaps, semver_check, section_sizes, context_snippets, lint_envelope, jp_rules_golden, jp_diff_golden, jp_words_golden,
)}
QUERIES |= more.QUERIES
ORACLE_SQL |= more.oracle(_SIDES)
