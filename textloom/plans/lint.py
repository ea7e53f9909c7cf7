"""Document lint: parse once, then every rule is a relation over lines or sentences; findings are their union.

Only ``parse_documents`` leaves the JVM.  Pattern rules join a small literal table of patterns (a broadcast of a fixed
number of rows); the others are expressions over a line, a sentence or a window of one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import squeeze, strip
from textloom.operators import findings as fnd
from textloom.operators.bold import bold_marks
from textloom.operators.markdown import parse_documents
from textloom.operators.segments import ending_runs, joined_parts, lines_of_matches, pieces, sentences_in_context

from . import rules_ja as ja

ENDS = "。！？!?"
NOT_TEXT = ["code", "frontmatter", "html_block", "reference_definition"]
WIDE = "[\u2300-\U0010FFFF]"
COLUMNS = ["doc_id", "rule", "line", "severity", "label", "words", "snippet"]


def scan_columns(lines: DataFrame) -> DataFrame:
    """Adds scan (trimmed visible text), plain (without mentions in brackets and emphasis marks) and the gates."""
    scan = strip("visible")
    mention = F.regexp_replace(scan, "「[^」]*」", "・")
    plain = F.regexp_replace(mention, r"\*\*|\*|__", "")
    text = ~F.col("kind").isin(NOT_TEXT) & (scan != "")
    outside = (F.col("quote_depth") == 0) & ~F.col("kind").isin("quote", "table")
    return lines.withColumns({"scan": scan, "plain": plain, "is_text": text, "is_prose": text & outside, "is_body": text & outside & (F.col("kind") != "heading")})


def _found(rows: DataFrame, rule: str | Column, severity: str, label: Column | None = None, words: Column | None = None) -> DataFrame:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return rows.select("doc_id", rule.alias("rule"), "line", F.lit(severity).alias("severity"), (label if label is not None else F.lit("")).alias("label"), (words if words is not None else F.array().cast("array<string>")).alias("words"), strip("raw").alias("snippet"))


def _like(pattern: str):
    return lambda s: s.rlike(pattern)


def _pieces_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("parts", pieces(F.col("plain"), ENDS))


def emoji(lines: DataFrame) -> DataFrame:
    words = F.regexp_extract_all("scan", F.lit(ja.EMOJI), F.lit(0))
    return _found(lines.filter(F.col("is_text") & F.col("scan").rlike(ja.EMOJI)), "emoji_prohibited", "warn", F.array_join(F.slice(words, 1, 3), " "), words)


def dashes(lines: DataFrame) -> DataFrame:
    """Text with its quotes and link texts blanked that holds a dash between other characters; the first shape counts."""
    bare = lambda c: F.regexp_replace(c, r"\*\*|\*|__", "")
    credit = F.regexp_replace(strip("plain"), rf"^[{ja.DASHES} \t　]+", "")
    credited = strip("plain").rlike(rf"^[{ja.DASHES}]") & (credit.rlike(ja.CREDIT_LABEL) | credit.rlike(ja.CREDIT_BOOK) | credit.rlike(ja.CREDIT_ENGLISH))
    masked = F.regexp_replace(bare("unquoted"), ja.LINK_CREDIT, "]")
    text = strip(F.when(credited, F.regexp_replace(masked, rf"^\s*[{ja.DASHES}]+", "")).otherwise(masked))
    core = F.regexp_replace(text, rf"[{ja.DASHES} 　\p{{P}}\p{{S}}]", "")
    some = reduce(Column.__or__, [F.col("plain").contains(c) for c in ja.DASHES])
    rows = lines.filter(F.col("is_prose") & some).withColumn("t", text)
    rows = rows.filter(F.col("t").rlike(f"[{ja.DASHES}]") & ~F.col("t").rlike(ja.DIAGRAM) & (core != ""))
    rule = F.when(F.col("t").rlike(ja.DASH_LIST_ENDING), "dash_list_ending").when(F.col("t").rlike(ja.DASH_INSERTION), "dash_insertion").otherwise("dash_decoration")
    return _found(rows, rule, "warn")


def bold(docs: DataFrame) -> DataFrame:
    """Bold marks that may be shown as they stand, with what to do and the repair."""
    rows = bold_marks(docs)
    shown = F.when(F.col("suggest") == "", F.col("found")).otherwise(F.concat("found", F.lit(" → "), "suggest"))
    return rows.select("doc_id", F.lit("bold_not_rendered").alias("rule"), "line", F.lit("error").alias("severity"), F.col("how").alias("label"), F.array().cast("array<string>").alias("words"), shown.alias("snippet"))


def middle_dots(lines: DataFrame) -> DataFrame:
    """Words in a row joined by middle dots, unless all of them look like parts of a name."""
    text = F.regexp_replace(F.regexp_replace("scan", "「[^」]*」", "　"), r"\*\*|\*|__", "")
    runs = F.filter(F.regexp_extract_all(text, F.lit(ja.NAKAGURO), F.lit(0)), lambda r: ~F.forall(F.split(r, "[・･]"), lambda s: s.rlike(ja.PROPER_SEGMENT)))
    rows = lines.filter(~F.col("kind").isin("code", "html_block", "reference_definition")).withColumn("runs", runs).filter(F.size("runs") > 0)
    return _found(rows, "nakaguro_parallel", "warn", None, F.slice("runs", 1, 1))


def one_sentence(lines: DataFrame) -> DataFrame:
    text = F.regexp_replace("visible", r"「[^」]*」|\[\^[^\]]*\]", "")
    text = F.regexp_replace(text, r"\[([^\]]*[。！？][^\]]*)\][ \t]+|\[([^\]]*)\][ \t]+(?=[。！？])", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\][ \t]+", ""), "（[^（）。！？]*）", "")
    text = F.regexp_replace(text, r"\*\*|\*|__", "")
    return _found(lines.filter(F.col("is_prose") & text.rlike(ja.TWO_SENTENCES)), "one_sentence_per_line", "warn")


def headings(lines: DataFrame, metrics: DataFrame) -> DataFrame:
    rows = lines.filter(F.col("is_prose") & (F.col("kind") == "heading"))
    short = rows.filter(strip("raw").rlike(ja.SUMMARY_HEADING)).join(metrics.filter("char_count < 2000").select("doc_id"), "doc_id", "left_semi")
    return _found(short, "short_summary_heading", "info").unionByName(_found(rows.filter(F.col("scan").rlike(ja.EMPTY_BRACKET)), "redundant_bracket", "warn"))


def colons(lines: DataFrame) -> DataFrame:
    last = F.regexp_replace("visible", r"[\s　]+\z", "")
    return _found(lines.filter(F.col("is_body") & (strip("raw").endswith(":") | strip("raw").endswith("：")) & last.rlike(r"[：:]\z") & ~F.col("scan").startswith("http")), "trailing_colon", "warn")


def _entries(rows: DataFrame, rule: str, severity: str, entries: list[tuple[Column, Column, Column]]) -> DataFrame:
    """One row for each entry (test, label, words) that holds, in one pass over the rows."""
    hits = F.filter(F.array(*[F.when(t, F.struct(x.alias("label"), w.alias("words"))) for t, x, w in entries]), lambda h: h.isNotNull())
    rows = rows.select("doc_id", "line", "raw", F.explode(hits).alias("h"))
    return _found(rows, rule, severity, F.col("h.label"), F.col("h.words"))


def vocabulary(lines: DataFrame) -> DataFrame:
    """One row for each listed word or shape of a line."""
    entries = [(F.contains("plain", F.lit(w)), F.lit(w), F.array(F.lit(w))) for w in ja.SLOP_WORDS]
    entries += [(F.col("plain").rlike(p), F.lit(s), F.array_distinct(F.concat(F.array(F.lit(s)), F.regexp_extract_all("plain", F.lit(p), F.lit(0))))) for s, p in ja.SLOP_SHAPES]
    return _entries(lines.filter("is_body"), "slop_vocabulary", "warn", entries)


def metaphors(lines: DataFrame) -> DataFrame:
    """Verb patterns; a silent failure inside 'X fails silently' counts once."""
    entries = []
    for n, (label, pattern) in enumerate(ja.METAPHOR_VERBS):
        text = F.regexp_replace("plain", ja.METAPHOR_VERBS[1][1], " ") if n == 2 else F.col("plain")
        entries.append((text.rlike(pattern), F.lit(label), F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))))
    return _entries(lines.filter("is_body"), "metaphor_verb", "warn", entries)


def sentence_patterns(lines: DataFrame) -> DataFrame:
    """Fillers (one row per entry and line) and the three sentence hints."""
    rows = _pieces_of(lines.filter("is_body"))
    table = [("meta_filler", p, label, "warn") for label, p in ja.FILLERS] + [(rule, p, "", "info") for rule, p in ja.SENTENCE_INFOS]
    hits = F.filter(F.array(*[F.when(F.exists("parts", _like(p)), F.struct(F.lit(r).alias("rule"), F.lit(x).alias("label"), F.lit(v).alias("severity"))) for r, p, x, v in table]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "line", "raw", F.inline(hits))
    return rows.select("doc_id", "rule", "line", "severity", "label", F.array().cast("array<string>").alias("words"), strip("raw").alias("snippet"))


def image_only() -> Column:
    """A line that shows nothing but an image, or nothing but an image that is a link."""
    linked = strip("raw").startswith("[![") & strip("visible").rlike(r"^\[\s*\]\z") & strip("raw").endswith(")")
    return ((strip("visible") == "") & F.col("raw").rlike(r"!\[")) | linked


def negations(lines: DataFrame, whole: DataFrame) -> DataFrame:
    """'not A but B', unless every one of the line says 'but also'; 'not A, it is B'; 'not A, nor B. It is C.', which may run
    over the lines of a paragraph.  One row a line; ``whole`` has all lines of the documents."""
    count = lambda p: F.regexp_count("plain", F.lit(p))
    but = F.col("plain").rlike(ja.NOT_BUT) & (count("ではなく") != count(ja.NOT_BUT_ALSO))
    this = F.exists(pieces(F.col("plain"), ENDS), lambda s: s.rlike(ja.NOT_THIS))
    here = lines.filter(F.col("is_body") & (but | this | F.col("plain").rlike(ja.NEGATION_EXTRA)))
    rows = whole.filter("kind = 'paragraph'").withColumn("t", strip(F.regexp_replace("unquoted", r"__|\*", "")))
    some = rows.filter(F.col("t").rlike("い。|^。")).select("doc_id", "block").distinct()
    parts = joined_parts(rows.join(some, ["doc_id", "block"], "left_semi"), ["doc_id", "block"], "t", (F.col("quote_depth") > 0) | image_only())
    over = lines_of_matches(parts.filter(F.contains("joined", F.lit("でもない。"))), ["doc_id", "block"], ja.NEGATION_EXTRA)
    return _found(here.select("doc_id", "line", "raw").unionByName(over.select("doc_id", "line", "raw")).distinct(), "negative_parallelism", "info")


def _in_context(lines: DataFrame, trigger: str) -> DataFrame:
    """Sentences with their neighbours, of documents in which a line has the ``trigger``."""
    some = lines.filter(F.col("raw").rlike(trigger)).select("doc_id").distinct()
    rows = lines.filter("kind != 'blank'").join(some, "doc_id", "left_semi")
    return sentences_in_context(rows.withColumn("text", F.when(F.col("quote_depth") == 0, strip(F.regexp_replace("unquoted", r"__|\*", ""))).otherwise("")), "text", ENDS)


def residues(lines: DataFrame) -> DataFrame:
    """Sentences that tell how the text will be written or what it leaves out, unless they send the reader elsewhere."""
    s, after = F.col("sentence"), F.col("following")
    said = F.regexp_extract(s, ja.WRITING_ACTION, 0)
    style = (said != "") & (F.contains(said, F.lit("ます")) | s.rlike(ja.RESIDUE_OPENER)) & s.rlike(ja.WRITING_STYLE)
    scope = s.rlike(ja.SCOPE_EXCLUSION) | ((said != "") & s.rlike(ja.WRITING_LIMIT))
    useful = s.rlike(ja.READER_SCOPE) | s.rlike(ja.SCOPE_REFERENCE) | after.rlike(ja.SCOPE_REFERENCE)
    rows = _in_context(lines, f"{ja.WRITING_STYLE}|{ja.WRITING_LIMIT}|扱|触れ|省|割愛").filter(style | (scope & ~useful))
    return _found(rows.select("doc_id", "line", "raw").distinct(), "instruction_residue", "info")


def cleft_lists(lines: DataFrame) -> DataFrame:
    """'What ... is, A, B, C.' without a predicate, where the sentence before neither asks nor names the verb."""
    s = F.col("sentence")
    t = F.regexp_replace(F.regexp_replace(s, r"[\s　]{2,}", "Ｘ"), r"[\s　]", "")
    items = F.regexp_extract(t, ja.CLEFT_MIXED, 2)
    joiners, tail = F.regexp_count(items, F.lit(ja.CLEFT_JOINER)), F.regexp_extract(items, rf"(?:{ja.CLEFT_JOINER})(.*)\z", 1)
    phrase = (joiners == 1) & ~items.rlike("[、，・]") & F.contains(tail, F.lit("の"))
    mixed = t.rlike(ja.CLEFT_MIXED) & (joiners > 0) & ~phrase
    head = F.when(t.rlike(ja.CLEFT_COMMAS), F.regexp_extract(t, ja.CLEFT_COMMAS, 1)).when(mixed, F.regexp_extract(t, ja.CLEFT_MIXED, 1))
    filler = reduce(lambda a, p: a | s.rlike(p), [p for _, p in ja.FILLERS], F.lit(False))
    rows = _in_context(lines, "のは、").filter(F.contains(s, F.lit("のは、")) & ((F.col("following") == "") | s.rlike(r"[。！!]\z"))).withColumn("head", head)
    asked = F.regexp_replace("previous", r"[」』）)\"'*_\s　]+\z", "").rlike(r"(?:[？?]|か。?)\z")
    stem = F.split(F.regexp_extract("head", ja.CLEFT_STEM, 0), "")
    named = F.exists(stem, lambda c: (c != "") & F.contains("previous", c))
    return _found(rows.filter(F.col("head").isNotNull() & ~filler & ~asked & ~named).select("doc_id", "line", "raw").distinct(), "cleft_list_ending", "info")


def densities(lines: DataFrame, negative: DataFrame) -> DataFrame:
    """Three lines with a negation (at the third), three list rows with a bold label (at the first)."""
    labels = lines.filter(F.col("is_body") & F.col("raw").contains("**") & F.col("raw").rlike(ja.BOLD_LABEL))
    out = []
    for rows, rule, nth in ((negative, "negative_parallelism_density", 3), (labels, "bold_label_list", 1)):
        at = fnd.dense(rows.select("doc_id", "line"), 3, nth)
        out.append(at.select("doc_id", F.lit(rule).alias("rule"), "line", F.lit("info").alias("severity"), F.col("n_lines").cast("string").alias("label"), F.array().cast("array<string>").alias("words"), F.lit("").alias("snippet")))
    return out[0].unionByName(out[1])


def of_course(lines: DataFrame) -> DataFrame:
    """A short 'of course' sentence, unless what comes before it is a yes-or-no question."""
    some = lines.filter(F.col("raw").rlike("(もちろん|勿論)[*_]*、")).select("doc_id").distinct()
    lines = lines.join(some, "doc_id", "left_semi")  # the window sees only documents that have the word at all
    w = Window.partitionBy("doc_id").orderBy("line")
    carried = F.when(F.col("kind").isin("code", "table", "thematic_break", "quote", "frontmatter", "html_block", "reference_definition") | (F.col("quote_depth") > 0), "").when(F.col("is_body") | (F.col("kind") == "heading"), F.col("plain"))
    rows = _pieces_of(lines.withColumn("carried", carried).filter("carried is not null").withColumn("previous", F.lag("carried").over(w)).filter("is_body"))
    before = pieces(F.coalesce("previous", F.lit("")), ENDS)
    context = F.concat(F.array(F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(""))), F.col("parts"))
    question = lambda s: s.rlike(ja.QUESTION) & ~s.rlike(ja.WH_QUESTION)
    hit = F.exists(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get("parts", i - 1).rlike(ja.SHORT_OF_COURSE) & ~F.get("parts", i - 1).rlike(ja.OF_COURSE_ANSWER) & ~question(F.get(context, i - 1)))
    return _found(rows.filter((F.size("parts") > 0) & hit), "short_mochiron", "info")


def fragments(lines: DataFrame) -> DataFrame:
    """Three short sentences in a row inside a paragraph, at the line where they begin."""
    some = lines.filter(F.col("raw").rlike("[。！]")).select("doc_id", "block").distinct()
    rows = lines.join(some, ["doc_id", "block"], "left_semi").filter(F.col("is_body") & F.col("kind").isin("paragraph", "list")).withColumn("v", strip("unquoted"))
    w = Window.partitionBy("doc_id", "block").orderBy("line")
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("v")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = rows.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("line", "v", "start", "raw"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["v"]), "")
    between, runs = F.split(text, ja.FRAGMENTS, -1), F.regexp_extract_all(text, F.lit(ja.FRAGMENTS), F.lit(0))
    long = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    hits = F.transform(F.sequence(F.lit(1), F.size(runs)), lambda n: long(between, n) + long(runs, n - 1))  # where each run begins
    at = whole.filter(text.rlike(ja.FRAGMENTS)).select("doc_id", F.explode(F.array_distinct(F.transform(hits, lambda p: F.array_max(F.filter("x", lambda r: r["start"] <= p))))).alias("r"))
    return _found(at.select("doc_id", "r.line", "r.raw").distinct(), "fragment_run", "info")


def noun_chains(lines: DataFrame) -> DataFrame:
    chains = F.regexp_extract_all(F.regexp_replace("plain", ja.CHAIN_MASK, "・"), F.lit(ja.NOUN_CHAIN), F.lit(0))

    def heavy(c: Column) -> Column:
        parts = F.split(c, "の")
        n = F.size(F.filter(parts, lambda s: s.rlike(ja.ABSTRACT)))
        return (n >= 2) | ((F.size(parts) >= 4) & (n >= 1))

    return _found(lines.filter(F.col("is_body") & F.exists(chains, heavy)), "noun_chain", "info")


def listed_terms(lines: DataFrame) -> DataFrame:
    """Katakana terms, nouns made of verbs, empty praise: rules that read word lists."""
    rows = lines.filter(F.col("kind").isin("paragraph", "list", "heading", "table") & (F.col("quote_depth") == 0))
    longest = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
    katakana = rf"(?:{longest(ja.KATAKANA_TERMS)})(?![ 　]?[0-9０-９A-Za-zＡ-Ｚａ-ｚ])"
    vetoes = "".join(rf"(?!{w}(?:{after}))" for w, after in ja.RENYO_NOT_BEFORE.items())
    renyo = rf"{ja.RENYO_BEFORE}({vetoes}(?:{longest(ja.RENYO_NOUNS)})){ja.RENYO_AFTER}"
    body = "|".join(f"(?:{noun}(?:が|は|も){ja.THIN_ADVERB}(?:{good}))" for noun, good in ja.THIN_NOUNS)
    thin = rf"^[^、，,]{{0,20}}?(?:{body}){ja.THIN_TAIL}[。．！!]*\z"
    out = []
    for rule, pattern, group in (("katakana_term", katakana, 0), ("renyo_noun", renyo, 1)):
        out.append(_found(rows.filter(F.col("plain").rlike(pattern)), rule, "info", None, F.array_distinct(F.regexp_extract_all("plain", F.lit(pattern), F.lit(group)))))
    praise = rows.filter((F.col("kind") != "heading") & F.exists(pieces(F.col("plain"), ENDS), lambda s: s.rlike(thin)))
    return out[0].unionByName(out[1]).unionByName(_found(praise, "thin_evaluation", "info"))


def shapes(lines: DataFrame) -> DataFrame:
    """Hedged 'one can say', a noun after a comma, three or more bare verbs in a row."""
    rows = lines.filter(F.col("kind").isin("paragraph", "list", "heading") & (F.col("quote_depth") == 0) & F.col("is_text"))
    shown = F.regexp_replace(F.regexp_replace("unquoted", r"__|\*", ""), "“[^“”]*”|\"[^\"]*\"", " ")
    shown = F.when(F.col("kind") == "heading", F.regexp_replace(shown, r"^\s*#{1,6}(?:\s+|\z)|\s+#+\s*\z", "")).otherwise(shown)
    rows = rows.withColumn("parts", F.filter(F.regexp_extract_all(shown, F.lit(r"[^。！？!?]+(?:[。！？!?]+|\z)"), F.lit(0)), lambda x: strip(x) != ""))
    head = lambda s: F.regexp_extract(s, ja.SAY_HEDGE, 1)
    hedge = lambda s: s.rlike(ja.SAY_HEDGE) & ~s.rlike(ja.SAY_HEDGE_JUDGE) & (~head(s).rlike(ja.SAY_HEDGE_NOUN) | head(s).rlike(ja.SAY_HEDGE_ADJECTIVE))

    def verbs(sentence: Column) -> Column:
        s = strip(sentence)
        parts = F.transform(F.split(F.regexp_replace(s, r"。\z", ""), "、"), strip)
        fine = lambda p: p.rlike(ja.BARE_VERB) & ~p.rlike(ja.BARE_VERB_NOT)
        return (F.length(s) <= 30) & s.endswith("。") & (F.size(parts) >= 3) & ~s.rlike(ja.BARE_VERB_PARTICLE) & F.forall(parts, fine) & ~F.element_at(parts, -1).endswith("か")

    def noun(sentence: Column) -> Column:
        s = strip(sentence)
        before, last = strip(F.regexp_extract(s, ja.COPY_COMMA_NOUN, 1)), F.regexp_replace(F.regexp_extract(s, ja.COPY_COMMA_NOUN, 2), r"を\z", "")
        fine = (F.length(s) <= 20) & s.rlike(ja.COPY_COMMA_NOUN) & F.length(last).between(1, 6) & (F.length(before) >= 2)
        fine = fine & ~before.isin(ja.COPY_NOT_MODIFIER) & ~before.rlike(ja.COPY_PARTICLE) & (~last.endswith("い") | last.isin(ja.COPY_I_NOUNS))
        return fine & ~last.rlike(ja.COPY_NOT_NOUN)

    copies = _found(rows.filter(F.exists("parts", noun)), "copy_comma_noun", "info")
    return copies.unionByName(_found(rows.filter(F.exists("parts", hedge)), "say_hedge", "info")).unionByName(_found(rows.filter(F.exists("parts", verbs)), "bare_verb_chain", "info"))


def endings(lines: DataFrame) -> DataFrame:
    """The third of three sentences in a row of one paragraph that end alike."""
    rows = lines.filter(F.col("is_body") & (F.col("kind") == "paragraph"))
    s = rows.select("doc_id", "block", "line", "raw", F.posexplode(pieces(F.col("scan"), "。！？")).alias("pos", "sentence")).filter(F.length("sentence") > 3)
    bare = F.regexp_replace("sentence", r"[。！？\s　]+\z", "")
    kind = reduce(lambda k, e: k.when(bare.endswith(e), e), ja.SENTENCE_ENDINGS[1:], F.when(bare.endswith(ja.SENTENCE_ENDINGS[0]), ja.SENTENCE_ENDINGS[0]))
    hits = ending_runs(s.withColumn("seq", F.struct("line", "pos")), kind, ["doc_id", "block"])
    return hits.select("doc_id", F.lit("sentence_end_repetition").alias("rule"), "line", F.lit("warn").alias("severity"), F.col("kind").alias("label"), F.array().cast("array<string>").alias("words"), F.col("sentence").alias("snippet"))


def narrative(lines: DataFrame, least: int = 1000, first_person: float = 1.0, dense: float = 8.0) -> DataFrame:
    """Documents with enough prose, hardly a first person, and many numbers and list rows."""
    rows = lines.filter(F.col("is_body") & ~F.col("kind").isin("heading_underline", "thematic_break"))
    bare = lambda c: F.when(F.col(c).contains("*") | F.col(c).contains("__"), F.regexp_replace(c, r"__|\*", "")).otherwise(F.col(c))
    n = F.length(squeeze(bare("visible")))
    # patterns that look back at every character run only over lines that have what they look for
    persons = F.when(F.col("is_wide"), F.regexp_count(bare("unquoted"), F.lit(ja.FIRST_PERSON))).otherwise(0)
    numbers = F.when(F.col("raw").rlike("[0-9０-９]"), F.regexp_count(bare("unquoted"), F.lit(ja.NUMBER))).otherwise(0)
    rows = rows.withColumn("n", n)
    got = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(persons).alias("p"), F.sum(numbers + ((F.col("kind") == "list") & F.col("list_item")).cast("int")).alias("d"), F.min(F.when(F.col("n") > 0, F.col("line"))).alias("line"), F.min_by(F.col("raw"), F.when(F.col("n") > 0, F.col("line"))).alias("raw"))
    return _found(got.filter((F.col("n") >= least) & (F.col("p") * 1000 < first_person * F.col("n")) & (F.col("d") * 1000 >= dense * F.col("n"))), "narrative_density", "info")


def top_quotes(text: Column) -> Column:
    """What the outermost quotes of a line hold, by a stack of open marks; a mark that closes another kind counts as text."""
    marks = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda m: m["c"].isin(*ja.QUOTES, *ja.QUOTES.values()))
    state = F.struct(F.array().cast("array<struct<c:string,i:int>>").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        top = F.try_element_at(s["open"], F.lit(-1))
        left = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        closes = reduce(lambda a, q: a | ((top["c"] == q[0]) & (m["c"] == q[1])), ja.QUOTES.items(), F.lit(False))
        said = F.concat(s["out"], F.array(F.substr(text, top["i"] + 2, m["i"] - top["i"] - 1)))
        return (
            F.when(m["c"].isin(*ja.QUOTES), F.struct(F.concat(s["open"], F.array(m)).alias("open"), s["out"].alias("out")))
            .when(F.coalesce(closes, F.lit(False)), F.struct(left.alias("open"), F.when(F.size(left) == 0, said).otherwise(s["out"]).alias("out"))).otherwise(s)
        )

    return F.aggregate(marks, state, step)["out"]


def ai_phrases(lines: DataFrame, doc_type: str | None = None) -> DataFrame:
    """Seven turns of phrase, each once per line, in order; some count only where nobody is named who judges or invites."""
    rows = lines.filter(F.col("kind").isin("paragraph", "list", "heading", "table") & (F.col("quote_depth") == 0))
    rows = rows.filter(F.col("plain").rlike(r"見立て|潜|招く|欠かせない存在|挙動を|なんよ|を[一-龥々]{2,}[。．]"))
    parts = F.filter(F.transform(F.regexp_extract_all("plain", F.lit(r"[^。．！？!?|｜]+[。．！？!?]*"), F.lit(0)), strip), lambda x: x != "")
    before = lambda s, p: F.regexp_extract(s, f"(?s)^(.*?){p}", 1)
    kind = F.col("kind")
    vetoes = {
        "見立てです": lambda s: F.concat(before(s, ja.AI_VIEW), F.regexp_extract(s, rf"((?:という|との|の))見立て(?:です|でした|だ|だった|である)[。．！!]*\z", 1)).rlike(ja.AI_JUDGE),
        "が招く": lambda s: before(s, ja.AI_INVITED).rlike(ja.AI_INVITER),
        "なんよ": lambda s: F.lit(doc_type in ("script", "essay")) | ~kind.isin("paragraph", "list"),
        "て形の体言止め": lambda s: F.lit(doc_type in ("slides", "minutes", "promo", "script")) | (kind != "paragraph") | F.substr(s, F.lit(1), F.length(before(s, ja.AI_CUT)) + 2).rlike(rf"(?:{'|'.join(ja.TE_NOT_VERB)})\z"),
    }

    def test(name: str, pattern: str):
        return lambda s: s.rlike(pattern) & ~vetoes.get(name, lambda s: F.lit(False))(s)

    rows = rows.withColumn("parts", parts)
    words = F.filter(F.array(*[F.when(F.exists("parts", test(n, p)), F.lit(n)) for n, p in ja.AI_FORMS.items()]), lambda x: x.isNotNull())
    # in the order of their sentences
    place = lambda w: reduce(lambda a, np: F.when(w == np[0], F.array_position(F.transform("parts", test(*np)), True)).otherwise(a), ja.AI_FORMS.items(), F.lit(0).cast("long"))
    names = list(ja.AI_FORMS)
    rank = lambda w: F.array_position(F.array(*[F.lit(n) for n in names]), w)
    sorted_ = F.transform(F.array_sort(F.transform(words, lambda w: F.struct(place(w).alias("p"), rank(w).alias("r"), w.alias("w")))), lambda x: x["w"])
    rows = rows.withColumn("found", sorted_).filter(F.size("found") > 0)
    return _found(rows, "ai_phrase", "info", F.array_join("found", "、"), F.col("found"))


def dialogue(lines: DataFrame, least: int = 10, share: float = 0.5) -> DataFrame:
    """Documents with enough lines of speech of which many end in a full stop, at the first of them."""
    rows = lines.filter(F.col("is_body") & ~F.col("kind").isin("heading_underline", "thematic_break")).withColumn("t", F.regexp_replace("visible", r"__|\*", ""))
    quoted = F.when(F.col("t").rlike("[「『]"), top_quotes(F.col("t"))).otherwise(F.array().cast("array<string>"))
    name, said = F.regexp_extract("t", ja.SPEAKER, 1), F.regexp_replace(strip(F.regexp_extract("t", ja.SPEAKER, 2)), ja.STAGE_NOTE, "")
    spoken = F.when(F.size(quoted) > 0, quoted).when((name != "") & ~name.rlike(ja.NOT_SPEAKER), F.array(said)).otherwise(F.array().cast("array<string>"))
    spoken = F.filter(F.transform(spoken, strip), lambda x: x != "")
    rows = rows.withColumn("spoken", spoken).filter(F.size("spoken") > 0)
    got = rows.groupBy("doc_id").agg(F.sum(F.size("spoken")).alias("n"), F.sum(F.size(F.filter("spoken", lambda x: x.rlike(r"[。｡]\z")))).alias("stops"), F.min("line").alias("line"), F.min_by("raw", "line").alias("raw"))
    return _found(got.filter((F.col("n") >= least) & (F.col("stops") >= share * F.col("n"))), "dialogue_period", "info")


def project_terms(lines: DataFrame, flags: dict[str, str | None]) -> DataFrame:
    """Words a project has asked to avoid, with what to write instead; not where the replacement already stands."""
    if not flags:
        return lines.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in zip(COLUMNS, ("long", "string", "int", "string", "string", "array<string>", "string"), strict=True)])
    text = F.col("plain")
    for word, other in flags.items():
        if other and word in other:
            text = F.regexp_replace(text, fnd._quoted(other), "・")
    rows = lines.filter(~F.col("kind").isin("code") & (F.col("quote_depth") == 0)).withColumn("t", text)
    hits = fnd.lexicon_hits(rows, list(flags), "t")
    names = F.create_map(*[x for w, o in flags.items() for x in (F.lit(w), F.lit(o).cast("string"))])
    return _found(hits, "project_term", "info", F.array_join(F.filter(F.transform("words", lambda w: names[w]), lambda x: x.isNotNull()), ", "), F.col("words"))


def _kept_lines(docs: DataFrame, wide: bool) -> DataFrame:
    """The lines of docs with the columns of the rules, parsed once and kept on the executors' disks.

    A text that is the same as the line itself, as most are, is kept as a null.
    """
    same = ["visible", "unquoted", "scan", "plain"]
    lines = scan_columns(parse_documents(docs).select("doc_id", F.inline("lines")))
    lines = lines.withColumn("is_wide", F.col("raw").rlike(WIDE) if wide else F.lit(False))
    kept = lines.withColumns({c: F.nullif(F.col(c), F.col("raw")) for c in same}).persist(StorageLevel.DISK_ONLY)
    return kept.withColumns({c: F.coalesce(c, "raw") for c in same})


def lint(docs: DataFrame, flags: dict[str, str | None] | None = None, allowed: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, metrics, lines) of docs (doc_id, text).  ``lines`` is kept for the rules."""
    # a finding of most rules needs a character of the range in its own line, so the filter loses none; rules that carry or
    # count something over lines need one somewhere in the document and see all lines of it; dashes begin below the range
    has_wide = F.coalesce(F.col("text").rlike(WIDE), F.lit(False))
    whole_wide, narrow = _kept_lines(docs.filter(has_wide), True), _kept_lines(docs.filter(~has_wide), False)
    lines, wide = whole_wide.unionByName(narrow), whole_wide.filter("is_wide")
    plain = lines.filter(~F.col("kind").isin([*NOT_TEXT, "table"]) & (F.col("quote_depth") == 0))
    listed = F.when(F.col("list_item"), F.regexp_extract("raw", r"^\s*(?:[-*+]|[0-9]+[.)])\s+", 0)).otherwise("")
    metrics = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(fnd.doc_metrics(plain.withColumn("visible", F.when(listed != "", F.concat(listed, F.ltrim("visible"))).otherwise(F.col("visible"))), "visible"), "doc_id", "left").na.fill(0)
    metrics = metrics.persist(StorageLevel.DISK_ONLY)  # a row per document
    negative = negations(wide, whole_wide)
    whole = fnd.metric_rules(metrics).select("doc_id", "rule", "line", "severity", F.lit("").alias("label"), F.array().cast("array<string>").alias("words"), F.lit("").alias("snippet"))
    parts = [
        whole, endings(whole_wide), bold(docs), emoji(wide), dashes(lines), middle_dots(wide), one_sentence(wide), headings(wide, metrics), colons(lines), vocabulary(wide), metaphors(wide), sentence_patterns(wide),
        negative, densities(lines, negative), of_course(whole_wide), fragments(whole_wide), residues(whole_wide), cleft_lists(whole_wide), noun_chains(wide), listed_terms(wide), shapes(wide), ai_phrases(wide), narrative(lines), dialogue(whole_wide), project_terms(lines, flags or {}),
    ]
    found = reduce(DataFrame.unionByName, [p.select(*[F.col(c) for c in COLUMNS]) for p in parts])
    if allowed:
        found = fnd.allow_by_rule(found, allowed, ja.ALLOW_RULES, ja.ALLOW_PARTIAL)
    return found, metrics, lines


def envelope(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts by severity, no_rule_findings, penalty_score, metrics."""
    found, metrics, _ = lint(docs, **options)
    return fnd.scores(found, metrics).join(metrics, "doc_id")
