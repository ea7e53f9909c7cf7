"""Original against rewrite: one row per pair in, one relation per question out.

Input: pairs(pair_id, orig, rewrite).  Everything here is DataFrame expressions but ``opcodes`` and
``ending_changes``, whose alignment is sequential within a pair and runs in one Arrow stage, and ``best_texts``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.operators.markdown import lines_of, parse_documents
from textloom.operators.matching import Matcher, nearest
from textloom.operators.segments import pieces

# What counts as a content word, a list row, a heading mark.
CONTENT = r"[一-龥々〆ヵヶ]{2,}|[ァ-ヴー]{2,}|[A-Za-z][A-Za-z0-9_.+#/-]+"
LIST_ROW = r"(?m)^[ \t]*(?:[*\-・]|[0-9]+[.)])[ \t]+"
HEADING_MARK = r"(?m)^#+[ \t]*"
# Pairs taken out of a batch at once, rows handed back at once.
SLICE, ROWS = 100, 5_000


def normal(text: Column) -> Column:
    """text without bold, list and heading marks, blanks squeezed."""
    text = F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1")
    text = F.regexp_replace(F.regexp_replace(text, LIST_ROW, ""), HEADING_MARK, "")
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def marker_changes(pairs: DataFrame, markers: dict[str, str]) -> DataFrame:
    """pair_id, kind, n_orig, n_rewrite of the kinds of marks whose numbers differ."""
    rows = [F.struct(F.lit(k).alias("kind"), F.regexp_count("orig", F.lit(p)).cast("long").alias("n_orig"), F.regexp_count("rewrite", F.lit(p)).cast("long").alias("n_rewrite")) for k, p in markers.items()]
    return pairs.select("pair_id", F.inline(F.array(*rows))).filter("n_orig <> n_rewrite")


def word_changes(pairs: DataFrame, words: str = CONTENT) -> DataFrame:
    """pair_id, new_words, lost_words: words of one side that are nowhere in the other one's text, sorted."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(words), F.lit(0)))
    out = pairs.select("pair_id", F.array_sort(F.filter(found(F.col("rewrite")), lambda w: ~F.contains("orig", w))).alias("new_words"), F.array_sort(F.filter(found(F.col("orig")), lambda w: ~F.contains("rewrite", w))).alias("lost_words"))
    return out.filter((F.size("new_words") > 0) | (F.size("lost_words") > 0))


def structure(pairs: DataFrame, ends: str = "。！？!?") -> DataFrame:
    """pair_id with paragraphs, sentences and lists of both sides; consecutive list rows are one paragraph."""

    def paragraphs(c: str) -> Column:
        rows = F.transform(F.split(c, "\n"), lambda x: F.when(strip(x) == "", "").when(x.rlike(LIST_ROW), "l").otherwise("p"))
        return F.size(F.filter(F.transform(rows, lambda x, i: (x == "p") | ((x == "l") & ((i == 0) | F.coalesce(F.get(rows, i - 1) != "l", F.lit(True))))), lambda x: x)).cast("long")

    sentences = lambda c: F.size(F.flatten(F.transform(F.split(c, r"\n+"), lambda x: pieces(x, ends)))).cast("long")
    listed = lambda c: F.col(c).rlike(LIST_ROW + r"\S")
    out = pairs.select("pair_id", *[f(c).alias(f"{n}_{c}") for n, f in (("paragraphs", paragraphs), ("sentences", sentences), ("has_list", listed)) for c in ("orig", "rewrite")])
    lost = F.col("has_list_orig") & ~F.col("has_list_rewrite")
    return out.withColumns({"list_dropped": lost, "paragraphs_merged": F.col("paragraphs_rewrite") < F.col("paragraphs_orig"), "sentences_changed": F.col("sentences_orig") != F.col("sentences_rewrite")})


def side_sentences(pairs: DataFrame, ends: str = "。！？!?") -> DataFrame:
    """pair_id, side, seq, sentence."""
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.flatten(F.transform(F.split(normal(F.col(c)), r"\n+"), lambda x: pieces(x, ends))).alias("parts")) for c in ("orig", "rewrite")])
    return pairs.select("pair_id", F.inline(sides)).select("pair_id", "side", F.posexplode("parts").alias("seq", "sentence"))


def logic_points(sentences: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """pair_id, side, seq, kind of the sentences that match a kind."""
    hits = F.filter(F.array(*[F.when(F.col("sentence").rlike(p), F.lit(k)) for k, p in kinds.items()]), lambda x: x.isNotNull())
    return sentences.select("pair_id", "side", "seq", F.explode(hits).alias("kind"))


# Kinds of Japanese sentence endings, tested in this order on the bare end of a sentence.
ENDINGS = [
    ("依頼", r"(ください(ね)?|(て|で)はいけません|(て|で)はなりません|ていただきます|ていただけます)\z"),
    ("勧め", r"(ましょう|とよいです|といいです|をおすすめします|をお勧めします)\z"),
    ("推量・考え", r"(でしょう|だろう|かもしれません|かもしれない|と思います|と考えます|と感じます|はずです|ようです|気がします)\z"),
    ("義務", r"(なければなりません|なくてはなりません|必要があります|べきです)\z"),
    ("評価", r"(重要|最重要|大切|大事|不可欠|肝心|肝要|欠かせません|鍵|カギ|最優先|必要)(です|でした|だ|である)?\z"),
    ("過去", r"(ました|でした|ませんでした)\z"),
    ("説明（〜ています）", r"(て|で)い(ます|ません)\z"),
    ("説明（〜ます）", r"(られ|[^しさ]れ|なり|あり|おり|でき|分かり|わかり|つながり|変わり|起き|起こり|生じ|増え|減り|見え|聞こえ|残り|続き|終わり|始まり|決まり|進み|遅れ|下回り|上回り|異なり|違い|限り|足り|合い|当たり|向き|似|伝わり|高まり|下がり|上がり|広がり|強まり|弱まり|落ち|壊れ|崩れ|外れ|漏れ|そろい|揃い|思え|感じられ|止まり|消え|困り|迷い|助かり|防げ|書け|読め|使え|言え|選べ|話せ|待て|探せ|直せ|残せ|減らせ|増やせ|守れ|作れ|取れ|気づけ)(ます|ません)\z"),
    ("動作（〜します）", r"(ます|ません)\z"),
    ("断定（〜です）", r"です\z"),
    ("常体", r"((だ|である|ではない|でない)|[るうくすつぬぶむぐたい])\z"),
]


def bare_end(sentence: Column) -> Column:
    """A sentence without marks, final stops and the bracketed remarks after them."""
    t = strip(F.regexp_replace(strip(F.regexp_replace(sentence, r"\*\*|`", "")), r"[。．.！!？?]+\z", ""))
    t = F.regexp_replace(t, r"(?:\s*[（(][^（）()]*[）)])+\z", "")
    return F.regexp_replace(t, r"[」』）)]+\z", "")


def ending_kind(sentence: Column) -> Column:
    t = bare_end(sentence)
    kind = F.when(t == "", "")
    for name, pattern in ENDINGS:
        kind = kind.when(t.rlike(pattern), name)
    return kind.otherwise("体言止めなど")


def ending_counts(sentences: DataFrame, kind: Column) -> DataFrame:
    """pair_id, side, kind, n, first_seq, place: the most frequent first, ties by first use."""
    rows = sentences.withColumn("kind", kind).groupBy("pair_id", "side", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(F.desc("n"), "first_seq")))


def comma_rates(pairs: DataFrame, comma: str = "、", ends: str = "。！？!?", more: int = 3, tenths: int = 3) -> DataFrame:
    """pair_id with commas and sentences of both sides and whether they rose by ``more`` and by tenths/10 a sentence.

    Rates are compared by cross-multiplication, so that no division rounds.
    """
    rows = side_sentences(pairs, ends).groupBy("pair_id").pivot("side", ["orig", "rewrite"]).agg(F.sum(F.regexp_count("sentence", F.lit(comma))).alias("c"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = rows.select("pair_id", zero("orig_c").alias("commas_orig"), zero("orig_n").alias("n_orig"), zero("rewrite_c").alias("commas_rewrite"), zero("rewrite_n").alias("n_rewrite"))
    rise = 10 * (F.col("commas_rewrite") * F.col("n_orig") - F.col("commas_orig") * F.col("n_rewrite")) >= tenths * F.col("n_orig") * F.col("n_rewrite")
    return out.withColumn("rose", (F.col("commas_rewrite") - F.col("commas_orig") >= more) & (F.col("n_orig") > 0) & (F.col("n_rewrite") > 0) & rise)


def _pair_codes(text: str) -> np.ndarray:
    """Distinct pairs of neighbouring characters as sorted numbers."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-1] << 21 | c[1:])


def _best_stage(ids: list[int], codes: list[np.ndarray], least: float, step: int = 1_000):
    """The best right row of a batch for each item, by a product of 0/1 tables over the items' pairs."""
    known, sizes = np.unique(np.concatenate([np.empty(0, np.int64), *codes])), np.array([len(c) for c in codes], np.int64)

    def best(batches):
        items = np.zeros((len(codes), len(known)), np.float32)
        for i, c in enumerate(codes):
            items[i, np.searchsorted(known, c)] = 1
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by([("id", "ascending")])  # nulls last
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                has, n = np.zeros((part.num_rows, len(known)), np.float32), np.zeros(part.num_rows, np.int64)
                for k, text in enumerate(part["text"].to_pylist()):
                    c = _pair_codes(text)
                    n[k] = len(c)
                    has[k, np.searchsorted(known, c[np.isin(c, known)])] = 1
                both = (items @ has.T).astype(np.int64)
                union = sizes[:, None] + n[None, :] - both
                score = np.where((both > 0) & (both * 1.0 >= least * union), both / np.maximum(union, 1), -1.0)
                top = score.argmax(axis=1)  # the first of equals has the smallest id
                r_ids = part["id"].to_pylist()
                hit = [(i, k) for i, k in enumerate(top.tolist()) if score[i, k] >= 0]
                cols = [[ids[i] for i, _ in hit], [r_ids[k] for _, k in hit], [int(both[i, k]) for i, k in hit], [int(union[i, k]) for i, k in hit], [float(score[i, k]) for i, k in hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["l_id", "r_id", "both", "union", "score"])

    return best


def best_texts(left: DataFrame, right: DataFrame, least: float = 0.2) -> DataFrame:
    """l_id, r_id, both, union: for each left row the right row with the highest bigram Jaccard, all pairs compared.

    left, right: (id, text).  Ties go to the smaller r_id.  left is a list of items that every task holds; right may be
    any table, and only the best row of each item and batch is moved.
    """
    items = left.select(F.col("id").cast("long"), "text").filter("text is not null").collect()
    stage = _best_stage([r[0] for r in items], [_pair_codes(r[1]) for r in items], least)
    rows = right.select(F.col("id").cast("long").alias("id"), "text").filter("text is not null")
    got = rows.mapInArrow(stage, "l_id long, r_id long, both long, union long, score double") if items else rows.limit(0).selectExpr("id l_id", "id r_id", "id both", "id union", "0D score")
    best = got.groupBy("l_id").agg(F.max(F.struct("score", (-F.col("r_id")).alias("neg"), "r_id", "both", "union")).alias("x"))
    return best.select("l_id", "x.r_id", "x.both", "x.union")


CHANGES = ("orig", "orig_kind", "rewrite", "rewrite_kind")


def _ratio_stage(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            out = []
            for row in batch.slice(low, SLICE).to_pylist():
                olds: dict[str, dict] = {}
                for r in row["orig"]:
                    olds.setdefault(r["sentence"], r)
                texts = list(olds)
                for r in row["rewrite"]:
                    best = olds.get(r["sentence"])
                    if best is None and (k := nearest(texts, r["sentence"], 0.45)[0]) >= 0:
                        best = olds[texts[k]]
                    if best and best["kind"] != r["kind"]:
                        out.append((row["pair_id"], best["sentence"], best["kind"], r["sentence"], r["kind"]))
            cols = [*zip(*out, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 4), strict=True)], ["pair_id", *CHANGES])


def ending_changes(sentences: DataFrame, kind: Column) -> DataFrame:
    """Rewritten sentences whose most similar original (ratio 0.45 or more, the first of equals) ends in another kind."""
    rows = sentences.withColumn("kind", kind).select(F.col("pair_id").cast("long").alias("pair_id"), "side", F.struct("seq", "sentence", "kind").alias("x"))
    side = lambda c: F.array_sort(F.collect_list(F.when(F.col("side") == c, F.col("x")))).alias(c)
    return rows.groupBy("pair_id").agg(side("orig"), side("rewrite")).mapInArrow(_ratio_stage, "pair_id long, " + ", ".join(f"{c} string" for c in CHANGES))


def headings(pairs: DataFrame) -> DataFrame:
    """pair_id, side, line, level, shown, key of the headings of both texts; key is the title without blanks, in small letters."""
    sides = pairs.select("pair_id", F.posexplode(F.array("orig", "rewrite")).alias("n", "text"))
    rows = lines_of(parse_documents(sides.select((F.col("pair_id") * 2 + F.col("n")).alias("doc_id"), "text")))
    under = F.lead("raw").over(Window.partitionBy("doc_id").orderBy("line"))
    next_kind = F.lead("kind").over(Window.partitionBy("doc_id").orderBy("line"))
    rows = rows.withColumns({"under": F.when(next_kind == "heading_underline", under)}).filter("kind = 'heading'")
    marks = F.length(F.regexp_extract("raw", r"^\s*(#{1,6})(?:\s|\z)", 1))
    level = F.when(marks > 0, marks).when(F.col("under").contains("="), 1).when(F.col("under").isNotNull(), 2)
    shown = strip(F.regexp_replace("raw", r"^\s*#{1,6}(?:\s+|\z)|\s+#+\s*\z", ""))
    out = rows.withColumns({"level": level, "shown": shown}).filter("level is not null")
    return out.select(F.expr("doc_id div 2").alias("pair_id"), F.when(F.col("doc_id") % 2 == 0, "orig").otherwise("rewrite").alias("side"), "line", "level", "shown", F.lower(F.regexp_replace("shown", r"[\s　*`]+", "")).alias("key"))


def _pairs_of(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)}


def _pair_headings(table: pa.Table) -> pa.Table:
    """Equal titles in order first; then the most alike (bigram Jaccard of 0.2 or more), each heading once."""
    rows = table.sort_by("line").to_pylist()
    left, right = ([r for r in rows if r["side"] == s] for s in ("orig", "rewrite"))
    free, found = list(range(len(right))), []
    rest = []
    for i, a in enumerate(left):
        j = next((j for j in free if a["key"] and right[j]["key"] == a["key"]), None)
        if j is None:
            rest.append(i)
        else:
            free.remove(j)
            found.append((i, j))
    score = []
    for i in rest:
        for j in free:
            a, b = _pairs_of(left[i]["key"]), _pairs_of(right[j]["key"])
            if a | b and 5 * len(a & b) >= len(a | b):
                score.append((-len(a & b) / len(a | b), i, j))
    for _, i, j in sorted(score):
        if i in rest and j in free:
            rest.remove(i)
            free.remove(j)
            found.append((i, j))
    out = [(rows[0]["pair_id"], left[i], right[j]) for i, j in sorted(found)] + [(rows[0]["pair_id"], left[i], None) for i in rest] + [(rows[0]["pair_id"], None, right[j]) for j in free]
    get = lambda x, c: None if x is None else x[c]
    cols = [[p for p, _, _ in out], *[[get(x[k], c) for x in out] for k in (1, 2) for c in ("line", "level", "shown")]]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in HEADING_PAIRS.split(", ")])


HEADING_PAIRS = "pair_id long, orig_line int, orig_level int, orig string, rewrite_line int, rewrite_level int, rewrite string"


def heading_pairs(rows: DataFrame) -> DataFrame:
    """headings -> matched, removed (no rewrite) and added (no orig) headings of each pair."""
    return rows.select(F.col("pair_id").cast("long").alias("pair_id"), "side", "line", F.col("level").cast("int").alias("level"), "shown", "key").groupBy("pair_id").applyInArrow(_pair_headings, HEADING_PAIRS)


def heading_shapes(rows: DataFrame) -> DataFrame:
    """pair_id with the numbers of headings removed, added and moved to another level, the first three removed, and the levels of both sides."""
    got = heading_pairs(rows)
    gone = F.col("rewrite_line").isNull()
    return got.groupBy("pair_id").agg(
        F.count_if(gone).alias("removed"), F.count_if(F.col("orig_line").isNull()).alias("added"), F.count_if(F.col("orig_level") != F.col("rewrite_level")).alias("relevelled"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(gone, F.struct("orig_line", "orig")))), lambda x: x["orig"]), 1, 3).alias("first_removed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("orig_line").isNotNull(), F.struct("orig_line", "orig_level")))), lambda x: x["orig_level"].cast("string")), "").alias("levels_orig"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rewrite_line").isNotNull(), F.struct("rewrite_line", "rewrite_level")))), lambda x: x["rewrite_level"].cast("string")), "").alias("levels_rewrite"),
    )


OPCODES = "pair_id long, seq int, tag string, i1 int, i2 int, j1 int, j2 int"


def _opcode_batch(out: list[tuple]) -> pa.RecordBatch:
    cols = [*zip(*out, strict=True)] or [[]] * 7
    kinds = (pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in OPCODES.split(", ")])


def opcodes_stage(batches):
    """Handed back in parts, since a pair may have as many operations as characters and a batch thousands of pairs."""
    for batch in batches:
        out = []
        for low in range(0, batch.num_rows, SLICE):
            part = batch.slice(low, SLICE)
            for p, a, b in zip(*(part.column(c).to_pylist() for c in ("pair_id", "orig", "rewrite")), strict=True):
                for k, op in enumerate(Matcher(a or "", b or "").get_opcodes()):
                    out.append((p, k, *op))
                    if len(out) == ROWS:
                        yield _opcode_batch(out)
                        out = []
        yield _opcode_batch(out)


def opcodes(pairs: DataFrame) -> DataFrame:
    """pair_id, seq, tag, i1, i2, j1, j2: how the characters of orig become those of rewrite."""
    return pairs.select(F.col("pair_id").cast("long").alias("pair_id"), "orig", "rewrite").mapInArrow(opcodes_stage, OPCODES)


# ---- endings by stance -----------------------------------------------------------------------------------------
LIST_MARK = r"^(?:[*\-・]|\d+[.)])\s+"


def ending_units(texts: DataFrame, kind=ending_kind, markdown: bool = False, ends: str = "。！？!?", *keep: str) -> DataFrame:
    """doc_id, seq, where, sentence, kind, whole of the units whose ending counts.

    A list row is a unit of its own, a dash ends one too.  With ``markdown`` code and front matter are left out and the
    cells of tables are units, marked as such; else table rows are left out.  A unit without an ending kind, and a bare
    noun before a dash, are none.  ``whole``: it ends in a stop, or at a dash.
    """
    rows = texts.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("t", strip("raw"))
    if markdown:
        by = Window.partitionBy("doc_id").orderBy("line")
        whole = Window.partitionBy("doc_id")
        opened = F.max((F.col("line") == 0) & (F.col("t") == "---")).over(whole)
        close = F.min(F.when((F.col("line") > 0) & (F.col("raw") == "---"), F.col("line"))).over(whole)
        rows = rows.withColumn("body", ~(opened & close.isNotNull() & (F.col("line") <= close)))
        fence = F.col("body") & F.col("t").startswith("```")
        rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(by)).filter(F.col("body") & ~fence & (F.col("fences") % 2 == 0))
    table = F.col("t").startswith("|")
    rows = rows.filter((F.col("t") != "") & ~F.col("t").startswith("#") & (F.col("t") != "---"))
    rows = rows.filter(~table | ~F.col("t").rlike(r"^[|\-: ]*\z")) if markdown else rows.filter(~table)
    listed = F.col("t").rlike(LIST_MARK)
    where = F.when(table, "表").when(listed, "箇条書き").otherwise("地の文")
    cells = F.transform(F.split(F.regexp_replace("t", r"^\|+|\|+\z", ""), r"\|"), strip)
    sources = F.when(table, cells).otherwise(F.array(F.regexp_replace("t", LIST_MARK, "")))
    sentences = F.flatten(F.transform(sources, lambda x: pieces(x, ends)))

    def cut(sentence: Column) -> Column:
        parts = F.transform(F.split(sentence, "[—―]{1,2}", -1), strip)
        return F.transform(parts, lambda p, n: F.struct(p.alias("sentence"), (n == F.size(parts) - 1).alias("last"), sentence.rlike(f"[{ends}]\\z").alias("stopped")))

    rows = rows.select("doc_id", *keep, "line", where.alias("where"), F.posexplode(F.flatten(F.transform(sentences, cut))).alias("pos", "x")).select("*", "x.*").withColumn("kind", kind(F.col("sentence")))
    rows = rows.filter((F.col("sentence") != "") & (F.col("kind") != "") & (F.col("last") | (F.col("kind") != "体言止めなど")))
    seq = F.struct("line", "pos").alias("seq")
    return rows.select("doc_id", *keep, seq, "where", "sentence", "kind", (F.col("stopped") | ~F.col("last")).alias("whole"))


def register(sentence: Column) -> Column:
    """Polite or plain ending; empty for a noun and the like."""
    t = bare_end(sentence)
    plain = t.rlike(r"(?:だ|である|ではない|でない)\z") | (t.rlike(r"[るうくすつぬぶむぐたい]\z") & ~t.rlike(r"[ァ-ヴー一-龥A-Za-z0-9]\z"))
    return F.when(t.rlike(r"(?:です|ます|ません|ました|でした|ましょう|ください|でしょう)\z"), "敬体").when(plain, "常体").otherwise("")


ACT, ASK, ADVICE, VALUE = "動作（〜します）", ["勧め", "依頼"], "勧め", "評価"
STANCES = {"勧め": "勧め", "読み手に勧める": "勧め", "決まり": "決まり", "手順": "決まり", "説明": "説明", "報告": "説明", "体験": "説明"}


def stance_flags(units: DataFrame, stance: str | None = None, polite=register) -> DataFrame:
    """doc_id, flag, sentences: endings that don't fit the stance of a text, and the rarer of two registers.

    Flags: act_in_advice, advice_in_rules, advice_in_report (the last unit may hold one), act_and_ask, act_and_value,
    plain_in_polite, polite_in_plain.
    """
    kind, prose = F.col("kind"), F.col("where") != "表"
    act, ask, value = prose & (kind == ACT), prose & kind.isin(ASK), prose & (kind == VALUE)
    spoken = F.when(prose & F.col("whole"), polite(F.col("sentence")))
    rows = units.withColumns({"act": act, "ask": ask, "advice": prose & (kind == ADVICE), "value": value, "spoken": spoken})
    last = F.col("seq") == F.max("seq").over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("inner_ask", F.col("ask") & ~last)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("seq", "sentence")))), lambda x: x["sentence"])
    by = {"act": F.col("act"), "ask": F.col("ask"), "advice": F.col("advice"), "value": F.col("value"), "inner": F.col("inner_ask"), "plain": F.col("spoken") == "常体", "formal": F.col("spoken") == "敬体"}
    got = rows.groupBy("doc_id").agg(*[listed(c).alias(n) for n, c in by.items()])
    some = lambda c: F.size(c) > 0
    flag = lambda test, name, said: F.when(test, F.struct(F.lit(name).alias("flag"), said.alias("sentences")))
    stance = STANCES.get(stance, stance) if stance else None
    if stance == "勧め":
        flags = [flag(some("act"), "act_in_advice", F.col("act"))]
    elif stance == "決まり":
        flags = [flag(some("advice") | some("value"), "advice_in_rules", F.concat("advice", "value"))]
    elif stance == "説明":
        flags = [flag(some("inner"), "advice_in_report", F.col("inner"))]
    else:
        flags = [flag(some("act") & some("ask"), "act_and_ask", F.concat("act", "ask")), flag(some("act") & ~some("ask") & some("value"), "act_and_value", F.concat("act", "value"))]
    flags += [flag(some("plain") & (F.size("formal") > F.size("plain")), "plain_in_polite", F.col("plain")), flag(some("formal") & (F.size("plain") > F.size("formal")), "polite_in_plain", F.col("formal"))]
    return got.select("doc_id", F.inline(F.filter(F.array(*flags), lambda x: x.isNotNull())))


def moved_sentences(sentences: DataFrame) -> DataFrame:
    """pair_id, sentence, orig_seq, rewrite_seq: equal sentences of both sides, each used once, first with first."""
    nth = F.row_number().over(Window.partitionBy("pair_id", "side", "sentence").orderBy("seq"))
    rows = sentences.select("pair_id", "side", "seq", "sentence", nth.alias("nth"))
    a, b = rows.filter("side = 'orig'"), rows.filter("side = 'rewrite'").withColumnRenamed("seq", "rewrite_seq").drop("side")
    return a.join(b, ["pair_id", "sentence", "nth"]).select("pair_id", "sentence", F.col("seq").alias("orig_seq"), "rewrite_seq")


def kinds_changed(marks: DataFrame) -> DataFrame:
    """pair_id, lost, added: kinds of marks (pair_id, side, kind) that one side has and the other hasn't, sorted."""
    got = marks.groupBy("pair_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("kind")))).alias(s) for s in ("orig", "rewrite")])
    out = got.select("pair_id", F.array_sort(F.array_except("orig", "rewrite")).alias("lost"), F.array_sort(F.array_except("rewrite", "orig")).alias("added"))
    return out.filter((F.size("lost") > 0) | (F.size("added") > 0))


def comma_sentences(sentences: DataFrame, comma: str = "、", least: int = 2, most: int = 5) -> DataFrame:
    """pair_id, seq, sentence, commas: the first ``most`` rewritten sentences with at least ``least`` commas."""
    n = F.regexp_count("sentence", F.lit(comma)).cast("long")
    rows = sentences.filter("side = 'rewrite'").withColumn("commas", n).filter(F.col("commas") >= least)
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("seq"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("pair_id", "seq", "sentence", "commas")
