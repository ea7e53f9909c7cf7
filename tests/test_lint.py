"""Japanese rules on hand-written cases: (case, text, rule, whether it must be found).  Golden, not recomputed."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.operators import findings as fnd
from textloom.operators.markdown import inline_spans
from textloom.plans import rules_ja as ja
from textloom.plans.lint import envelope, lint

LONG = "これは十分な長さの段落です。" * 30
CASES = [
    ("emoji+", "完了🎉しました。", "emoji_prohibited", True),
    ("emoji-code", "`🎉` を使う。", "emoji_prohibited", False),
    ("dash-list", "速さ、軽さ、静けさ──。", "dash_list_ending", True),
    ("dash-insert", "今日——正確には昨日——連絡しました。", "dash_insertion", True),
    ("dash-deco", "これは試作品——。", "dash_decoration", True),
    ("dash-source", "—— 出典：白書", "dash_decoration", False),
    ("dash-diagram", "├── src", "dash_decoration", False),
    ("dot+", "作成・推敲を行う。", "nakaguro_parallel", True),
    ("dot-name", "ウォルト・ディズニーの作品。", "nakaguro_parallel", False),
    ("one+", "これは一文目。これは二文目。", "one_sentence_per_line", True),
    ("one-", "これは一文だけ。", "one_sentence_per_line", False),
    ("one-quote", "「はい。そうです。」と答えた。", "one_sentence_per_line", False),
    ("summary+", "## まとめ\n\n本文です。", "short_summary_heading", True),
    ("summary-", "## 概要\n\n本文です。", "short_summary_heading", False),
    ("bracket+", "## 結果（概要）", "redundant_bracket", True),
    ("bracket-", "本文の結果（概要）", "redundant_bracket", False),
    ("colon+", "次のとおり：", "trailing_colon", True),
    ("colon-code", "値は `a:`", "trailing_colon", False),
    ("slop+", "等身大の言葉で書く。", "slop_vocabulary", True),
    ("slop-mention", "「等身大」という語。", "slop_vocabulary", False),
    ("slop-shape", "意思決定のOSを持つ。", "slop_vocabulary", True),
    ("slop-quote", "> 等身大の言葉", "slop_vocabulary", False),
    ("verb+", "仕様が壊れる。", "metaphor_verb", True),
    ("verb-", "窓が割れる。", "metaphor_verb", False),
    ("filler+", "重要なのは、速さだ。", "meta_filler", True),
    ("filler-", "速さが重要だ。", "meta_filler", False),
    ("restate+", "まとめると、速い。", "summary_restatement", True),
    ("intro+", "本記事では手順を示す。", "meta_intro", True),
    ("count+", "理由は3つあります。", "count_declaration", True),
    ("not-but+", "量ではなく質を選ぶ。", "negative_parallelism", True),
    ("not-but-also", "量ではなく質でもある。", "negative_parallelism", False),
    ("not-this+", "これは努力じゃない、仕組みです。", "negative_parallelism", True),
    ("nor+", "車でも、家でもない。有頂天だ。", "negative_parallelism", True),
    ("nor-lines", "車でも、\n家でも\nない。有頂天だ。", "negative_parallelism", True),
    ("nor-blocks", "車でも、\n\n家でもない。有頂天だ。", "negative_parallelism", False),
    ("nor-idiom", "車でも、何でもない。有頂天だ。", "negative_parallelism", False),
    ("nor-denied", "車でも、家でもない。船もない。", "negative_parallelism", False),
    ("nor-image", "車でも、\n![図](a.png)\n家でもない。有頂天だ。", "negative_parallelism", False),
    ("nor-linked", "車でも、\n[![図](a.png)](b(c(d)))\n家でもない。有頂天だ。", "negative_parallelism", False),
    ("nor-quote", "車でも、\n家「船」でもない。有頂天だ。", "negative_parallelism", True),
    ("dense+", "量ではなく質だ。\n\n紙ではなく板だ。\n\n昼ではなく夜だ。", "negative_parallelism_density", True),
    ("dense-", "量ではなく質だ。\n\n紙ではなく板だ。", "negative_parallelism_density", False),
    ("label+", "- **甲**: 一\n- **乙**: 二\n- **丙**: 三", "bold_label_list", True),
    ("course+", "速い。\nもちろん、失敗もする。", "short_mochiron", True),
    ("course-answer", "もちろん、大丈夫です。", "short_mochiron", False),
    ("course-question", "失敗しますか。\nもちろん、失敗もする。", "short_mochiron", False),
    ("fragment+", "効く。\n重い。\n安い。", "fragment_run", True),
    ("fragment-", "効く。\nとても重い荷物を運ぶ。\n安い。", "fragment_run", False),
    ("chain+", "品質の評価の基準の策定を進める。", "noun_chain", True),
    ("chain-", "春の山の花を見る。", "noun_chain", False),
    ("katakana+", "新しいソリューションを示す。", "katakana_term", True),
    ("katakana-number", "マイルストーン1を終える。", "katakana_term", False),
    ("renyo+", "結果の確かめを行う。", "renyo_noun", True),
    ("renyo-kin", "育ての親に会う。", "renyo_noun", False),
    ("renyo-verb", "扉の入れやすい形。", "renyo_noun", False),
    ("thin+", "本体の質感も上質です。", "thin_evaluation", True),
    ("thin-comma", "軽いので、質感も上質です。", "thin_evaluation", False),
    ("hedge+", "有効と言えるでしょう。", "say_hedge", True),
    ("hedge-noun", "契約と言えるでしょう。", "say_hedge", False),
    ("verbs+", "読む、書く、直す。", "bare_verb_chain", True),
    ("verbs-count", "一つ、二つ、三つ。", "bare_verb_chain", False),
    ("ending+", "準備です。\n実行です。\n確認です。", "sentence_end_repetition", True),
    ("ending-", "準備です。\n実行です。\n\n確認です。", "sentence_end_repetition", False),
    ("bold+", LONG + "**甲** **乙** **丙**", "excess_bold", True),
    ("bold-", LONG + "**甲**", "excess_bold", False),
    ("list+", LONG + "\n\n- 一\n- 二\n- 三", "excess_list", True),
    ("narrative+", "数は 1 と 2 と 3 と 4 と 5 と 6 と 7 と 8 と 9 と 10 です。" + "文章が続きます。" * 130, "narrative_density", True),
    ("narrative-", "文章が続きます。" * 130, "narrative_density", False),
    ("dash-nested", "彼は「それは『静か──重い』だ」と言う。", "dash_decoration", False),
    ("copy+", "静かな、夜。", "copy_comma_noun", True),
    ("copy-particle", "条件を残した、出力。", "copy_comma_noun", False),
    ("copy-reply", "はい、了解。", "copy_comma_noun", False),
    ("dialogue+", "\n\n".join(f"「{c}だと思う。」" for c in "一二三四五六七八九十"), "dialogue_period", True),
    ("dialogue-few", "\n\n".join(f"「{c}だと思う。」" for c in "一二三四五六七八九"), "dialogue_period", False),
    ("dialogue-names", "\n\n".join(f"ハル：{c}だと思う。（笑う）" for c in "一二三四五六七八九十"), "dialogue_period", True),
    ("dialogue-stop", "\n\n".join(f"「{c}だと思う」" for c in "一二三四五六七八九十"), "dialogue_period", False),
    ("residue-style", "この記事では、専門用語を使わず説明します。", "instruction_residue", True),
    ("residue-scope", "本記事では設定を扱いません。", "instruction_residue", True),
    ("residue-limit", "要点に絞って紹介します。", "instruction_residue", True),
    ("residue-same", "本記事では設定を扱いません（付録を参照）。", "instruction_residue", False),
    ("residue-next", "本記事では設定を扱いません。\n付録を参照してください。", "instruction_residue", False),
    ("residue-far", "本記事では設定を扱いません。\n\n付録を参照してください。", "instruction_residue", True),
    ("residue-reader", "この手順書では設定に触れず説明します。", "instruction_residue", False),
    ("residue-plain", "箱に絞って書く。", "instruction_residue", True),
    ("residue-novel", "彼は静かなトーンで書く。", "instruction_residue", False),
    ("cleft+", "今回の改修で増えたのは、画面、帳票、通知。", "cleft_list_ending", True),
    ("cleft-predicate", "今回の改修で増えたのは、画面、帳票、通知です。", "cleft_list_ending", False),
    ("cleft-two", "目指したのは、速さ、軽さ。", "cleft_list_ending", False),
    ("cleft-joined", "増えたのは、画面と帳票、通知。", "cleft_list_ending", True),
    ("cleft-phrase", "残ったのは、父と母の笑顔。", "cleft_list_ending", False),
    ("cleft-named", "画面が増えた。\n今回増えたのは、画面、帳票、通知。", "cleft_list_ending", False),
    ("cleft-above", "## 何が増えたか\n\n増えたのは、画面、帳票、通知。", "cleft_list_ending", False),
    ("cleft-broken", "画面が増\nえた。今回増えたのは、画面、帳票、通知。", "cleft_list_ending", False),
    ("cleft-table", "| 増 |\n|---|\n| 増 |\n\n増えたのは、画面、帳票、通知。", "cleft_list_ending", True),
    ("cleft-asked", "変わった点は？\n増えたのは、画面、帳票、通知。", "cleft_list_ending", False),
    ("cleft-other", "速い。\n増えたのは、画面、帳票、通知。", "cleft_list_ending", True),
    ("code", "```\n重要なのは、等身大——。\n```", "slop_vocabulary", False),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "doc_id long, text string")
    rows, _, lines = lint(docs)
    got = {(r.doc_id, r.rule): r for r in rows.collect()}
    lines.unpersist()
    return got


@pytest.mark.parametrize("n", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rule(found, n):
    _, _, rule, want = CASES[n]
    assert ((n, rule) in found) is want


def test_lines_of_findings(found):
    at = {c[0]: n for n, c in enumerate(CASES)}
    assert found[at["dense+"], "negative_parallelism_density"].line == 5
    assert found[at["label+"], "bold_label_list"].line == 1
    assert found[at["ending+"], "sentence_end_repetition"].line == 3
    assert found[at["fragment+"], "fragment_run"].line == 1


def test_lines_over_breaks(found):
    at = {c[0]: n for n, c in enumerate(CASES)}
    assert found[at["nor-lines"], "negative_parallelism"].line == 1


def test_nested_destinations():
    inner = "b" + "(c" * 32 + ")" * 32
    assert inline_spans("[a](b(c(d)e)f) g") == [(3, 14, "link_destination")]
    assert inline_spans(f"[a]({inner})") == [(3, 5 + len(inner), "link_destination")]
    assert inline_spans(f"[a]((x{inner}))") == [] and inline_spans("[a](" + "(b" * 5000) == []


def test_envelope(spark):
    docs = spark.createDataFrame([(1, "量ではなく質を選ぶ。"), (2, "速い。"), (3, None), (4, "仕様が壊れる。")], "doc_id long, text string")
    rows = {r.doc_id: r for r in envelope(docs).collect()}
    assert len(rows) == 4
    assert rows[2].penalty_score == 100 and rows[2].no_rule_findings and rows[3].penalty_score == 100
    assert rows[4].warn == 1 and rows[4].penalty_score == 95  # one warning in a short text
    assert rows[1].info == 1 and rows[1].penalty_score == 98


def test_allow_and_project_terms(spark):
    docs = spark.createDataFrame([(1, "等身大の触媒。"), (2, "サーバを使う。"), (3, "サーバーを使う。")], "doc_id long, text string")
    rows, _, _ = lint(docs, flags={"サーバ": "サーバー"}, allowed=["等身大"])
    got = {(r.doc_id, r.rule, r.label) for r in rows.collect()}
    assert (1, "slop_vocabulary", "触媒") in got and (1, "slop_vocabulary", "等身大") not in got
    assert (2, "project_term", "サーバー") in got and not [g for g in got if g[0] == 3]


def test_allow_by_rule(spark):
    """A rule of single words loses them; another goes with its label or with all of its matches, else stays whole."""
    rows = [
        (1, "renyo_noun", "", ["確かめ", "入れ"]), (2, "renyo_noun", "", ["確かめ"]), (3, "metaphor_verb", "「壊れる」（物の動詞）", ["壊れる", "壊れた"]),
        (4, "metaphor_verb", "〜が走る", ["処理が走る", "検査が走る"]), (5, "metaphor_verb", "〜が走る", ["処理が走る"]), (6, "emoji_prohibited", "確かめ", ["確かめ"]),
        (7, "slop_vocabulary", "触媒", ["触媒"]), (8, "renyo_noun", "", []),
    ]
    found = spark.createDataFrame(rows, "doc_id long, rule string, label string, words array<string>")
    kept = fnd.allow_by_rule(found, ["確かめ", "壊れる", "処理が走る"], ja.ALLOW_RULES, ja.ALLOW_PARTIAL)
    assert {r.doc_id: r.words for r in kept.collect()} == {1: ["入れ"], 4: ["処理が走る", "検査が走る"], 6: ["確かめ"], 7: ["触媒"], 8: []}
    assert fnd.allow_by_rule(found, [], ja.ALLOW_RULES, ja.ALLOW_PARTIAL).count() == 8
    assert fnd.allow_by_rule(found.limit(0), ["x"], ja.ALLOW_RULES, ja.ALLOW_PARTIAL).count() == 0


def test_lines_without_wide_characters(spark):
    """Dashes below U+2300, an ASCII line that breaks a run of endings, ASCII lines of speech."""
    names = "\n\n".join(f"「{c}だと思う。」" for c in "一二三四五六七八九")
    texts = [
        "Foo — bar", "A — b — c", "one ― two", "準備です。\nThis one is plain.\n実行です。\n確認です。", "準備です。\n実行です。\n確認です。", f"{names}\n\nBob: ok", names,
        "\n\n".join(["「一だと思う。」"] * 6 + ["「二だと思う」"] * 4 + ["Bob: ok"] * 3),
    ]
    rows, _, lines = lint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r.doc_id, r.rule, r.line) for r in rows.collect() if r.rule.startswith("dash_") or r.rule in ("sentence_end_repetition", "dialogue_period")}
    lines.unpersist()
    assert got == {(0, "dash_decoration", 1), (1, "dash_insertion", 1), (2, "dash_decoration", 1), (4, "sentence_end_repetition", 3), (5, "dialogue_period", 1)}


def test_lines_stay_out_of_memory(spark):
    """Lines for the rules are kept on disk, those of documents without wide characters apart and equal texts once."""
    docs = spark.createDataFrame([(1, "速い。\nplain"), (2, "A `b` c\nplain"), (3, None)], "doc_id long, text string")
    _, metrics, lines = lint(docs)
    plan = lines._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") == 2 and plan.count("StorageLevel(disk, 1 replicas)") == 2
    got = {(r.doc_id, r.line): (r.raw, r.visible, r.scan, r.is_wide) for r in lines.collect()}
    assert got == {(1, 1): ("速い。",) * 3 + (True,), (1, 2): ("plain",) * 3 + (False,), (2, 1): ("A `b` c", "A     c", "A     c", False), (2, 2): ("plain",) * 3 + (False,), (3, 1): ("",) * 3 + (False,)}
    assert {r.doc_id: r.total_lines for r in metrics.collect()} == {1: 2, 2: 2, 3: 0}
    blanks = "　\x85\x1c   "
    assert spark.createDataFrame([(f"{blanks}a {blanks}b​{blanks}",)], "t string").select(strip(F.col("t"))).first()[0] == f"a {blanks}b​"
