"""Readers, Markdown structure and conformance on small cases."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import spans
from textloom.operators.markdown import inline_spans, parse
from textloom.plans import conform
from textloom.sources import texts


def test_decode(spark):
    rows = [(1, b"a\r\nb"), (2, "﻿x\ny".encode()), (3, b"\xff\xfe"), (4, b""), (5, b"a\rb\nc"), (6, "😀".encode())]
    got = {r.id: r for r in texts.decode(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert (got[1].text, got[1].eol, got[1].bom) == ("a\nb", "crlf", False)
    assert (got[2].text, got[2].eol, got[2].bom) == ("x\ny", "lf", True)
    assert got[3].text is None and got[4].text == "" and got[4].eol == "none" and got[5].eol == "mixed" and got[6].text == "😀"


def test_files_and_paths(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert texts.read_files(spark, str(tmp_path), "*.md").count() == 1
    rows = spark.createDataFrame([("a/b.md",), ("/etc/x",), (".git/x",), ("-",), ("a/../b",)], "path string")
    assert [r.ok for r in rows.select(texts.admissible(F.col("path")).alias("ok")).collect()] == [True, False, False, True, False]
    assert texts.batch_paths(rows, spark.createDataFrame([("-",)], "path string")).count() == 4


def test_physical_lines_are_the_text(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\n\nc\r"), (2, ""), (3, "😀x\ny")], "doc_id long, text string")
    rows = sorted(texts.physical_lines(docs).collect(), key=lambda r: (r.doc_id, r.line))
    for d in docs.collect():
        own = [r for r in rows if r.doc_id == d.doc_id]
        assert "".join(r.raw + r.ending for r in own) == d.text
        assert all(d.text[r.start : r.start + len(r.raw)] == r.raw for r in own)


def test_front_matter_and_lists(spark):
    docs = spark.createDataFrame([(1, "---\nname: x\ntrigger: a: b\nname: y\n---\nbody"), (2, "body\n---\nname: z\n---"), (3, "---\n---")], "doc_id long, text string")
    got = {r.doc_id: r for r in texts.front_matter(texts.text_lines(docs)).collect()}
    assert set(got) == {1, 3} and got[1].entries == {"name": "y", "trigger": "a: b"} and got[1].last == 5 and got[3].entries == {}
    words = spark.createDataFrame([(1, "# comment\n\nfoo\tbar\n baz \n")], "doc_id long, text string")
    assert [(r.word, r.replacement) for r in texts.word_list(texts.text_lines(words)).collect()] == [("foo", "bar"), ("baz", None)]
    index = spark.createDataFrame([(1, "### Rules\n| `a-b` | first |\n|---|---|\n| `c` | second |\n### Other\n| `d` | x |")], "doc_id long, text string")
    assert [(r.row_no, r.name, r.summary) for r in texts.index_table(texts.text_lines(index), "Rules").collect()] == [(1, "a-b", "first"), (2, "c", "second")]


KINDS = [
    ("# a\n\nb", "heading blank paragraph"), ("a\n===", "heading heading_underline"), ("> a\nb", "quote quote"), ("- a\n  b\n\nc", "list list blank paragraph"),
    ("```\nx\n```\ny", "code code code paragraph"), ("````\n```\n````", "code code code"), ("~~~\nx", "code code"), ("    x", "code"), ("a\n    b", "paragraph paragraph"),
    ("a | b\n--|--\nc | d\ne", "table table table paragraph"), ("<div>\na\n\nb", "html_block html_block blank paragraph"), ("---\na: b\n---\nc", "frontmatter frontmatter frontmatter paragraph"),
    ("***", "thematic_break"), ("[a]: http://b.c\nd", "reference_definition paragraph"), ("<!-- a\nb -->\nc", "html_block html_block paragraph"), ("1. a\n2. b", "list list"), ("", "blank"),
]


@pytest.mark.parametrize(("text", "kinds"), KINDS)
def test_line_kinds(text, kinds):
    assert [r["kind"] for r in parse(text)[0]] == kinds.split()


SPANS = [
    ("a `b` c", [(2, 5, "inline_code")]), ("``a`b``", [(0, 7, "inline_code")]), ("`a", []), (r"\*a", [(0, 2, "escape")]), ("[a](b)", [(3, 6, "link_destination")]), ("![a](b)", [(0, 7, "image")]),
    ("<http://a.b>", [(0, 12, "autolink")]), ("<b>x</b>", [(0, 3, "html_token"), (4, 8, "html_token")]), ("see http://a.b/c). ok", [(4, 16, "bare_url")]), ("www.a.b", [(0, 7, "bare_url")]), ("xwww.a.b", []),
]


@pytest.mark.parametrize(("text", "want"), SPANS)
def test_inline_spans(text, want):
    assert inline_spans(text) == want


def test_visible_text_keeps_places():
    text = "a😀 `b` [c](http://d.e)\n> *f* <i>g</i>\n\n- h"
    lines, found = parse(text)
    assert all(len(r["visible"]) == len(r["raw"]) for r in lines) and all(0 <= s["s"] < s["e"] <= len(text) for s in found)


def test_long_table_is_scanned_in_a_line():
    lines, _ = parse("| a |\n|---|\n| b |\n\n" * 3000)
    assert sum(r["kind"] == "table" for r in lines) == 9000


def test_merge_and_overlap(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (2, 1, 2), (1, 8, 12)], "doc_id long, s long, e long")
    assert sorted((r.doc_id, r.s, r.e) for r in spans.merge_spans(rows).collect()) == [(1, 0, 5), (1, 7, 12), (2, 1, 2)]
    ranges = spark.createDataFrame([(1, 5, 7), (1, 4, 6), (2, 2, 4)], "doc_id long, lo long, hi long")
    assert [(r.doc_id, r.lo) for r in spans.overlapping(ranges, rows).collect()] == [(1, 4)]


RULE = "---\ntrigger: x\ndescription: y\n---\n# Do\n## 対象外\n- none\n"


def test_conformance(spark):
    files = [
        ("rules/good.md", "rule", "good", RULE), ("rules/Bad_Name.md", "rule", "Bad_Name", "text\n" * 31), ("skills/s", "skill", "s", "---\nname: s\ndescription: d\n---\nx"), ("skills/t", "skill", "t", None),
        ("skills/u", "skill", "u", "---\nname: other\n---\n"),
    ]
    rows = spark.createDataFrame(files, "path string, kind string, name string, text string")
    got = {(r.path, r.message) for r in conform.rule_files(rows).unionByName(conform.skill_files(rows)).collect()}
    assert not [g for g in got if g[0] in ("rules/good.md", "skills/s")]
    assert {m for p, m in got if p == "rules/Bad_Name.md"} == {"name is not lower case letters, digits and hyphens", "no front matter", "too many lines", "no heading", "no scope section"}
    assert ("skills/t", "no document") in got and ("skills/u", "name differs from the folder") in got and ("skills/u", "no description") in got
    plans = spark.createDataFrame([(1, "- [x] a\n状態: 進行中"), (2, "- [ ] a"), (3, "- [x] a\n状態: 完了"), (4, "text")], "doc_id long, text string")
    assert {r.doc_id: r.problem for r in conform.plan_status(texts.text_lines(plans)).collect()} == {1: "all items checked but still running", 2: "no status line"}
    damaged = spark.createDataFrame([(1, "ok\n<<<<<<< x\nfine\n=======\n�")], "doc_id long, text string")
    assert conform.damaged_lines(texts.text_lines(damaged)).count() == 3
    changes = spark.createDataFrame([(1, "M", "a"), (1, "D", "b"), (2, "A", "c")], "id int, status string, path string")
    assert {r.id: r.structural for r in conform.structural(changes, "id").collect()} == {1: True, 2: False}


def test_index_rows_and_ids(spark):
    text = "### Rules\n| name | what |\n|---|---|\n| `a` | 1 |\n| `d` | 2 |\n\n### Other\n| `b` | x |"
    docs = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in conform.insert_row(docs, "Rules", "c", "new").collect()}
    assert got[1].split("\n")[3:6] == ["| `a` | 1 |", "| `c` | new |", "| `d` | 2 |"] and got[2] == "none"
    assert conform.insert_row(docs, "Rules", "z", "new").filter("doc_id = 1").first().text.split("\n")[5] == "| `z` | new |"
    assert conform.insert_row(docs, "Rules", "a", "new").filter("doc_id = 1").first().text == text
    names = spark.createDataFrame([("good",), ("Bad",), ("a",)], "name string")
    files = spark.createDataFrame([("a",)], "name string")
    assert {r.name: r.problem for r in conform.name_problems(names, files).collect()} == {"Bad": "not lower case letters, digits and hyphens", "a": "exists already"}
    side = lambda t: spark.createDataFrame([(t,)], "text string")
    assert {(r.name, r.problem) for r in conform.id_sync(side("R-1 R-2"), side("x R-2 R-3"), r"R-[0-9]+").collect()} == {("R-1", "unlisted"), ("R-3", "orphan")}
    assert [r.id for r in conform.unresolved(spark.createDataFrame([('[{"id":"a","isResolved":true},{"id":"b"}]',)], "raw string"), "raw").collect()] == ["b"]


def test_built_in_list(spark, tmp_path):
    """A file replaces the list; a missing one leaves it, and so does one that is no UTF-8, with a problem."""
    from textloom.operators.report import built_in_list

    (tmp_path / "good.txt").write_text("# words\none\ntwo\tother\n")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    rows = lambda path: sorted((r.word or "", r.problem is not None) for r in built_in_list(spark, ["own"], path).collect())
    assert rows(None) == rows(str(tmp_path / "none.txt")) == [("own", False)]
    assert rows(str(tmp_path / "good.txt")) == [("one", False), ("two", False)]
    assert rows(str(tmp_path / "bad.txt")) == [("", True), ("own", False)]
