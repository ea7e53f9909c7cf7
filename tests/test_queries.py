"""Every registered query with SQL against DuckDB on the smallest tables, and none of them empty for nothing."""

import difflib
import os
import random

import duckdb
import pyarrow as pa
import pytest

from textloom import queries as core
from textloom.operators import matching
from tools_compare import TABLES, canonical

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
#: Too few rows fit at this scale; they have some on the larger tables.
EMPTY = {"section_sizes"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    got, want = core.QUERIES[name](spark, DIR).toPandas(), con.execute(core.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(got) or name in EMPTY


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_alignment(spark):
    """Op codes turn one text into the other; changed endings are pairs of unlike kinds."""
    rows = core.dff.opcodes(spark.createDataFrame([(1, "abcdef", "abXdefg"), (2, None, "a")], "pair_id long, orig string, rewrite string")).collect()
    built = "".join("abcdef"[r.i1 : r.i2] if r.tag == "equal" else "abXdefg"[r.j1 : r.j2] for r in sorted(rows, key=lambda r: r.seq) if r.pair_id == 1)
    assert built == "abXdefg"
    pairs = spark.createDataFrame([(1, "設定を確認してください。次に保存します。", "設定を確認します。次に保存します。")], "pair_id long, orig string, rewrite string")
    sentences = core.dff.side_sentences(pairs)
    got = core.dff.ending_changes(sentences, core.dff.ending_kind(core.F.col("sentence"))).collect()
    assert [(r.orig_kind, r.rewrite_kind) for r in got] == [("依頼", "動作（〜します）")]


def test_heading_pairs(spark):
    orig, rewrite = "# 概要\n\n## 手順の説明\n\n## 手順の説明\n\n結果\n---\n", "# 概要\n\n### 手順の説明\n\n## 手順を説明\n\n## 追加\n"
    rows = core.dff.headings(spark.createDataFrame([(4, orig, rewrite)], "pair_id long, orig string, rewrite string"))
    assert [(r.side, r.level, r.shown) for r in sorted(rows.collect(), key=lambda r: (r.side, r.line))][3] == ("orig", 2, "結果")
    got = {(r.orig_line, r.rewrite_line) for r in core.dff.heading_pairs(rows).collect()}
    assert got == {(1, 1), (3, 3), (5, 5), (7, None), (None, 7)}
    r = core.dff.heading_shapes(rows).first()
    assert (r.removed, r.added, r.relevelled, r.first_removed, r.levels_orig, r.levels_rewrite) == (1, 1, 1, ["結果"], "1222", "1322")


def test_bigram_pairing_of_whole_texts(spark):
    """All pairs against brute force; an item inside a document with another beginning is found."""
    assert "bigram_pairing" in core.QUERIES
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    want, sets = {}, {d: pairs(t or "") for d, t in docs}
    for i, t in items:
        a = pairs(t)
        scores = [(len(a & b) / len(a | b), -d, d, len(a & b), len(a | b)) for d, b in sets.items() if a & b and len(a & b) >= 0.2 * len(a | b)]
        if scores:
            want[i] = max(scores)[2:]
    got = {r.l_id: (r.r_id, r.both, r.union) for r in core.bigram_pairing(spark, DIR).collect()}
    assert got == want
    left = spark.createDataFrame([(1, "the quick brown fox 🎉é"), (2, "zz"), (3, None)], "id long, text string")
    right = spark.createDataFrame([(9, "Oh, the quick brown fox 🎉é"), (7, "Oh, the quick brown fox 🎉é"), (None, "Oh, the quick brown fox 🎉é"), (4, "the"), (5, ""), (6, None)], "id long, text string")
    assert [(r.l_id, r.r_id, r.both, r.union) for r in core.dff.best_texts(left, right).collect()] == [(1, 7, 21, 25)]
    assert core.dff.best_texts(left.limit(0), right).count() == 0


def test_matching_is_that_of_difflib(monkeypatch):
    """The same operations and the same nearest text, with tables and without, also for long equal runs."""
    rng = random.Random(1)
    for n in range(400):
        a, b = ("".join(rng.choice("ab c語🎉"[: 2 + n % 5]) for _ in range(rng.randint(0, 40))) for _ in "ab")
        if n % 9 == 0:
            b = a * 3
        want = difflib.SequenceMatcher(None, a, b, autojunk=False)
        monkeypatch.setattr(matching, "TABLE", (1 << 24, 200)[n % 2])
        assert matching.Matcher(a, b).get_opcodes() == want.get_opcodes() and matching.Matcher(a, b).ratio() == want.ratio()
    for n in range(200):
        *olds, new = ("".join(rng.choice("ab cd") for _ in range(rng.randint(0, 12))) for _ in range(6))
        olds = list(dict.fromkeys(olds))
        ratios = [difflib.SequenceMatcher(None, a, new, autojunk=False).ratio() for a in olds]
        k = max(range(len(olds)), key=lambda i: (ratios[i], -i))
        assert matching.nearest(olds, new, 0.45) == ((k, ratios[k]) if ratios[k] >= 0.45 else (-1, 0.0))


def test_alignment_in_bounded_batches(spark):
    """A batch of many pairs is handed back in parts, and sentences don't go to Python pair by pair."""
    pairs = spark.range(300).select(core.F.col("id").alias("pair_id"), core.F.repeat(core.F.lit("ab"), 60).alias("orig"), core.F.repeat(core.F.lit("ac"), 60).alias("rewrite")).coalesce(1)
    batch = pa.RecordBatch.from_pydict({"pair_id": [*range(300)], "orig": ["ab" * 60] * 300, "rewrite": ["ac" * 60] * 300})
    sizes = [b.num_rows for b in core.dff.opcodes_stage([batch])]
    assert max(sizes) == 5_000 and sum(sizes) == core.dff.opcodes(pairs).count() == 300 * 120
    changes = core.dff.ending_changes(core.dff.side_sentences(pairs), core.F.col("sentence"))
    assert "FlatMapGroups" not in changes._jdf.queryExecution().toString() and changes.count() == 300


def test_runs_take_one_window(spark):
    """The third of a run counts once, and one window finds it."""
    rows = spark.createDataFrame([(1, n, k) for n, k in enumerate(["a", "a", "a", "a", None, "b", "b", None, None, None, "c", "c", "c"])], "doc_id long, seq int, k string")
    runs = core.seg.ending_runs(rows, core.F.col("k"), ["doc_id"])
    assert {r.seq for r in runs.collect()} == {2, 12}
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
