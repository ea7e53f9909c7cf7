"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Every stage works on all rows that the one before it kept, and its output is written and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.op6_mixing import mix_stage
from textloom.llm.op7_ngram_join import near_stage
from textloom.llm.op8_quality_rules import rules_stage
from textloom.llm.op9_packing import packing_stage
from textloom.llm.op10_line_dedup import line_dedup_stage
from textloom.llm.store import RUNS, remove, run_dir, sweep

STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizing can't be said in SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Once a stage is written, its own folders and its input's copy are removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = run_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        made = len(RUNS)
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{number}")
        docs = spark.read.parquet(f"{home}/{number}")
        sweep(made)
        remove(f"{home}/{number - 1}")
    return docs
