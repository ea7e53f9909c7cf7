"""The per-document part of the plans over a stream: nothing here looks at a second row, so no state or watermark is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.findings import text_metrics
from textloom.operators.markdown import parse_documents
from textloom.operators.segments import pieces

DOCUMENT = "doc_id long, text string"


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENT, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def metrics(docs: DataFrame) -> DataFrame:
    return text_metrics(docs)


def sentences(docs: DataFrame, ends: str = "。！？") -> DataFrame:
    """doc_id, seq, sentence of each document."""
    return docs.select("doc_id", F.posexplode(F.flatten(F.transform(F.split("text", r"\r\n|\r|\n", -1), lambda x: pieces(x, ends)))).alias("seq", "sentence"))


def structure(docs: DataFrame) -> DataFrame:
    """doc_id, lines, spans by the Markdown stage."""
    return parse_documents(docs)


def write_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to parquet, each input file exactly once."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
