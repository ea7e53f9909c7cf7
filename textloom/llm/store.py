"""The shared folder: where operators write files that the driver and every executor can read.

The folder is ``spark.checkpoint.dir`` of the session.  Only a local session that has none gets a folder of its own
(tests); a cluster session without the setting is refused, because executors do not share their disks.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


#: Folders of this session that ``sweep`` has not removed yet.
RUNS: list[str] = []


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; its files outlive the call because the result is read from them lazily."""
    RUNS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return RUNS[-1]


def sweep(keep: int = 0) -> None:
    """Remove this session's folders but the first ``keep``: for callers that have written every result they need."""
    while len(RUNS) > keep:
        remove(RUNS.pop())


@atexit.register
def _last() -> None:
    """What a query still read from when the driver ended."""
    with contextlib.suppress(Exception):
        sweep()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow file system and path of a URI (file, hdfs, s3, gs, abfs); a bare path is a local one."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write chunks under a temporary name, then move: a retried or speculative task never leaves half a file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            n += out.write(chunk)
    fs.move(part, path)
    return n


def remove(uri: str) -> None:
    """Delete a folder that is no longer needed; a missing one is fine."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


#: Bytes of an Arrow batch that a settled stage hands to a Python worker at once.
BATCH = "16m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_DROP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, uri: str, drop: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors.

    drop: the shuffle files of the write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    own = {_BATCH_SETTING: BATCH} | ({_DROP_SETTING: "true"} if drop else {})
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(uri)


def carried(docs: DataFrame, *own: str) -> DataFrame:
    """docs with the columns ``own`` and all others in one struct, so that their names cannot clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*others) if others else F.lit(None)).alias("_carried"))


def restored(rows: DataFrame, columns: list[str], *own: str) -> list:
    """Expressions that give ``columns`` back after ``carried``."""
    return [F.col(c) if c in own else F.col("_carried").getField(c).alias(c) for c in columns]


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_file(rows: DataFrame, column: str, files: int) -> DataFrame:
    """rows dealt by the number of a file, a task for each of ``files``: the work follows the files' bytes, not the rows' size."""
    return rows.repartition(max(1, min(files, 20_000)), column)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt, how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join (nulls equal) whose left side may have hot keys and whose right side has one row per key.

    Left rows are dealt by key and ``salt`` (a column), right rows are repeated once per salt, so a key with a third
    of all rows is spread over ``salts`` tasks.  ``right`` must be small per key, not small as a whole.
    """
    a = left.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = a["_salt"] == b["_salt"]
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    joined = a.join(b, on, how)
    return joined.select(*[a[c] for c in left.columns], *[b[c] for c in right.columns if c not in keys])
