r"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write_monolithic`` writes records the way some crawlers leave them: one gzip stream per file, so that no record can
be reached without inflating all before it.  ``normalise`` inflates such a file once, in a stream, rewrites every
record as a gzip member of its own and writes an offset index beside the archive; on the way it turns records whose
payload another record already holds into revisit records.  ``read_archives`` follows the indexes.

Files hold about ``most`` bytes of payload, so a file is a bounded piece of work; records pass through one at a time.

Cases: a null html is an empty payload; a null url gives a record without target; line ends in an url are escaped; a
null page_id is kept as null and counts as smallest; rows with equal page_id and payload are told apart by their place
in the archives, one of them is the response; an empty table gives no archives and an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import by_file, filesystem, remove, run_dir, salted_join, settle, write_file

RECORDS = "shard long, number long, page_id long, payload_bytes long, payload_digest string"
PLACES = "shard long, number long, page_id long, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, shard long, offset long"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_TAIL = b"\r\n\r\n"


def record_id(page_id, shard: int, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{shard}:{number}')}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + _TAIL


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields of a record, without its version line; names in lower case."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:] if x)}


def mono_name(home: str, shard: int) -> str:
    return f"{home}/mono/{shard:012d}.warc.gz"


def archive_name(home: str, shard: int) -> str:
    return f"{home}/warc/{shard:012d}.warc.gz"


def index_name(home: str, shard: int) -> str:
    return archive_name(home, shard) + ".idx"


def _write_mono(home: str, date: str, most: int, level: int):
    def write(batches):
        task, number, size, rows, chunks, squeeze = TaskContext.get().partitionId(), 0, 0, [], [], None

        def flush():
            nonlocal number, size, rows, chunks, squeeze
            shard = task * 1_000_000 + number
            write_file(mono_name(home, shard), [*chunks, squeeze.flush()])
            cols = [*zip(*rows, strict=True)]
            number, size, rows, chunks, squeeze = number + 1, 0, [], [], None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "number", "page_id", "payload_bytes", "payload_digest"])

        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url"), batch.column("html"), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                shard, digest = task * 1_000_000 + number, sha1_base32(payload)
                target = [("WARC-Target-URI", url.as_py().replace("\r", "%0D").replace("\n", "%0A"))] if url.is_valid else []
                heads = [("WARC-Record-ID", record_id(page, shard, len(rows))), ("WARC-Date", date), *target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8")]
                squeeze = squeeze or zlib.compressobj(level, zlib.DEFLATED, 31)
                chunks.append(squeeze.compress(record("response", heads, payload)))
                rows.append((shard, len(rows), page, len(payload), digest))
                size += len(payload) + 500
                if size >= most:
                    yield flush()
        if rows:
            yield flush()

    return write


def write_monolithic(pages: DataFrame, home: str, date: str = "2024-01-01T00:00:00Z", most: int = 64 << 20, level: int = 1) -> DataFrame:
    """Writes the archives below ``home``; shard, number, page_id, payload_bytes, payload_digest of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return settle(rows.mapInArrow(_write_mono(home, date, most, level), RECORDS), f"{home}/records")


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """records with first_page, first_shard, first_number: the record each one repeats, null for responses."""
    of = F.struct("page_id", "shard", "number")
    same = records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max(of).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = salted_join(records, same, ["payload_digest", "payload_bytes"], F.xxhash64("shard", "number"), "left")
    other = F.col("first").isNotNull() & ~(F.col("first") == of) & ~((F.col("first.shard") == F.col("shard")) & (F.col("first.number") == F.col("number")))
    at = lambda c: F.when(other, F.col(f"first.{c}"))
    return found.select(*records.columns, at("page_id").alias("first_page"), at("shard").alias("first_shard"), at("number").alias("first_number"))


def inflate(source, size: int = 1 << 20):
    """Records of a gzip file as (head, block), whatever its members are."""
    data, squeeze = bytearray(), zlib.decompressobj(31)
    at = 0
    raw = source.read(size)
    while raw or len(data) > at:
        end = data.find(b"\r\n\r\n", at)
        if end >= 0:
            head = bytes(data[at:end])
            need = int(parse_head(head)["content-length"])
            if len(data) >= end + 4 + need + 4:
                yield head, bytes(data[end + 4 : end + 4 + need])
                at = end + 4 + need + 4
                continue
        if not raw:
            raise ValueError("the archive ends within a record")
        del data[:at]
        at = 0
        while raw:
            data += squeeze.decompress(raw)
            raw = squeeze.unused_data
            if squeeze.eof:
                squeeze = zlib.decompressobj(31)
            else:
                break
        raw = source.read(size)


def _normalise(home: str, level: int):
    def rewrite(table: pa.Table) -> pa.Table:
        rows = table.sort_by("number").to_pylist()
        shard = rows[0]["shard"]
        fs, path = filesystem(mono_name(home, shard))
        lines, places, at = [], [], 0

        def members():
            nonlocal at
            with fs.open_input_stream(path, compression=None) as source:
                for row, (head, block) in zip(rows, inflate(source), strict=True):
                    had = parse_head(head)
                    heads = [(n, had[n.lower()]) for n in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "Content-Type") if n.lower() in had]
                    heads += [("X-Page-Id", str(row["page_id"]))] * (row["page_id"] is not None) + [("X-Payload-Length", str(len(block)))]
                    kind = "response" if row["first_number"] is None else "revisit"
                    if kind == "revisit":
                        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(row["first_page"], row["first_shard"], row["first_number"]))]
                        heads += [("X-Refers-To-Page-Id", str(row["first_page"]))] * (row["first_page"] is not None)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(kind, heads, block if kind == "response" else b"")) + squeeze.flush()
                    lines.append(f"{row['number']} {at} {len(member)} {kind}\n")
                    places.append((at, len(member)))
                    at += len(member)
                    yield member

        write_file(archive_name(home, shard), members())
        write_file(index_name(home, shard), ["".join(lines).encode()])
        return pa.table({"shard": pa.array([r["shard"] for r in rows], pa.int64()), "number": pa.array([r["number"] for r in rows], pa.int64()), "page_id": pa.array([r["page_id"] for r in rows], pa.int64()), "offset": pa.array([p[0] for p in places], pa.int64()), "length": pa.array([p[1] for p in places], pa.int64())})

    return rewrite


def normalise(records: DataFrame, home: str, level: int = 4) -> DataFrame:
    """Rewrites every monolithic file of ``records`` (with its revisits) member by member; the places of all records."""
    files = records.agg(F.countDistinct("shard")).first()[0]
    places = settle(by_file(records, "shard", files).groupBy("shard").applyInArrow(_normalise(home, level), PLACES), f"{home}/places")
    remove(f"{home}/mono")
    return places


def _read(home: str):
    def read(batches):
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "shard", "offset"]
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                fs, path = filesystem(index_name(home, shard))
                with fs.open_input_stream(path, compression=None) as f:
                    index = [x.split() for x in f.read().decode().splitlines()]
                fs, path = filesystem(archive_name(home, shard))
                rows = []
                with fs.open_input_file(path) as f:
                    for _, offset, length, _ in index:
                        f.seek(int(offset))
                        head, _, block = zlib.decompress(f.read(int(length)), 31).partition(_TAIL)
                        x = parse_head(head)
                        block, digest = block[: -len(_TAIL)], x["warc-payload-digest"].removeprefix("sha1:")
                        if x["warc-type"] == "response" and (sha1_base32(block) != digest or len(block) != int(x["x-payload-length"])):
                            raise ValueError(f"the payload at {offset} in {path} is damaged")
                        page, other = x.get("x-page-id"), x.get("x-refers-to-page-id")
                        rows.append((page and int(page), int(x["x-payload-length"]), digest, x["warc-type"], other and int(other), x.get("warc-target-uri"), shard, int(offset)))
                        if len(rows) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return read


def read_archives(shards: DataFrame, home: str) -> DataFrame:
    """Every record of the archives named by ``shards`` (column shard), found by the index beside each archive."""
    names = shards.select("shard").distinct()
    return by_file(names, "shard", names.count()).mapInArrow(_read(home), READ)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    home = run_dir(spark, "warc")
    records = write_monolithic(spark.read.parquet(f"{sf_dir}/pages.parquet"), home)
    places = normalise(revisits(records), home)
    return read_archives(places, home).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of a SHA-1: 160 bits are 32 letters of 5 bits; each 5 hex digits (20 bits) make 4 letters
ORACLE = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
x AS (SELECT page_id, strlen(p) AS n, sha1(p) AS hex, max(page_id) OVER (PARTITION BY p) AS top FROM d),
v AS (
  SELECT page_id, g, list_sum([(instr('0123456789abcdef', substr(hex, 5 * g + k + 1, 1)) - 1) * (16 ** (4 - k))::BIGINT FOR k IN range(5)])::BIGINT AS v
  FROM x, (SELECT unnest(range(8)) AS g)
), b AS (
  SELECT page_id, string_agg(array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // (32 ** (3 - j))::BIGINT % 32 + 1)::INT, 1) FOR j IN range(4)], ''), '' ORDER BY g) AS b
  FROM v GROUP BY page_id
)
SELECT page_id, n::BIGINT AS payload_bytes, b AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM x JOIN b USING (page_id)
"""
