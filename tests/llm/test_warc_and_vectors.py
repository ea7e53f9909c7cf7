"""Archives and embeddings against brute-force versions."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest

from textloom.llm import graph, op1_warc, op4_embedding_forest
from textloom.llm.store import filesystem, run_dir


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(3)
    bodies = ["<p>" + "x" * r.randint(0, 400) + f"{i % 7}é</p>" for i in range(40)] + ["", None, "\r\n\r\n", "<b>\r\n\r\nContent-Length: 3\r\n\r\n", "z" * 70_000]
    rows = [(i, f"http://a.b/{i}" if i % 5 else None, r.choice(bodies)) for i in range(150)] + [(200, "http://x\r\ny", None), (201, "u", ""), (None, "u", "x"), (None, "u", bodies[0]), (7, "again", bodies[1]), (7, "again", bodies[1])]
    return spark.createDataFrame([(*x, "s", 1) for x in rows], "page_id long, url string, html string, shard string, offset int").repartition(3), rows


def written(table, least=0, most=20_000):
    home = run_dir(table.sparkSession, "w")
    records = op1_warc.write_monolithic(table, home, most=most)
    return home, op1_warc.normalise(op1_warc.revisits(records, least), home)


def test_round_trip(pages):
    table, rows = pages
    home, places = written(table)
    got = op1_warc.read_archives(places, home).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(p), len((h or "").encode()), digest(h)) for p, _, h in rows)
    top = {}
    for p, _, h in rows:
        top[digest(h)] = max(top.get(digest(h), -1), -1 if p is None else p)
    for d, page in top.items():
        own = [r for r in got if r.payload_digest == d]
        first = [r for r in own if r.record_type == "response"]
        assert len(first) == 1 and (-1 if first[0].page_id is None else first[0].page_id) == page
        assert all(r.refers_to == first[0].page_id for r in own if r.record_type == "revisit") and first[0].refers_to is None
    assert any(r.url == "http://x%0D%0Ay" for r in got)


def test_members_stand_alone(pages):
    """Each offset of the index opens one record, and the archive as a whole is a gzip file of all of them."""
    table, rows = pages
    home, places = written(table)
    shards = {r.shard for r in places.collect()}
    assert len(shards) > 3
    n = 0
    for shard in shards:
        fs, path = filesystem(op1_warc.archive_name(home, shard))
        with fs.open_input_file(path) as f:
            data = f.read()
        fs, path = filesystem(op1_warc.index_name(home, shard))
        with fs.open_input_file(path) as f:
            index = [x.split() for x in f.read().decode().splitlines()]
        whole = gzip.decompress(data)
        parts = [gzip.decompress(data[int(o) : int(o) + int(k)]) for _, o, k, _ in index]
        assert b"".join(parts) == whole and all(p.startswith(b"WARC/1.1\r\n") for p in parts)
        n += len(parts)
    assert n == len(rows)


def test_small_payloads_are_responses(pages):
    table, _ = pages
    home, places = written(table, least=100)
    got = op1_warc.read_archives(places, home).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100) and any(r.record_type == "revisit" for r in got)


def test_no_pages(pages):
    home, places = written(pages[0].limit(0))
    assert op1_warc.read_archives(places, home).count() == 0


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_inflate_in_any_steps(size):
    records = [op1_warc.record("response", [("X", str(i))], b"\r\n\r\n" * i) for i in range(6)]
    mono, members = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    for data in (mono, members):
        assert [b for _, b in op1_warc.inflate(io.BytesIO(data), size)] == [b"\r\n\r\n" * i for i in range(6)]
    with pytest.raises(ValueError):
        list(op1_warc.inflate(io.BytesIO(gzip.compress(b"".join(records)[:-9])), size))


def vectors(spark, n=600, seed=1):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 6, 16))
    rows = []
    for i in range(n):
        v = base[r.integers(len(base))] + r.standard_normal(16) * r.choice([0.05, 0.2, 0.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], "l"))
    rows += [(n, None, "l"), (n + 1, [0.0] * 16, "l"), (n + 2, [float("nan")] + [1.0] * 15, "l"), (n + 3, [None] + [1.0] * 15, "l"), (n + 4, [1.0, 2.0], "l"), (n + 5, [2.0, 4.0], "l"), (n + 6, [float("inf")] * 16, "l")]
    rows += [(n + 7 + k, rows[5][1], "l") for k in range(5)] + [rows[9], (None, rows[5][1], "l"), (n + 20, [], "l")]
    return rows


def brute(rows):
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    keep = [i for i, (k, v, _) in enumerate(rows) if k is not None and fine(v)]
    links, parent = {i: 0 for i in range(len(rows))}, {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(keep):
        for j in keep[:n]:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q, key=lambda x: rows[x][0])] = min(p, q, key=lambda x: rows[x][0])
    return sorted(((rows[i][0], links[i], rows[find(i)][0]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("options", [{"leaf_rows": 10_000}, {"leaf_rows": 60, "spill": 0.3}, {"leaf_rows": 10_000, "split": 50}])
def test_vectors(spark, options):
    rows = vectors(spark)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label string, n int, key string").repartition(4)
    got = op4_embedding_forest.near_vectors(table, **options).collect()
    have, want = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str), brute(rows)
    assert len(have) == len(want) and all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    found, there = sum(h[1] for h in have), sum(w[1] for w in want)
    assert all(h[1] <= w[1] for h, w in zip(have, want)), "a link below the threshold"
    assert there > 500 and found >= 0.9 * there
    if options["leaf_rows"] == 10_000:
        assert have == want
    assert op4_embedding_forest.near_vectors(table.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)] + [(500 + r.randrange(50), 500 + r.randrange(50)) for _ in range(30)] + [(-3, 900), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long"), run_dir(spark, "g")).collect()}
    want = {x: find(x) for x in parent if find(x) != x}
    assert {k: v for k, v in got.items() if k != v} == want
