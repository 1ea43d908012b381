import gzip
import hashlib
import io
import random
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, prose

from tessera.llm import embeddings, warc
from tessera.llm.common import components, new_path

VECTORS = "vec_id long, embedding array<float>, label int, code string, mult long"


def brute(rows, threshold=0.98):
    ok = [i for i, (_, v, la) in enumerate(rows) if la is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].add(j)
    low = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return Counter((rows[i][0], len(links[i]), low[i]) for i in range(len(rows)))


def clusters(seed, dim=16, n=12):
    rng = np.random.RandomState(seed)
    rows = []
    for c in range(n):
        base = rng.randn(dim)
        for _ in range(rng.randint(1, 30 if c == 0 else 6)):
            rows.append((len(rows), (base + rng.randn(dim) * rng.choice([0.0, 0.02, 0.06])).tolist(), int(c % 3)))
    return rows


@pytest.mark.parametrize("block", [4, 1024])
def test_embeddings_equal_brute_force(spark, block):
    nan, inf = float("nan"), float("inf")
    rows = clusters(4) + [(900, None, 1), (901, [0.0] * 16, 1), (902, [nan] + [1.0] * 15, 1), (903, [inf] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [], 1), (906, [1.0] * 16, None), (907, [1.0] * 16, None), (908, [1.0] * 8, 1), (909, [2.0] * 8, 1), (910, [1e30] * 8, 1)]
    rows += [rows[0], (None, [5.0] * 8, 2)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], VECTORS)
    out = embeddings.near_duplicates(frame, block=block).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_embeddings_recall(spark):
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    want, got = brute(rows), Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect())
    links = lambda c: sum(k[1] * n for k, n in c.items())
    assert links(got) >= 0.9 * links(want)


def test_components_of_long_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 7), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(5, 60) if i in got} == {5}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


PAGES = "page_id long, url string, html string, digest string, first long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], PAGES)


def round_trip(frame, **kw):
    return warc.reassemble(warc.read_archives(warc.write_pages(frame, new_path(frame.sparkSession, "warc"), **kw)))


def test_pages_come_back(spark):
    big = prose(1, 20_000)
    rows = [(1, "http://a/é x", big), (2, None, big), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "x" * 99), (6, "http://e", "x" * 99), (7, "u", "é" * 60), (8, "u", "é" * 60), (8, "u", "é" * 60), (None, "v", "é" * 60), (9, "w", "a\r\n\r\n0\r\n\r\n" * 2000)]
    whole = round_trip(pages(spark, rows), segment=300, file_bytes=2_000)
    out = warc.page_records(whole).collect()
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        again = len(raw) >= 100 and ids and i != min(ids)
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(ids) if again else None] += 1
    assert Counter(map(tuple, out)) == want
    payloads = Counter(bytes(r["payload"]) for r in whole.where("type = 'response'").collect())
    assert payloads[big.encode()] == 1 and payloads[b"a\r\n\r\n0\r\n\r\n" * 2000] == 1
    assert warc.page_records(round_trip(pages(spark, []))).count() == 0


def test_archive_places():
    assert warc.located("s3a://bucket/x") == "s3://bucket/x" and warc.located("hdfs://host:8020/x") == "hdfs://host:8020/x" and warc.located("/x") == "/x"


def test_a_missing_segment_is_reported(spark):
    frame = pages(spark, [(1, "http://a", prose(1, 2_000)), (2, "http://b", "small")])
    found = warc.read_archives(warc.write_pages(frame, new_path(spark, "warc"), segment=500))
    rows = {r["record_id"]: r for r in warc.reassemble(found.where("coalesce(segment, 0) <> 3")).collect()}
    assert sorted((r["valid"], r["payload"] is None) for r in rows.values()) == [(False, True), (True, False)]


def test_chunks():
    rng = random.Random(1)
    for n in (0, 1, 4_096, 10_000):
        raw = rng.randbytes(n)
        assert warc.dechunked(warc.chunked(raw)) == raw
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab")


def test_records_of_plain_and_zipped_streams():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for raw in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3), b""):
        got = [b for _, b in warc.records(io.BytesIO(raw))]
        assert got == [b"abc"] * (3 if raw else 0)
