"""WARC archives and vector near-dedup."""

import base64
import collections
import hashlib
import io
import os
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from pepspark.llm import embeddings, warc

PAGES = "page_id long, url string, html string"


def expect_pages(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "") if len(data) >= least else None
        to = None if to == i else to
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, tmp_path, least):
    random.seed(1)
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i % 7)} page {i % 40}</p>" * (i % 5)) for i in range(150)]
    rows += [(200, None, None), (201, "http://a\r\nWARC-Type: x", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "no id"), (None, "u", rows[7][2]), (202, "big", "z" * 3_000_000), (203, "", "hot")]
    rows += [(300 + i, "h", "hot") for i in range(60)] + [(203, "", "hot")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], PAGES + ", sha string, n int").repartition(4)
    manifest = warc.write_archives(df, str(tmp_path.as_uri()), least_bytes=least, archive_size=2_000)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect()]
    assert sorted(got, key=str) == sorted(expect_pages(rows, least), key=str)
    files = manifest.collect()
    assert sum(r.records for r in files) == len(rows) and all(os.path.getsize(r.path) == r.bytes for r in files) and len(files) > 4
    empty = warc.write_archives(df.filter("false"), str((tmp_path / "none").as_uri()))
    assert warc.read_archives(empty).count() == 0


def test_archive_format():
    """The file is a skippable frame with the dictionary, then frames that open one by one with it."""
    records = [warc.page_record(i, "http://x", b"<html>same words again and again %d</html>" % i, "D" * 32, None, "2020-01-01T00:00:00Z") for i in range(300)]
    parts = list(warc.archive_bytes(records))
    magic, size = struct.unpack("<II", parts[0][:8])
    assert magic == 0x184D2A5D and size == len(parts[0]) - 8
    words = zstandard.ZstdCompressionDict(parts[0][8:])
    assert [zstandard.ZstdDecompressor(dict_data=words).decompress(p) for p in parts[1:]] == records
    assert sum(map(len, parts[1:])) < sum(map(len, records)) / 3
    assert [block.partition(b"\r\n\r\n")[2] for _, block in warc.read_archive(io.BytesIO(b"".join(parts)))][7] == b"<html>same words again and again 7</html>"
    few = list(warc.archive_bytes(records[:1]))
    assert len(list(warc.read_archive(io.BytesIO(b"".join(few))))) == 1


VECTORS = "vec_id long, embedding array<double>, label int"


def expect_vectors(rows, least):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    links = collections.defaultdict(set)
    for i, (_, a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if good[i] and good[j] and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    label = {}
    for i in range(len(rows)):
        if i not in label:
            stack = [i]
            label[i] = i
            while stack:
                for j in links[stack.pop()]:
                    if j not in label:
                        label[j] = i
                        stack.append(j)
    smallest = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            smallest[label[i]] = min(smallest.get(label[i], vec), vec)
    return [(rows[i][0], len(links[i]), smallest.get(label[i]), rows[i][0] == smallest.get(label[i])) for i in range(len(rows))]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for _ in range(40):
        base = rng.normal(size=16)
        for k in range(int(rng.integers(1, 8))):
            rows.append((n, (base + rng.normal(size=16) * 0.12 * k).tolist(), n % 3))
            n += 1
    dense = rng.normal(size=16)
    rows += [(1000 + i, (dense + rng.normal(size=16) * 0.3).tolist(), 0) for i in range(60)] + [(2000 + i, dense.tolist(), 0) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, [None] + [1.0] * 15, 0), (3004, [nan] * 16, 0), (3005, [inf] + [0.0] * 15, 0)]
    rows += [(3006, [1.0, 2.0], None), (3007, [2.0, 4.0], 0), (3008, [1e-300] * 16, 0), (3009, [1e300] * 16, 0), (3010, [-0.0] + [1.0] * 15, 0), (3011, [0.0] + [1.0] * 15, 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"kind": F.lit("k"), "node": F.lit(1), "dim": F.lit(2)})
    for tile in (4096, 50):
        got = [tuple(r) for r in embeddings.near_duplicates(df, 0.9, tile).collect()]
        want = expect_vectors(rows, 0.9)
        assert sorted(set(got) - set(want), key=str) == sorted(set(want) - set(got), key=str)
        assert sorted(got, key=str) == sorted(want, key=str)
    assert embeddings.near_duplicates(df.filter("false")).count() == 0


def test_bounds_are_rigorous():
    rng = np.random.default_rng(5)
    for size in (2, 8, 64, 300):
        x = rng.normal(size=(200, size)) ** 3
        unit = x / np.sqrt((x**2).sum(1, keepdims=True))
        codes, scale, length, error = embeddings.quantize(unit)
        decoded = codes * scale[:, None]
        gap = np.abs(unit @ unit.T - decoded @ decoded.T)
        assert (gap <= error[:, None] + length[:, None] * error[None] + 1e-12).all()
        got = {(int(i), int(j)) for p, q in embeddings.compare(x, x, 0.7, strip=64) for i, j in zip(p, q, strict=True)}
        cosine = (x @ x.T) / np.sqrt((x**2).sum(1))[:, None] / np.sqrt((x**2).sum(1))[None]
        sure = np.abs(cosine - 0.7) > 1e-12
        assert {(i, j) for i, j in got if sure[i, j]} == {(int(i), int(j)) for i, j in zip(*np.nonzero((cosine >= 0.7) & sure), strict=True)}
