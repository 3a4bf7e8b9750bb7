"""Vector search against brute force, archives by exact round trip."""

import gzip
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm.vectors import top_k
from riskloom.llm.warc import export_warc, parse_warc, read_records, read_warc, write_archive


def brute(rows, k):
    vectors = [(i, np.array([int(np.floor(256 * float(np.float32(x)))) for x in v], dtype=object)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % 5 == 0:
            best = sorted((-int((a * b).sum()), i) for i, b in vectors if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.0, 0.0, 0.1, -0.2]) for i in range(150)]  # one vector, a third of all
    rows += [(900, None), (905, [None] * 6), (910, [float("nan")] * 6), (915, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k, bits, block, chunk in ((5, 6, 2048, 1 << 16), (3, 2, 16, 90), (1, 10, 20, 40)):
        got = sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0, k=k, bits=bits, block=block, chunk=chunk).collect()))
        assert got == brute(rows, k)
    few = df.filter("vec_id < 3")
    assert sorted(map(tuple, top_k(few, F.col("vec_id") % 5 == 0).collect())) == brute(rows[:3], 5)
    assert top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_repeated_ids_and_huge_components(spark):
    """One vector an id, the least; sums beyond 64 bits are the largest or least long."""
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.25]), (1, [0.5, 0.0]), (1, [2.0, 2.0]), (2, [0.25, 0.0]), (3, [1e300, 0.0]), (4, [-1e300, 1e16]), (5, [1e13, 0.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        got = sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0, k=4).collect()))
        big, most = int(256 * 1e13), 2**63 - 1
        assert got == [
            (0, 1, 3, most), (0, 2, 5, 128 * big), (0, 3, 1, 128 * 128), (0, 4, 2, 128 * 64),
            (5, 1, 3, most), (5, 2, 0, 128 * big), (5, 3, 1, 128 * big), (5, 4, 2, 64 * big),
        ]


PAGES = [(1, "u", "x" * 2000), (2, "u 2\r\n", "x" * 2000), (3, None, None), (4, "u", "WARC/1.1\r\n\r\n\r\n" * 200), (5, "", ""), (6, "q", "WARC/1.1\r\n\r\n\r\n" * 200), (7, "é", "é\x00\r\n"), (7, "é", "é\x00\r\n"), (8, None, "z" * 1000), (None, "é", "z" * 1000), (9, "s", "same"), (10, "s", "same")]


def members_of(data):
    """Each gzip member of a file, unpacked."""
    while data:
        unpacker = zlib.decompressobj(31)
        yield unpacker.decompress(data)
        data = unpacker.unused_data


def test_archive_of_a_very_long_page(spark):
    rng = random.Random(1)
    pages = [(1, "u" * 200 + "\n", "".join(rng.choice("abcdefgh") for _ in range(1 << 20)) * 17), (2, "v", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {r.page_id: r for r in read_warc(spark, export_warc(read_records(spark, write_archive(df)))).collect()}
    assert {i: (r.payload_bytes, r.url) for i, r in rows.items()} == {i: (len(h), u) for i, u, h in pages}


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, digest int")
    archive = write_archive(pages)
    assert spark.read.parquet(archive.payloads).count() == len({p[2] or "" for p in PAGES})
    records = read_records(spark, archive)
    assert records.count() == len(PAGES)
    parsed = [next(parse_warc(r.header.encode() + bytes(r.payload) + b"\r\n\r\n")) for r in records.collect()]
    whole = {int(f["X-Page-ID"]): b for f, b in parsed if f["WARC-Type"] == "response"}
    assert all(whole[i].decode() == (h or "") for i, _, h in PAGES if i in whole)
    folder = export_warc(records, 600)
    rows = {r.page_id: r for r in read_warc(spark, folder).collect()}
    assert {(r.page_id, r.url) for r in rows.values()} == {(i, u or "") for i, u, _ in PAGES}
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()]
    members = [m for f in files for m in members_of(f)]
    assert len(files) > 2 and max(map(len, files)) < 600 + max(len(gzip.compress(m)) for m in members) + 20
    assert len(members) == len(PAGES) and all(len(list(parse_warc(m))) == 1 for m in members)
    assert rows[1].record_type == "revisit" and rows[1].refers_to == 2
    assert rows[4].refers_to == 6 and rows[None].refers_to == 8
    assert {i for i, r in rows.items() if r.record_type == "response"} == {2, 3, 5, 6, 7, 8, 9, 10}
    assert write_archive(pages.limit(0)) and read_records(spark, write_archive(pages.limit(0))).count() == 0
