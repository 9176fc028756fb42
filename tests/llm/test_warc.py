"""WARC archives written and read back."""

import base64
import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import queries, warc  # noqa: F401
from riskloom.llm.base import QUERIES


def brute(rows, min_bytes=0):
    """(page_id, payload_bytes, digest, type, refers_to) of (page_id, url, html) rows without repeated ids."""
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, b in bodies:
        top[b] = max(top.get(b, i), i)
    out = []
    for i, b in bodies:
        first = len(b) < min_bytes or top[b] == i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top[b]))
    return sorted(out)


def page(value):
    return None if value is None else int(value.removeprefix("urn:page:"))


def summary(records):
    kept = [r for r in records if r.type != "warcinfo"]
    return sorted((page(r.record_id), r.payload_bytes, r.payload_digest[5:], r.type, page(r.refers_to)) for r in kept)


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(map(tuple, QUERIES["op13_warc_ranges"](spark, sf_dir).collect())) == brute(rows)


@pytest.mark.parametrize("split", [7, 300, 1 << 20])
def test_round_trip_by_ranges_of_any_size(spark, tmp_path, split):
    """Copies, nulls, empty, long and odd texts; every record once, whatever the ranges."""
    rng = random.Random(3)
    texts = [None, "", "é\r\n\r\nWARC/1.1\r\n", "x" * 30_000, "".join(map(chr, rng.choices(range(1, 0x2FF), k=9000)))] + [f"copy {i % 4}" for i in range(12)]
    rows = [(i, f"http://a.example/ü {i}\n" if i % 5 else None, t) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    files = warc.write_warc(pages.repartition(2), str(tmp_path), min_bytes=1, file_bytes=4000)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    assert {r.path: r.length for r in files.collect()} == {f: os.path.getsize(f) for f in map(str, tmp_path.iterdir())}
    if split == 7:  # one range for each few bytes: the largest archive is enough
        files = files.orderBy("length").limit(1)
    got = warc.read_warc(files, split).collect()
    if split == 7:
        assert len(got) == files.first().records + 1
        return
    assert summary(got) == brute(rows, min_bytes=1)
    held = {page(r.record_id): bytes(r.payload) for r in got if r.type == "response"}
    assert all(held[i] == (t or "").encode() for i, _, t in rows if i in held)
    assert all(r.digest_ok for r in got if r.type == "response") and all(r.digest_ok is None and r.payload is None for r in got if r.type == "revisit")
    assert {page(r.record_id): r.target_uri for r in got if r.type != "warcinfo"} == {
        i: None if u is None else u.replace(" ", "%20").replace("\n", "%0A") for i, u, _ in rows
    }
    listed = warc.archive_files(spark, str(tmp_path))
    assert warc.read_warc(listed, split, with_payload=False).count() == len(got)


def test_repeated_and_missing_ids(spark, tmp_path):
    rows = [(5, "b", "same"), (5, "b", "same"), (5, "a", "same"), (4, "c", "same"), (None, "d", "same"), (None, None, "lone"), (None, None, "lone")] + [(9, "z", "all")] * 40
    got = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path))).where("type <> 'warcinfo'").collect()
    told = sorted((page(r.record_id), r.target_uri, r.type, page(r.refers_to)) for r in got if r.record_id)
    assert told == sorted([(4, "c", "revisit", 5), (5, "a", "revisit", 5), (5, "b", "response", None), (5, "b", "revisit", 5), (9, "z", "response", None)] + [(9, "z", "revisit", 9)] * 39)
    lone = sorted(((r.type, page(r.refers_to)) for r in got if r.record_id is None), key=str)
    assert lone == [("response", None), ("revisit", 5), ("revisit", None)]


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_warc(none, str(tmp_path))
    assert files.count() == 0 and warc.read_warc(files).count() == 0


def stored_member(data):
    """A gzip member that keeps its content as it is, so that magic inside it shows."""
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def test_archives_inside_payloads_and_damage(spark, tmp_path):
    """Records whose payload is itself an archive are not taken apart, wherever ranges fall; a damaged member costs only itself."""
    inner = b"".join(warc.member(warc.record("resource", [("WARC-Record-ID", f"<urn:inner:{i}>")], b"inside " * 50)) for i in range(30))
    outer = [stored_member(warc.record("resource", [("WARC-Record-ID", f"<urn:outer:{i}>")], inner)) for i in range(6)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(outer))
    broken = bytearray(outer[2])
    broken[20:60] = b"\0" * 40
    plain = [warc.member(warc.record("resource", [("WARC-Record-ID", f"<urn:plain:{i}>")], b"text %d " % i * 200)) for i in range(9)]
    cut = bytearray(plain[4])
    cut[12:30] = b"\xff" * 18
    (tmp_path / "b.warc.gz").write_bytes(b"".join([*plain[:4], bytes(cut), *plain[5:]]) + b"trailing rubbish")
    (tmp_path / "c.warc.gz").write_bytes(b"")
    files = warc.archive_files(spark, str(tmp_path))
    for split in (97, 1000, 1 << 20):
        got = sorted(r.record_id for r in warc.read_warc(files, split).collect())
        assert got == [f"urn:outer:{i}" for i in range(6)] + [f"urn:plain:{i}" for i in range(9) if i != 4]
