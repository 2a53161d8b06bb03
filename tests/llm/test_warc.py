"""Archives written and read back."""

import base64
import gzip
import hashlib

import pytest

from tidemark.llm import warc


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 400_000
    rows = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (1, "http://a/2", "same"), (None, "http://a/3", "same"), (4, None, None), (5, "u", ""), (6, "http://x/\r\nWARC-Type: revisit", big), (7, "v", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n"), (None, "w", "alone")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, first int")
    index = warc.write(df, f"file://{tmp_path}/w")
    assert index.count() == len(rows)
    out = warc.read(spark, index).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in out) == sorted((str(i), len((t or "").encode()), digest(t)) for i, _, t in rows)
    same = sorted((str(r.page_id), r.record_type, r.refers_to) for r in out if r.payload_digest == digest("same"))
    assert same == [("1", "response", None), ("1", "revisit", 1), ("3", "revisit", 1), ("None", "revisit", 1)]
    empty = sorted((r.page_id, r.record_type, r.refers_to) for r in out if r.payload_bytes == 0)
    assert empty == [(4, "response", None), (5, "revisit", 4)]
    assert {r.page_id: bytes(r.payload).decode() for r in out if r.page_id in (6, 7)} == {6: big, 7: rows[7][2]}
    some = warc.read(spark, index.where("page_id > 4")).collect()
    assert sorted(r.page_id for r in some) == [5, 6, 7]
    first = index.orderBy("offset").first()
    data = open(first.file.removeprefix("file://"), "rb").read()
    assert gzip.decompress(data[first.offset : first.offset + first.length]).startswith(b"WARC/1.1\r\n")


def test_small_payloads_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    out = warc.read(spark, warc.write(df, f"file://{tmp_path}/w", least_bytes=3)).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string").coalesce(1)
    index = warc.write(df, f"file://{tmp_path}/w")
    row = index.first()
    path = row.file.removeprefix("file://")
    plain = gzip.decompress(open(path, "rb").read()).replace(b"abc", b"abd")
    bad = gzip.compress(plain, 1)
    with open(path, "wb") as f:
        f.write(bad)
    index = index.withColumn("length", index["length"] * 0 + len(bad))
    with pytest.raises(Exception, match="not the one that was written"):
        warc.read(spark, index).collect()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write(df, f"file://{tmp_path}/w")
    assert index.count() == 0 and warc.read(spark, index).count() == 0


def test_ids_of_any_type(spark, tmp_path):
    ids = ["p1", "7", " a\r\nWARC-Type: revisit", "é%20", "", None]
    df = spark.createDataFrame([(i, "http://x/a b", "one") for i in ids] + [("p1", "http://x/a b", "one")], "page_id string, url string, html string")
    index = warc.write(df, f"file://{tmp_path}/w")
    out = warc.read(spark, index).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in out) == sorted((str(i), "revisit" if k else "response", "" if k else None) for k, i in enumerate(sorted([*ids, "p1"], key=lambda x: (x is None, x or ""))))
    assert {r.url for r in out} == {"http://x/a%20b"} and {r.url for r in index.collect()} == {"http://x/a b"}
    names = set()
    for r in index.collect():
        data = open(r.file.removeprefix("file://"), "rb").read()
        names.add(gzip.decompress(data[r.offset : r.offset + r.length]).split(b"\r\n")[2])
    assert len(names) == len(ids) + 1
