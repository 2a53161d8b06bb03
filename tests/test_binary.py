"""Binary archives, arrays on disk and sound files: round trips, plain readers, damage, and how much is read."""

import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import ranges as B
from tidemark.sources.npy import Npy, NpyReader, NpyWriter, Written


def test_records_of_all_kinds():
    r = np.random.default_rng(1)
    for values in (r.normal(size=5), r.normal(size=(3, 4)), r.normal(size=5).astype("f4"), r.normal(size=(2, 7)).astype("f4"), np.zeros((0, 3)), np.zeros(0, "f4")):
        body = b"junk" + B.record(values)
        rows, cols, back = B.parsed_record(lambda at, n: body[at : at + n], 4)  # noqa: B023
        assert (rows, cols) == (values.shape if values.ndim == 2 else (1, len(values))) and (back == values.ravel()).all()
    for bad in (b"", b"\0BCM \4", b"text [ 1 2 ]", B.record(np.ones(4))[:-1], B.record(np.ones((2, 2)))[:9]):
        with pytest.raises(ValueError):
            B.parsed_record(lambda at, n: bad[at : at + n], 0)  # noqa: B023


def test_archives(spark, tmp_path):
    rows = [(f"k{i}", [float(i), i / 3, -1.0]) for i in range(200)]
    index = B.write_archives(spark.createDataFrame(rows, "key string, data array<double>").repartition(3), "key", "data", f"file://{tmp_path}/a")
    B.index_lines(index).write.text(f"file://{tmp_path}/scp")
    (tmp_path / "scp" / "more.txt").write_text(f"\ngone {tmp_path}/none.ark:5\ncut {index.first().path}:1000000\n")
    found = {r.key: r for r in B.read_archives(B.index_of(spark, f"file://{tmp_path}/scp"), block=64).collect()}
    assert len(found) == 202 and found["gone"].error and found["cut"].error and found["cut"].data is None
    assert all(found[k].data == v and (found[k].rows, found[k].cols) == (1, 3) for k, v in rows)


def test_neighbours_come_in_one_read(tmp_path):
    body = b"".join(B.record(np.full(10, float(i))) for i in range(100))
    (tmp_path / "x").write_bytes(body + b"\0" * 1_000_000)
    size = len(body) // 100
    with B.Window(f"file://{tmp_path}/x", 50 * size) as w:
        for i in range(40, 60):
            assert B.parsed_record(w, i * size)[2][0] == i
        assert w.bytes_read <= 100 * size


def write_npy(spark, path, rows, kind="<f8", size=7):
    spark.dataSource.register(Npy)
    df = spark.createDataFrame([(0, r) for r in rows], "row long, data array<double>")
    df.write.format("npy").option("path", path).option("rows", size).option("kind", kind).mode("append").save()


def test_arrays_on_disk(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    rows = [[float(i), i / 7] for i in range(50)]
    write_npy(spark, path, rows)
    back = spark.read.format("npy").option("path", path).option("rows", 3).load()
    assert sorted(r.data for r in back.collect()) == rows and sorted(r.row for r in back.collect()) == list(range(50))
    parts = json.loads((tmp_path / "a" / "_parts.json").read_text())
    plain = np.concatenate([np.load(tmp_path / "a" / name) for name, _ in parts])
    assert [r.data for r in back.orderBy("row").collect()] == plain.tolist() and sum(n for _, n in parts) == 50
    write_npy(spark, path, [[1.0, 2.0]])
    assert spark.read.format("npy").option("path", path).load().count() == 51
    np.save(tmp_path / "a" / "part-left-behind.npy", np.ones((9, 2)))  # of a task that never was committed
    assert spark.read.format("npy").option("path", path).load().count() == 51


def test_foreign_arrays(spark, tmp_path):
    spark.dataSource.register(Npy)
    cube = np.arange(24, dtype="i2").reshape(4, 3, 2)
    np.save(tmp_path / "cube.npy", cube)
    rows = spark.read.format("npy").option("path", f"file://{tmp_path}/cube.npy").option("rows", 3).load().orderBy("row").collect()
    assert [r.data for r in rows] == cube.reshape(4, 6).tolist()
    assert [(s.first, s.rows) for s in NpyReader(f"file://{tmp_path}/cube.npy", 3).partitions()] == [(0, 3), (3, 1)]
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((2, 3))))
    with pytest.raises(ValueError, match="columns come first"):
        NpyReader(f"file://{tmp_path}/f.npy", 3).partitions()
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert spark.read.format("npy").option("path", f"file://{tmp_path}/none.npy").load().count() == 0


def test_aborted_writes_leave_nothing(tmp_path):
    w = NpyWriter(f"file://{tmp_path}/a", 5, "<f4", False)
    part = w._put(np.ones((3, 2), "f4"))
    w.abort([Written([part]), None])
    assert list((tmp_path / "a").iterdir()) == []


def test_sound_parts(spark, tmp_path):
    samples = np.arange(1000, dtype="<i2")
    (tmp_path / "a.wav").write_bytes(B.wav_file(samples.tobytes(), 100))
    odd = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + B.wav_file(samples.tobytes(), 100)[12:]
    (tmp_path / "b.wav").write_bytes(odd)
    (tmp_path / "c.wav").write_bytes(b"no sound")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.wav", 7) for n in "abcd"], "path string, part int")
    out = {r.path[-5]: r for r in B.wav_parts(files, "path", F.lit(1.005), F.lit(2.001), keep=f"file://{tmp_path}/parts").collect()}
    want = samples[100:201].tobytes()
    for n in "ab":
        assert (out[n].rate, out[n].frames, out[n].duration, out[n].part_frames) == (100, 1000, 10.0, 101) and bytes(out[n].part) == want
        assert io.FileIO(out[n].part_path.removeprefix("file://")).read() == B.wav_file(want, 100)
    assert out["c"].rate is None and out["d"].rate is None and out["d"].part is None
    changed = samples.copy()
    changed[201:] = -1  # later samples have no influence, nor are they read
    (tmp_path / "a.wav").write_bytes(B.wav_file(np.concatenate([changed] * 100).tobytes(), 100))
    r = B.wav_parts(files.where("path LIKE '%a.wav'"), "path", F.lit(1.005), F.lit(2.001)).first()
    assert bytes(r.part) == want and r.bytes_read <= 4096 + len(want)
