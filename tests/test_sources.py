"""Readers and writers, by files written here."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources import writers as W


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_lists_and_maps(spark, tmp_path):
    a, b = put(tmp_path, "a.scp", "u1 wav/1.wav\nu2  /abs/2.wav\n\n"), put(tmp_path, "b.scp", "u1 wav/9.wav\n")
    got = {r.utt_id: r.path for r in R.key_path(spark, [a, b], "/root/x").collect()}
    assert got == {"u1": "/root/x/wav/9.wav", "u2": "/abs/2.wav"}
    t = put(tmp_path, "t.tsv", "u1\thello \nbroken\nu1\tagain\n")
    assert [(r.utt_id, r.text) for r in R.transcripts(spark, t).collect()] == [("u1", "again")]
    lex = put(tmp_path, "lex.txt", "CAT K AE1 T\nCAT X\nA AH0\n")
    assert {r.word: r.phones for r in R.lexicon(spark, lex, keep_stress=False).collect()} == {"CAT": ["K", "AE", "T"], "A": ["AH"]}
    sym = put(tmp_path, "sym.txt", "AH\t1\nK\t2\n")
    assert {r.symbol: r.id for r in R.symbols(spark, sym).collect()} == {"AH": 1, "K": 2}
    assert [r.seed for r in R.seeds(spark, put(tmp_path, "s.yaml", "a: 1\nseed: 7\n  - seed: 9\n")).orderBy("idx").collect()] == [7, 9]


def test_json(spark, tmp_path):
    p = put(tmp_path, "m.jsonl", '﻿{"utt_id": "a", "n": 1}\n\n{broken\n{"utt_id": "b", "n": 2}\n')
    assert [(r.utt_id, r.n) for r in R.json_lines(spark, p, "utt_id string, n int").orderBy("idx").collect()] == [("a", 1), ("b", 2)]
    assert R.json_lines(spark, p, "utt_id string, n int", head=1).count() == 1
    assert R.optional(spark, str(tmp_path / "none.jsonl"), "utt_id string").count() == 0
    doc = {"u": {"text": "hi", "accuracy": 8, "completeness": 10, "fluency": 9, "prosodic": 9, "total": 8, "words": [{"text": "HI", "accuracy": 9, "stress": 10, "total": 9, "phones": ["HH", "AY"], "phones-accuracy": [2, 1.5]}]}}
    rows = R.score_documents(spark, put(tmp_path, "scores.json", json.dumps(doc))).orderBy("phone_idx").collect()
    assert [(r.utt_id, r.word, r.phone, r.phone_score, r.utt_total) for r in rows] == [("u", "HI", "HH", 2.0, 8.0), ("u", "HI", "AY", 1.5, 8.0)]
    noisy = spark.createDataFrame([('WARN x\n{"a": 3}',), ("nothing",)], "v string").select(R.after_noise(F.col("v"), "a int").alias("r"))
    assert [r.r.a if r.r else None for r in noisy.collect()] == [3, None]


def test_matrices_and_predictions(spark, tmp_path):
    m = R.csv_matrix(spark, put(tmp_path, "f.csv", "1,2.5\n3,x\n"), "a int, b double").orderBy("idx").collect()
    assert (m[0].a, m[0].b) == (1, 2.5) and m[1].b is None
    v = R.vectors(spark, put(tmp_path, "ark.txt", "u.0  [ 5 0.5 1 ]\n")).first()
    assert (v.key, v.phone_id, v.feat) == ("u.0", 5, [5.0, 0.5, 1.0])
    line = "u1.wav; A:8.1; F:; P:9; T:7.5; Valid:T; w_a:1.0,2.0; w_s:5; w_t:3; alignment:[['0.00','0.41','word']]\n"
    r = R.prediction_lines(spark, put(tmp_path, "p.txt", line)).first()
    assert (r.utt_id, r.accuracy, r.fluency, r.valid, r.word_accuracy) == ("u1", 8.1, None, True, [1.0, 2.0])
    assert (r.alignment[0].start, r.alignment[0].end, r.alignment[0].word) == (0.0, 0.41, "word")


def test_wav(spark, tmp_path):
    data = b"\0\0" * 800
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(data))
    (tmp_path / "a.wav").write_bytes(head + data)
    r = R.wav_headers(spark, str(tmp_path)).first()
    assert (r.rate, r.channels, r.frames, r.duration) == (8000, 1, 800, 0.1)
    raw = spark.read.format("binaryFile").load(str(tmp_path / "a.wav")).select(F.length(R.wav_prefix(F.col("content"), 0.05, 8000)).alias("n")).first()
    assert raw.n == 44 + 2 * 401


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s1", "b", 1.0), ("s1", "a", 2.0)], "spk string, utt string, v double")
    assert [r.line for r in W.speaker_lists(df, "spk", "utt").collect()] == ["s1 a b"]
    path = str(tmp_path / "t")
    W.write_json_lines(df, path)
    with pytest.raises(Exception, match="already exists"):
        W.write_json_lines(df, path)
    new = W.replace(df, str(tmp_path / "r"), ["spk"])
    assert new.count() == 2
    with pytest.raises(ValueError):
        W.replace(df, str(tmp_path / "r"), ["missing"])
    assert W.replace(df.limit(1), str(tmp_path / "r"), ["spk"]).count() == 1
    u = W.union_all([df, df.select("spk", F.lit(1).alias("extra"))])
    assert u.columns == ["spk", "utt", "v", "extra"] and u.count() == 4
    W.write_splits(df, str(tmp_path / "p"), "spk")
    assert spark.read.parquet(str(tmp_path / "p")).where("spk = 's1'").count() == 2
    line = df.select(W.prediction_line(F.col("utt"), {"A": F.col("v")}, F.col("v") > 1).alias("x")).orderBy("x").collect()
    assert [r.x for r in line] == ["a.wav; A:2.000000; Valid:T", "b.wav; A:; Valid:F"]
