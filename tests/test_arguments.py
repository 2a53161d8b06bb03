"""Arguments, reports, guarded paths and gates."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arguments as A
from tidemark.operators import composites as C
from tidemark.operators import sets
from tidemark.sources import readers as R
from tidemark.sources import writers as W


def test_choices():
    assert A.choices(" b, a,b,", ["a", "b", "c"]) == ["b", "a"]
    for bad in ("a,x", " , "):
        with pytest.raises(ValueError):
            A.choices(bad, ["a"])


def test_options():
    assert A.fold_options("--n 1 in --flag --m 2 --n 3 --flag".split(), ["--n", "--m"]) == ["--n", "3", "in", "--flag", "--m", "2"]
    with pytest.raises(ValueError):
        A.fold_options(["--n"], ["--n"])
    assert A.command_tokens({"batch_size": 4, "dry": True, "off": False, "none": None, "dims": [1, 2]}) == ["--batch-size", "4", "--dry", "--dims", "1,2"]


def test_reports(spark):
    assert A.yaml_text({"a": 1, "b": {"c": "x: y"}, "d": [1, {"e": None}], "f": []}) == 'a: 1\nb:\n  c: "x: y"\nd:\n  - 1\n  - e: null\nf: []\n'
    assert A.markdown(spark.createDataFrame([(1, 0.5, "a|b")], "i int, x double, s string")) == "| i | x | s |\n| --- | --- | --- |\n| 1 | 0.5000 | a\\|b |\n"


def test_free_path(spark, tmp_path):
    at = f"file://{tmp_path}/out.csv"
    assert W.free_path(spark, at) == at
    for name in ("out.csv", "out.1.csv"):
        (tmp_path / name).write_text("")
    assert W.free_path(spark, at) == f"file://{tmp_path}/out.2.csv"
    (tmp_path / "plain").write_text("")
    assert W.free_path(spark, f"file://{tmp_path}/plain") == f"file://{tmp_path}/plain.1"


def test_status_counts(spark):
    df = spark.createDataFrame([("train", "ok"), ("test", None)], "split string, status string")
    assert sets.status_counts(df, ["split"], {"split": ["train", "test"]}).count() == 2
    for gate in (lambda: sets.status_counts(df, ["split"], {"split": ["val"]}), lambda: sets.status_counts(df.where("false"), ["split"], {})):
        with pytest.raises(sets.CoverageError):
            gate()
    with pytest.raises(ValueError):
        R.require_columns(df, ["split", "cn_post"])


def test_header_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\nx,2\ny,\nx,1\n")
    got = {r.id: [x.v for x in r.records] for r in R.header_records(spark, f"file://{tmp_path}", "id string, v int", "id").collect()}
    assert got == {"x": [2, 1], "y": [None]}


def test_open_response_branches(spark):
    words = "utt int, place int, text string, s double, e double, acc double"
    pred = spark.createDataFrame([(1, 1, "a", 0.0, 1.0, 3.0), (1, 2, "b", 1.0, 2.0, 4.0), (2, 1, "a", 0.0, 1.0, 5.0), (3, 1, "z", 0.0, 1.0, 6.0), (3, 2, "q", 5.0, 6.0, 8.0), (4, 1, "z", 0.0, 1.0, 6.0)], words)
    ref = spark.createDataFrame([(u, 1, "a", 0.0, 0.5, 1.0) for u in (1, 2, 3, 4, 5)] + [(u, 2, "b", 0.5, 2.0, 2.0) for u in (1, 3, 4)], words)
    utts = spark.createDataFrame([(u, u == 5, u != 4, 9.0) for u in (1, 2, 3, 4, 5)], "utt int, invalid boolean, aligned boolean, acc double")
    got = sorted((r.utt, r.branch, r.place, r.pred_acc, r.gold_acc) for r in C.open_response(pred, ref, utts, "utt", ["acc"], 1.0, [0.0]).collect())
    assert got == [(1, "equal", 1, 3.0, 1.0), (1, "equal", 2, 4.0, 2.0), (2, "equal", 1, 5.0, 1.0), (3, "interval", 1, 6.0, 1.5), (3, "interval", 2, 8.0, 0.0), (4, "skip", None, None, None), (5, "invalid", 1, 9.0, 1.0)]


def test_prosody_of_nothing(spark):
    frames = spark.createDataFrame([("a", 0, 0.5, None, 0.0)], "utt string, frame int, rms double, f0 double, voiced_prob double")
    utts = spark.createDataFrame([("a", 2.0, 3, 4), ("b", 2.0, 3, 4)], "utt string, audio_end double, words int, phones int")
    got = {r.utt: r for r in C.prosody_vector(frames, utts, "utt").collect()}
    assert sum(got["b"][1:]) == 0 and (got["a"].duration, got["a"].word_rate, got["a"].pause_count, got["a"].silence_ratio, got["a"].f0_mean) == (2.0, 1.5, 1.0, 1.0, 0.0)
    slots = spark.createDataFrame([("a", 1, 0.0, 1.0, None, None, None)], "utt string, slot int, ls double, le double, word int, phone string, stress int")
    none = spark.createDataFrame([], "utt string, time double, energy double, f0 double")
    (r,) = C.slot_prosody(none, slots, "utt", 1.0).collect()
    assert (r.duration, r.word_phones, r.duration_relative, r.is_vowel, r.energy_std) == (1.0, 1.0, 1.0, 0.0, 0.0)
    assert C.teacher_targets(spark.createDataFrame([("a", 1, True, 1)], "utt string, chunk int, is_final boolean, idx int"), spark.createDataFrame([], "utt string, chunk int, status string, at int, acc double"), ["acc"]).select(F.sum("mask"), F.sum("final_acc")).first()[:] == (0, 0.0)
