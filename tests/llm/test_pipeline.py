"""The registered queries against SQL, and the pipeline's stages on the smallest table and on planted cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.compare import connect, rows
from tidemark.llm import packing, rules, simhash
from tidemark.llm.queries import QUERIES
from tidemark.llm.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).sql(ORACLE_SQL[name]).df())


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(n))


def test_planted_cases(spark):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    clean = [prose(k, 150) for k in range(12)]
    near = clean[0].split(" ")
    near[75] = near[75] + "x"
    docs = [
        *[(10 + k, t) for k, t in enumerate(clean)],
        (100, clean[0]),  # an exact copy: its lines go
        (101, " ".join(near)),  # a near copy: one line, similar
        (102, "too short"),
        (103, "### $$$ " * 80),
        (104, None),
        (105, ""),
        (106, prose(50, 60) + "\n" + bench[3]),
        (107, clean[1] + "\n" + prose(51, 70)),
        (108, prose(52, 70) + "\n" + prose(53, 70)),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in C.STAGES:
        df = stage(spark, df, SF)
        path = C.new_path(spark, name)
        df.write.parquet(path)
        df = spark.read.parquet(path)
        seen[name] = df
        if name != "packing":
            assert df.columns == C.COLUMNS
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert ids("quality_rules") == {*range(10, 22), 100, 101, 106, 107, 108}
    assert ids("line_dedup") == {*range(10, 22), 106, 107, 108}
    text = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    assert text[107] == prose(51, 70) and text[10] == clean[0] and text[108] == docs[-1][1]
    assert ids("simhash_near_dedup") == ids("line_dedup")
    assert ids("decontamination") == {*range(10, 22), 107, 108}
    packed = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in packed} == ids("decontamination") and all(r.n == r.m for r in packed)


def test_near_dedup_stage(spark):
    base = prose(7, 300)
    other = base.split(" ")
    other[10] = "changed"
    docs = [(1, base), (2, " ".join(other)), (2, " ".join(other)), (3, prose(8, 300)), (None, prose(8, 300)), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    out = C.near_dedup(spark, df, SF).collect()
    prints = {simhash.fingerprint(t) for _, t in docs}
    linked = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    assert len(out) == len(prints) - len(linked)
    assert Counter(r.doc_id for r in out)[3] == 1 and 4 in {r.doc_id for r in out} and 5 not in {r.doc_id for r in out}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        assert stage(spark, df, SF).count() == 0


def test_run(spark):
    out = C.run(spark, SF).toPandas()
    assert len(out)
    n = out.groupby("sequence_id").length.sum()
    assert ((n == packing.SEQUENCE) | (n & (n - 1) == 0)).all()
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.max()).all()
    assert [len(np.frombuffer(x, "<u4")) for x in out.ids] == out.length.tolist()
    kept = {r.doc_id for r in rules.quality(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()}
    assert set(out.doc_id) <= kept
