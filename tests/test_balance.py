"""Orders and quantiles without one task, paired intervals, gate analysis and balancing against plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import balance as B
from tidemark.operators import metrics as M
from tidemark.operators import ordering as O


def rows(spark, n=400, seed=1):
    r = random.Random(seed)
    data = [(r.choice(["a", "b", None]) if i % 3 else "a", r.choice([None, r.randint(0, 20)]), i) for i in range(n)]
    return data, spark.createDataFrame(data, "g string, v int, i int").repartition(5)


def test_places_and_running_sums(spark):
    data, df = rows(spark)
    got = {r.i: r for r in O.running(df, ["g"], [F.desc("v"), "i"], "v").collect()}
    assert len(got) == len(data)
    for g in ("a", "b", None):
        own = sorted((d for d in data if d[0] == g), key=lambda d: (d[1] is None, -(d[1] or 0), d[2]))
        total = 0
        for place, (_, v, i) in enumerate(own):
            total += v or 0
            assert (got[i].place, got[i].size, got[i].running) == (place, len(own), total)
    assert sorted(r.place for r in O.numbered(df, [], ["i"]).collect()) == list(range(len(data)))
    assert O.running(df.where("false"), ["g"], ["i"], "v").count() == 0


def test_quantiles(spark):
    data, df = rows(spark)
    got = {r.g: r for r in O.quantiles(df, ["g"], "v", {"x": 0.05, "y": 0.5, "z": 1.0}).collect()}
    for g in ("a", "b", None):
        want = np.quantile([v for k, v, _ in data if k == g and v is not None], [0.05, 0.5, 1.0])
        assert np.allclose([got[g].x, got[g].y, got[g].z], want)


def test_paired_delta(spark):
    r = random.Random(5)
    data = [(u, y + r.random(), y + 3 * r.random(), float(y)) for u in range(6) for y in range(10)] + [(0, None, 1.0, 2.0), (1, 1.0, None, 2.0)]
    df = spark.createDataFrame(data, "u int, a double, b double, y double")
    draws = M.draws(df, "u", 50, 3)
    whole = [d for d in data if d[1] is not None and d[2] is not None]
    delta = lambda d: np.corrcoef([x[1] for x in d], [x[3] for x in d])[0, 1] - np.corrcoef([x[2] for x in d], [x[3] for x in d])[0, 1]
    out = M.paired_delta(df, "u", draws, "a", "b", "y").first()
    assert out.paired_n == 60 and math.isclose(out.delta, delta(whole), rel_tol=1e-9)
    by_rep = {}
    for d in draws.collect():
        by_rep.setdefault(d.rep, []).extend([x for x in whole if x[0] == d.u] * d.times)
    each = sorted(delta(v) for v in by_rep.values())
    assert math.isclose(out.ci_low, each[int(0.025 * 49)], rel_tol=1e-6) and math.isclose(out.ci_high, each[int(0.975 * 49)], rel_tol=1e-6)
    alone = M.paired_delta(df, "u", draws.where("false"), "a", "b", "y").first()
    assert alone.ci_low == alone.delta == alone.ci_high
    flat = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 1.0, 4.0, 5.0)], "u int, a double, b double, y double")
    assert M.paired_delta(flat, "u", draws, "a", "b", "y").first().delta is None


def test_gate_analysis(spark):
    r = np.random.default_rng(2)
    gate, other, unsure, pred = r.random(90), r.random(90), r.random(90), r.random(90)
    target = pred + r.random(90)
    df = spark.createDataFrame([("e", *map(float, x)) for x in zip(gate, other, unsure, pred, target, strict=True)] + [("e", None, 1.0, 1.0, 1.0, 1.0)], "e string, gate double, other double, unsure double, pred double, target double")
    out = M.gate_analysis(df, "e", "gate", {"by_other": "other"}, "unsure", "pred", "target").first()
    assert out["count"] == 90 and np.allclose([out.mean, out.std, out.q05, out.q25, out.q50, out.q75, out.q95], [gate.mean(), gate.std(), *np.quantile(gate, [0.05, 0.25, 0.5, 0.75, 0.95])])
    assert math.isclose(out.by_other, np.corrcoef(gate, other)[0, 1], rel_tol=1e-9)
    a, b = np.quantile(unsure, [1 / 3, 2 / 3])
    for name, own in (("low", unsure <= a), ("mid", (unsure > a) & (unsure <= b)), ("high", unsure > b)):
        assert out[f"{name}_n"] == own.sum() and math.isclose(out[f"{name}_pcc"], np.corrcoef(pred[own], target[own])[0, 1], rel_tol=1e-9)


def test_oversampling(spark):
    data = [("big", i) for i in range(900)] + [("small", i) for i in range(120)] + [(None, i) for i in range(300)]
    out = B.oversampled(spark.createDataFrame(data, "label string, i int"), "label", ["label", "i"], 5).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.max("copy").alias("c")).collect()
    got = {r.label: r for r in out}
    assert (got["big"].n, got["big"].c) == (900, 0) and got["small"].d == 120 and got["small"].c == 7 and got[None].n == 900
    assert abs(got["small"].n - 900) < 60


def test_weighted_sample(spark):
    data = [(g, i, float(i % 10)) for g in "ab" for i in range(2000)] + [("c", 1, 1.0), ("c", 2, 0.0), ("c", 3, None)]
    out = B.weighted_sample(spark.createDataFrame(data, "g string, i int, w double"), ["g"], "w", ["g", "i"], 300, 9).collect()
    assert {g: sum(r.g == g for r in out) for g in "abc"} == {"a": 300, "b": 300, "c": 1}
    drawn = [r.w for r in out if r.g != "c"]
    assert 0 not in drawn and 5.7 < np.mean(drawn) < 6.7  # in proportion to the weight the mean is 6.33


def test_borrowed_examples(spark):
    data = [("a", i, 2) for i in range(10)] + [("a", 10, 0)] + [("b", 20 + i, i % 3) for i in range(9)] + [("c", 40, 2), ("c", 41, 1), (None, 50, 2), (None, 51, 2)]
    out = B.with_borrowed(spark.createDataFrame(data, "p string, i int, label int"), "p", "label", ["i"], 4).collect()
    lent = [r for r in out if r.borrowed]
    assert len(out) - len(lent) == len(data) and all(r.label == 0 for r in lent)
    by = {p: [r.i for r in lent if r.p == p] for p in ("a", "b", "c", None)}
    twos = {i for _, i, s in data if s == 2}
    assert len(by["a"]) == len(twos - set(range(10))) == 6  # 9 are lacking, but others have 6
    assert by["b"] == by["c"] == [] and len(by[None]) == 2
    for p, ids in by.items():
        assert len(set(ids)) == len(ids) and set(ids) <= twos - {i for q, i, _ in data if q == p}
    nothing = spark.createDataFrame([("a", 1, 1)], "p string, i int, label int")
    assert B.with_borrowed(nothing, "p", "label", ["i"], 4).count() == 1
