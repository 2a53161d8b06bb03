"""Hand-computed cases."""

import random
from itertools import combinations
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import align as A
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import sequence as Q
from tidemark.operators import sets
from tidemark.plans import metric_queries, more_queries, sequence_queries, text_queries  # noqa: F401
from tidemark.plans.registry import QUERIES
from tidemark.streaming import commits as C


def one(spark, col, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(col.alias("x")).first().x


def metric(spark, pairs, *cols):
    return spark.createDataFrame(pairs, "p double, t double").agg(*cols).first()


def test_correlation_cases(spark):
    r = M.safe_corr("p", "t").alias("r")
    assert metric(spark, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], r).r == pytest.approx(1)
    assert metric(spark, [(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], r).r == pytest.approx(-1)
    assert metric(spark, [(1.0, 3.0), (1.0, 2.0)], r).r is None
    assert metric(spark, [(1.0, 3.0), (1.0, 2.0)], M.safe_corr("p", "t", 0.0).alias("r")).r == 0
    assert metric(spark, [(1.0, 3.0)], r).r is None


def test_errors(spark):
    n, mse, mae = M.errors("p", "t")
    got = metric(spark, [(1.0, 1.0), (2.0, 1.0), (3.0, 5.0)], n, mse, mae)
    assert (got.n, got.mse, got.mae) == (3, pytest.approx(5 / 3), pytest.approx(1))
    bad = spark.createDataFrame([(1.0, float("nan")), (float("inf"), 1.0), (None, 1.0), (1.0, 1.0)], "p double, t double")
    assert M.pairs_only(bad, "p", "t").count() == 1


def test_calibration(spark):
    df = spark.createDataFrame([("a", 0.05, 0), ("a", 0.95, 1)], "g string, c double, t int")
    assert M.ece(df, ["g"], "c", "t").first().ece == pytest.approx(0.05)


def test_vectors(spark):
    half = F.array(F.lit(0.5), F.lit(0.5))
    assert one(spark, V.entropy(half)) == pytest.approx(math.log(2))
    inf = float("inf")
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(spark, V.softmax(arr(inf, 1, inf))) == [0.5, 0, 0.5]
    assert one(spark, V.softmax(arr(-inf, -inf))) == [0.5, 0.5]
    got = one(spark, V.softmax(arr(0, -inf)))
    assert got[0] == pytest.approx(1) and 0 < got[1] < 1e-20
    assert one(spark, V.js_divergence(V.normalized(arr(1, 0)), V.normalized(arr(1, 0)))) == pytest.approx(0)
    toks = lambda s: F.split(F.lit(s), "")
    assert one(spark, V.has_cycle(toks("xababababy"), 4, 3))
    assert not one(spark, V.has_cycle(toks("xabababy"), 4, 3))


def test_text(spark):
    assert one(spark, X.normalize_phone(F.lit(" [ah0_B] "))) == "AH"
    assert one(spark, X.digits_to_words(F.lit("a12"))) == "a one two"
    words = lambda s: F.split(F.lit(s), " ")
    assert one(spark, X.edit_distance(words("a b c d"), words("a x c"))) == 2
    assert one(spark, X.edit_distance(words("a b"), F.array().cast("array<string>"))) == 2
    assert one(spark, S.grid_score(F.lit(0.25), 0.5)) == 0.0  # half to even


def test_supervision(spark):
    assert one(spark, S.supervision_weight(F.lit(0.0), F.lit(0.4), F.lit(0.5), True)) == pytest.approx(0.1)
    assert one(spark, S.supervision_weight(F.lit(0.0), F.lit(0.4), F.lit(0.5), False)) == 0


def test_alignment():
    assert A.lcs_pairs(list("abcd"), list("xbd")) == [(1, 1), (3, 2)]
    assert A.edit_pairs(list("ab"), list("b")) == [(0, None), (1, 0)]
    r = random.Random(1)
    for _ in range(300):
        a, b = (r.choices("abcd", k=r.randint(0, 7)) for _ in range(2))
        got = A.lcs_pairs(a, b)
        assert [a[i] for i, _ in got] == [b[j] for _, j in got] and got == sorted(got) and len({j for _, j in got}) == len(got)
        longest = max(k for k in range(len(a) + 1) for c in combinations(a, k) if all(w in rest for rest in [iter(b)] for w in c))
        assert len(got) == longest
    assert A.viterbi_spans(np.array([[0, -9], [0, -9], [-9, 0.0]])) == [(0, 2), (2, 3)]
    assert A.viterbi_spans(np.zeros((1, 2))) is None
    for q, want in ((0.95, [0.95, 0.05]), (0.10, [0.10, 0.90])):
        assert A.confusion_network([[(0, q)]], [1.0], 1)[0].tolist() == pytest.approx(want)
    net = A.confusion_network([[(0, 0.9), (1, 0.8)], [(1, 1.0)], [(2, 0.5), (0, 0.5), (1, 0.4)]], [0.5, 0.3, 0.2], 3)
    assert np.allclose(net.sum(1), 1) and len(net) == 3


def dealt(spark, folder, turns):
    """A folder whose conversations are one question and one reply each."""
    rows = [(k, i, role, text) for k, both in enumerate(turns) for i, (role, text) in enumerate(zip(("user", "assistant"), both, strict=True))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


SPELLED = [a + b for a in "abcdefgh" for b in "abcdefgh"]


def test_wer_reads_whole_texts(spark, tmp_path):
    assert A.edit_distance(list("kitten"), list("sitting")) == 3 and A.edit_distance([], list("ab")) == 2 and A.edit_distance(list("ab"), []) == 2
    folder = dealt(spark, tmp_path, [(" ".join(SPELLED), " ".join([*SPELLED[:20], "x", *SPELLED[21:40], *SPELLED[44:]]))])
    r = QUERIES["f24_wer"](spark, folder).first()
    assert (r.errors, r.words, r.wer) == (5, 64, round(5 / 64, 6))


def test_fold_reads_every_whole_text(spark, tmp_path):
    texts = [("de", "Größe ﬁne " * 200), ("fr", "été 中 " * 200), ("en", "x" * 5000), ("es", None)]
    spark.createDataFrame([(k, *x) for k, x in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n for r in QUERIES["c9_whole_ascii_fold"](spark, str(tmp_path)).collect()}
    folded = [t and sum(c < "\x80" for c in unicodedata.normalize("NFKD", t)) for _, t in texts]
    assert got == dict(enumerate(folded))


def test_alignments_read_whole_texts(spark, tmp_path):
    folder = dealt(spark, tmp_path, [(" ".join(SPELLED), " ".join(["x", *SPELLED[:50], *SPELLED[52:]]))])
    want = [(k, k + 1) for k in range(50)] + [(k, k - 1) for k in range(52, 64)]
    for name in ("e23_lcs_align", "e24_e28_edit_align"):
        got = sorted((r.a_pos, r.b_pos) for r in QUERIES[name](spark, folder).collect())
        assert got == want, name


def test_padding_reads_whole_texts(spark, tmp_path):
    words = ["a" * (k + 1) for k in range(50)]
    folder = dealt(spark, tmp_path, [(" ".join(words), " ".join(words))])
    assert QUERIES["e27_pad_to_reference"](spark, folder).first().scores == [float(k + 1) for k in range(50)]


def test_intervals(spark):
    left = spark.createDataFrame([(1, "u", 0.0, 2.0), (2, "u", 10.0, 11.0)], "id int, k string, ls double, le double")
    right = spark.createDataFrame([("u", 2.0, 3.0, 7.0, 1), ("u", 1.0, 2.0, 4.0, 2), ("u", 0.0, 0.5, 8.0, 3)], "k string, rs double, re double, v double, rid int")
    assert {(r.id, r.rid) for r in J.interval_pairs(left, right, "k", 1.5).collect()} == {(1, 2), (1, 3)}  # touching ones don't overlap
    out = {r.id: r for r in J.overlap_weighted(left, right, "k", 1.5, 0.0, ["v"], [5.0], "id").collect()}
    assert out[1].v == pytest.approx((4 * 1 + 8 * 0.5) / 1.5) and out[2].v == 5.0 and out[2].n_overlap == 0


def test_convergence(spark):
    rows = spark.createDataFrame([("u", i, p, v) for i, (p, v) in enumerate([(0.25, 9.0), (0.5, 3.0), (0.75, 9.2), (1.0, 9.4)])], "u string, i int, p double, v double")
    got = Q.convergence(rows, "u", ["i"], "p", "v", 0.5).first()
    assert (got.stable_from, got.first_stable) == (0.75, 0)


def test_gates(spark):
    rep = spark.createDataFrame([("a", 0.5)], "g string, s double")
    with pytest.raises(sets.CoverageError):
        sets.require(rep, "s", 0.9)
    with pytest.raises(sets.CoverageError):
        sets.require(rep.where("false"), "s", 0.0)
    rows = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("m", 3, False)], "k string, i int, ok boolean")
    got = {r.k: r.i for r in sets.merge_preferring(rows, ["k"], F.col("ok"), ["i"]).collect()}
    assert got == {"k": 2, "m": 3}


def test_windows(spark):
    utts = spark.createDataFrame([("u", 1.5), ("v", 0.64)], "u string, t double")
    got = {(r.u, r.chunk_id): (round(r.commit_time, 4), round(r.audio_end, 4), r.is_final) for r in C.windows(utts, "u", "t", 0.64, 0.16).collect()}
    assert got == {("u", 0): (0.64, 0.8, False), ("u", 1): (1.28, 1.44, False), ("u", 2): (1.5, 1.5, True), ("v", 0): (0.64, 0.64, True)}


def test_state_is_additive(spark):
    rows = spark.createDataFrame([("u", i, float(i)) for i in range(6)], "u string, i int, v double")
    whole = C.running_state(rows, "u", ["i"], "v").where("i = 5").first()
    first, rest = (C.running_state(rows.where(c), "u", ["i"], "v").orderBy(F.desc("i")).first() for c in ("i < 3", "i >= 3"))
    assert (whole.state_sum, whole.state_count) == (first.state_sum + rest.state_sum, first.state_count + rest.state_count)


def test_loops(spark):
    rows = [(1, list("abababab")), (2, list("abcd")), (3, ["x"] * 3 + ["a", "x", "b", "x", "c", "x", "x", "d", "x", "x", "e"]), (4, list("abcxabcyabczabc")), (5, []), (6, None)]
    df = spark.createDataFrame(rows, "i int, t array<string>")
    assert {r.i: r.k for r in df.select("i", Q.loop_kind(F.col("t")).alias("k")).collect()} == {1: "cycle", 2: None, 3: "dominant", 4: "periodic", 5: None, 6: None}
    assert {r.k for r in df.select(Q.loop_kind(F.col("t"), strict=False).alias("k")).collect()} == {"cycle", None}


def test_padding(spark):
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert one(spark, Q.pad_to_reference(arr("a", "b", "c"), arr("a", "c"), arr(1.0, 2.0))) == [1.0, 1.0, 2.0]
    assert one(spark, Q.pad_to_reference(arr("z", "a"), arr("a", "c"), arr(1.0, 2.0))) == [2.0, 1.0]
    assert one(spark, Q.pad_to_reference(arr("a", "b", "c"), arr("a"), arr(1.0))) == [1.0, 1.0]


def test_draws_with_replacement(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",)], "unit string")
    got = M.draws(df, "unit", 300, 5).collect()
    by_rep = {}
    for r in got:
        by_rep.setdefault(r.rep, {})[r.unit] = r.times
    assert len(by_rep) == 300 and all(sum(x.values()) == 4 for x in by_rep.values())
    assert max(max(x.values()) for x in by_rep.values()) >= 3 and min(len(x) for x in by_rep.values()) < 4
    assert all(250 < sum(x.get(u, 0) for x in by_rep.values()) < 350 for u in "abcd")
    assert M.draws(df.where("false"), "unit", 3, 5).count() == 0


def test_ranking_pairs_against_all_pairs(spark):
    import random

    from tidemark.operators.joins import ranking_pairs

    r = random.Random(7)
    data = [(g, i, r.choice([None, r.uniform(-5, 5), 1.0]), r.choice([None, r.randint(0, top)])) for g, n, top in (("a", 60, 12), ("b", 40, 1), (None, 30, 30), ("one", 5, 0)) for i in range(n)]
    got = {x.g: (x.pairs, x.loss) for x in ranking_pairs(spark.createDataFrame(data, "g string, i int, p double, t int"), "g", "i", "p", "t", 1.5).collect()}
    for g in ("a", "b", None, "one"):
        own = [(p, t) for k, _, p, t in data if k == g and p is not None and t is not None]
        pairs = [(x, y) for k, x in enumerate(own) for y in own[:k] if x[1] != y[1]]
        loss = sum(max(0, 1.5 - (1 if a[1] > b[1] else -1) * (a[0] - b[0])) for a, b in pairs)
        assert (g in got) == bool(pairs)
        if pairs:
            assert got[g][0] == len(pairs) and abs(got[g][1] - loss) < 1e-6


def test_loops_against_a_plain_search(spark):
    r = random.Random(9)
    words = [[r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 30))] for _ in range(60)] + [["x", None] * 4, list("abcde" * 3) + list("fgh"), [f"w{i}" for i in range(50)]]

    def plain(t):
        if not t:
            return None
        if any(t[i : i + n] * 4 == t[i : i + 4 * n] for n in range(1, 13) for i in range(len(t) - 4 * n + 1)):
            return "cycle"
        top = max(t.count(w) for w in t)
        if top >= 8 and top >= 0.5 * len(t):
            return "dominant"
        for n in range(2, min(12, len(t) // 4) + 1):
            for gram in {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}:
                i = times = 0
                while i <= len(t) - n:
                    hit = tuple(t[i : i + n]) == gram
                    times, i = times + hit, i + (n if hit else 1)
                if times >= 4 and times * n >= 0.6 * len(t):
                    return "periodic"
        return None

    df = spark.createDataFrame(list(enumerate(words)), "i int, t array<string>")
    assert {x.i: x.k for x in df.select("i", Q.loop_kind(F.col("t")).alias("k")).collect()} == {i: plain(t) for i, t in enumerate(words)}


def test_summaries_are_not_a_file_an_experiment(spark, tmp_path, monkeypatch):
    from tidemark.plans import build_queries as B
    from tidemark.plans.registry import QUERIES

    monkeypatch.setattr(B, "folder", lambda _, name: f"{tmp_path}/{name}")
    assert QUERIES["f50_experiment_brief"](spark, "/root/testdata/sf0.01").count() == 80
    assert len(list((tmp_path / "summaries").rglob("part-*"))) < 50


def test_confusion_networks_of_many_keys(spark):
    """Each key's rows are those of its network alone, also where keys have no slots; both groupings of the query lie on one shuffle."""
    r = random.Random(3)
    phones = lambda: [r.randint(0, 4) for _ in range(r.choice([0, 1, 2, 5, 30]))]
    data = [(f"k{k}", rank, h, [r.random() for _ in h], r.random()) for k in range(50) for rank in range(r.randint(1, 4)) for h in [phones()]]
    rows = spark.createDataFrame(data, "key string, rank int, h array<int>, q array<double>, w double")
    want = {}
    for k in {d[0] for d in data}:
        own = sorted(d for d in data if d[0] == k)
        net = A.confusion_network([list(zip(d[2], d[3], strict=True)) for d in own], [d[4] for d in own], 5)
        want |= {(k, s): p for s, p in enumerate(net.tolist())}
    got = A.confusion_rows(rows, "key", "rank", "h", "q", "w", 5).collect()
    assert {(x.key, x.slot): x.posterior for x in got} == want and len(got) == len(want)

    from __spark_entry__ import queries

    plan = queries()["j8_j9_k11_confusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
