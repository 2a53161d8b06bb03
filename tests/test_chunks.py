"""Alignments against all alignments, targets and chunk rows against plain loops."""

import math
import os
import random
import time
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import aligned as A
from tidemark.operators.align import edit_pairs
from tidemark.plans import chunk_queries  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES
from tidemark.streaming import chunk_rows as K
from tidemark.streaming import commits as C

from .compare import TABLES, connect, rows


def test_alignment_is_the_table_s(spark):
    r = random.Random(1)
    data = [([r.choice("abc") for _ in range(r.randint(0, 7))], [r.choice("abc") for _ in range(r.randint(0, 7))]) for _ in range(150)] + [(None, ["a"]), ([], None), (["a"] * 60, ["a", "b"] * 30)]
    for row in spark.createDataFrame(data, "a array<string>, b array<string>").select("a", "b", A.edit_alignment(F.col("a"), F.col("b")).alias("r")).collect():
        assert [tuple(p) for p in row.r.pairs] == edit_pairs(row.a or [], row.b or [])


def test_short_tables_are_filled_as_long_ones():
    from tidemark.operators import align

    r = random.Random(8)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 8))] for _ in range(2))
        bonus = None if r.random() < 0.5 else np.array([[r.random() for _ in b] for _ in a]).reshape(len(a), len(b))
        x, y = ([ord(c) for c in w] for w in (a, b))
        few, many = align._few_moves(x, y, 1.0, bonus), align._moves(x, y, 1.0, bonus).tolist()
        assert [m[1:] for m in few[1:]] == [m[1:] for m in many[1:]]


def test_rewards_against_all_alignments(spark):
    r = random.Random(2)
    span = lambda: (a := r.random() * 4, a + r.random() * 3)
    data = []
    for _ in range(120):
        n, m = r.randint(0, 5), r.randint(0, 5)
        data.append(([r.choice("ab") for _ in range(n)], [r.choice("ab") for _ in range(m)], [span() for _ in range(n)], [span() for _ in range(m)], [r.uniform(-0.5, 1.5) for _ in range(m)]))
    schema = "a array<string>, b array<string>, s array<struct<start:double,end:double>>, t array<struct<start:double,end:double>>, c array<double>"
    reward = A.overlap_and_confidence(F.col("s"), F.col("t"), F.col("c"))
    for row in spark.createDataFrame(data, schema).select("*", A.edit_alignment(F.col("a"), F.col("b"), reward=reward).alias("r")).collect():

        def pair(i, j, row=row):
            (a0, a1), (b0, b1) = row.s[i], row.t[j]
            share = max(0.0, min(a1, b1) - max(a0, b0)) / (max(a1, b1) - min(a0, b0))
            return max(0.0, (row.a[i] != row.b[j]) - 0.3 * share - 0.1 * min(max(row.c[j], 0), 1))

        @cache
        def best(i, j, row=row, pair=pair):
            if i == len(row.a) or j == len(row.b):
                return len(row.a) - i + len(row.b) - j
            return min(pair(i, j) + best(i + 1, j + 1), 1 + best(i + 1, j), 1 + best(i, j + 1))

        cost = sum(pair(p.a, p.b) if p.a is not None and p.b is not None else 1 for p in row.r.pairs)
        assert math.isclose(row.r.cost, best(0, 0), abs_tol=1e-9) and math.isclose(cost, best(0, 0), abs_tol=1e-9)
        assert [p.a for p in row.r.pairs if p.a is not None] == list(range(len(row.a))) and [p.b for p in row.r.pairs if p.b is not None] == list(range(len(row.b)))


def test_slot_targets(spark):
    phones = ["AA", "B", "K"]
    truth = [("AA", 2.0, 0, 9.0, 10.0, 8.0), ("B", 1.0, 0, 9.0, 10.0, 8.0), ("K", 0.5, 1, 4.0, 5.0, 4.0), ("ZZ", 1.0, 1, 4.0, 5.0, 4.0)]
    slots = [("AA", [0.8, 0.1, 0.1, 0.0], [0.9, 0.0, 0.1, 0.0], 0.1, True), ("K", [0.1, 0.3, 0.6, 0.0], [0.1, 0.1, 0.8, 0.0], 0.2, True), ("K", [0.2, 0.2, 0.6, 0.0], [0.1, 0.1, 0.8, 0.0], 0.9, False), (None, [0.25] * 4, [0.25] * 4, 0.9, True)]
    t = "array<struct<phone:string,phone_score:double,word_id:int,accuracy:double,stress:double,total:double>>"
    s = "array<struct<phone:string,posterior:array<double>,support:array<double>,divergence:double,committed:boolean>>"
    df = spark.createDataFrame([(truth, slots, [0]), ([], slots, []), (truth, [], [0])], f"t {t}, s {s}, w array<int>")
    rows = [r.x for r in df.select(A.slot_targets(F.col("t"), F.col("s"), phones, F.col("w")).alias("x")).collect()]
    first, second, third, last = rows[0]
    h = lambda p: -sum(x * math.log(x) for x in p if x > 0) / math.log(len(p))
    close = lambda got, want: all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want, strict=True))
    u = h(slots[0][1])
    assert close(first, (0, 2.0, 9.0, 10.0, 8.0, 0, 1, u, 1.0, (1 - u) * 0.9, 1, 0, 1))
    u = h(slots[1][1])  # another phone than the truth's, so the truth's posterior weighs and low support makes it abstain
    assert close(second, (1, 1.0, 9.0, 10.0, 8.0, 0, 0, u, 0.3, 0.3 * (1 - u) * 0.1, 1, 1, 1))
    assert close(third, (2, 0.5, 4.0, 5.0, 4.0, 1, 0, 1.0, 0.0, 0.0, 0, 0, 0))  # its word isn't seen, and it isn't committed
    blank = (-1,) * 6 + (0, 1.0, 0, 0, 0, 0, 0)
    assert close(last, blank) and all(close(x, blank) for x in rows[1]) and rows[2] == []


def test_targets_align_a_row_once(spark):
    n = 40
    item = lambda i: F.lit("abc"[i % 3])
    t = F.array(*[F.struct(item(i).alias("phone"), F.lit(1.0).alias("phone_score"), F.lit(0).alias("word_id"), F.lit(1.0).alias("accuracy"), F.lit(1.0).alias("stress"), F.lit(1.0).alias("total")) for i in range(n)])
    p = F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))
    s = F.array(*[F.struct(item(i * i).alias("phone"), p.alias("posterior"), p.alias("support"), F.lit(0.1).alias("divergence"), F.lit(True).alias("committed")) for i in range(n)])
    df = spark.range(8).select("id", t.alias("t"), s.alias("s"), F.array(F.lit(0)).alias("w")).localCheckpoint()
    aligned = A.edit_alignment(F.col("t")["phone"], F.col("s")["phone"])
    targets = A.slot_targets(F.col("t"), F.col("s"), ["a", "b"], F.col("w"))

    def seconds(value):
        began = time.perf_counter()
        df.select(value.alias("v")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(targets), seconds(aligned)
    assert seconds(targets) < 8 * max(seconds(aligned), 0.2)  # 40 times as long if each slot aligns anew


def test_costs_round_as_in_sql(spark, tmp_path):
    folder = "/root/testdata/sf0.1"
    spark.read.parquet(f"{folder}/lineitem.parquet").where("l_orderkey = 81072").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in set(TABLES) - {"lineitem"}:
        os.symlink(f"{folder}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    got = QUERIES["e24_reward_alignment"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(connect(str(tmp_path)).sql(ORACLE_SQL["e24_reward_alignment"]).df()) and len(got) == 1


def test_gaps_are_compared_before_they_are_added(spark, tmp_path):
    folder = "/root/testdata/sf0.1"
    # the costs before two gaps differ by their last bit, which is lost when 1 is added: partkey, number, quantity, discount, flag, status
    lines = [(8408, 1, 33, 0.0, "N", "F"), (11097, 2, 20, 0.02, "A", "O"), (5158, 3, 23, 0.03, "A", "O"), (12318, 4, 35, 0.03, "R", "O"), (408, 5, 3, 0.07, "R", "F"), (11103, 5, 16, 0.09, "N", "O")]
    names = ["l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    types = spark.read.parquet(f"{folder}/lineitem.parquet").schema
    spark.createDataFrame([(1, *x) for x in lines], ["l_orderkey", *names]).select(*[F.col(c).cast(types[c].dataType) for c in ["l_orderkey", *names]]).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in set(TABLES) - {"lineitem"}:
        os.symlink(f"{folder}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    got = QUERIES["e24_reward_alignment"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(connect(str(tmp_path)).sql(ORACLE_SQL["e24_reward_alignment"]).df()) and len(got) == 1


def brute_commits(chunks):
    """By chunk: cumulative, new and dropped of ``[(slot, token, word, candidate)]``, carried from chunk to chunk."""
    out, before = [], {}
    for items in chunks:
        mapped = {s for s, token, _, _ in items if before.get(s) == token}
        cumulative = {s for s, _, _, c in items if c or s in mapped}
        new = set()
        for word in {w for _, _, w, _ in items if w is not None}:
            own = [(s, c) for s, _, w, c in items if w == word]
            if all(c for _, c in own) and not mapped & {s for s, _ in own}:
                new |= {s for s, _ in own}
        out.append((sorted(cumulative), sorted(new), len(set(before) - mapped)))
        before = {s: token for s, token, _, _ in items if s in cumulative}
    return out


def test_chunk_rows_against_a_loop(spark):
    r = random.Random(5)
    utts = {u: [[(s, r.choice("xy"), r.choice([None, s // 2]), r.random() < 0.4) for s in range(6) if r.random() < 0.85] for _ in range(5)] for u in ("a", "b")}
    data = [(u, c, *i) for u, chunks in utts.items() for c, items in enumerate(chunks) for i in items]
    rows = K.committed_slots(spark.createDataFrame(data, "u string, chunk int, slot int, token string, word int, candidate boolean"), "u", "chunk", "slot", "token", "word", "candidate")
    chunks = spark.createDataFrame([(u, c) for u in utts for c in range(5)] + [("none", 0)], "u string, chunk int")
    got = {(x.u, x.chunk): x for x in K.chunk_rows(chunks, rows, "u", "chunk", "slot", "token", "word").collect()}
    assert len(got) == 11 and got["none", 0].slots == [] and got["none", 0].stability == 1
    for u, items in utts.items():
        for c, (cumulative, new, dropped) in enumerate(brute_commits(items)):
            x = got[u, c]
            assert [s.slot for s in x.slots if s.cumulative] == cumulative and [s.slot for s in x.slots if s.new] == new and x.dropped == dropped
            assert x.new_words == len({s.word for s in x.slots if s.new}) and x.committed_words == len({s.word for s in x.slots if s.cumulative and s.word is not None})


def test_windows_and_visible_slots(spark):
    chunks = C.windows(spark.createDataFrame([("a", 1.5)], "u string, t double"), "u", "t", 0.64, 0.16)
    slots = spark.createDataFrame([("a", k, 0.3 * (k + 1)) for k in range(5)], "u string, slot int, end double")
    seen = K.visible_slots(chunks, slots, "u", "end").groupBy("chunk_id").count().collect()
    assert {r.chunk_id: r["count"] for r in seen} == {0: 2, 1: 4, 2: 5}


def test_tasks_grow_with_the_items(spark, monkeypatch):
    monkeypatch.setattr(K, "ITEMS_PER_TASK", 50)
    chunks = spark.createDataFrame([(u, c, float(c + 1)) for u in range(40) for c in range(4)], "u int, chunk int, audio_end double")
    slots = spark.createDataFrame([(u, k, 0.5 * (k + 1)) for u in range(40) for k in range(8)], "u int, slot int, end double")
    assert K.tasks(chunks, slots, "u") == 26  # 40 users with 4 chunks of 8 slots, by 50
    seen = K.visible_slots(chunks, slots, "u", "end")
    assert seen.rdd.getNumPartitions() == 26 and seen.count() == 40 * (2 + 4 + 6 + 8)


def test_items_of_chunk_rows_are_not_shuffled(spark):
    plan = QUERIES["k11_chunk_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")] and plan.count("Expand") == 0


def test_chunks_without_a_slot_stay(spark):
    chunks = C.windows(spark.createDataFrame([("a", 3.0), ("none", 1.5)], "u string, t double"), "u", "t", 0.64, 0.16)
    slots = spark.createDataFrame([("a", k, k // 2, 1.0 + 0.3 * k, "xy"[k % 2]) for k in range(6)], "u string, slot int, word int, end double, token string")
    out = []
    for every in (False, True):
        seen = K.visible_slots(chunks, slots, "u", "end", every=every).withColumn("candidate", (F.col("end") <= F.col("commit_time") - 0.3) | F.col("is_final"))
        rows = K.committed_slots(seen, "u", "chunk_id", "slot", "token", "word", "candidate")
        out.append(sorted(K.chunk_rows(chunks, rows, "u", "chunk_id", "slot", "token", "word").collect()))
    assert out[0] == out[1] and len(out[1]) == 8 and [len(r.slots) for r in out[1]] == [0, 2, 4, 6, 6, 0, 0, 0]
