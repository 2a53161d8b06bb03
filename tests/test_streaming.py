"""Stateful streams cut anywhere, restarts, the keyed sink and the gate on unfinished keys."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import commits as C
from tidemark.streaming import resume as R
from tidemark.streaming import stateful as S
from tidemark.streaming.drain import drained, in_pieces, latest, run_to_end


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def pieces(spark, data, schema, cuts):
    """``data`` in the order given, cut into triggers before these places."""
    return in_pieces(spark.createDataFrame([(*r, sum(k >= c for c in cuts)) for k, r in enumerate(data)], f"{schema}, piece int"), "piece", len(cuts) + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_gate_cut_anywhere(spark, seed):
    r = random.Random(seed)
    data = [(u, k, r.randint(0, 9), r.randint(0, 9), k == 7) for k in range(8) for u in (1, 2, 3)]
    schema = "u long, k long, eligible long, stable long, final boolean"
    want = rows_of(C.commit_gate(spark.createDataFrame(data, schema), "u", "k", "eligible", "stable", "final").select("u", "k", "committed", "new"))
    cuts = sorted(r.sample(range(1, len(data)), 2))
    sent_twice = data[: cuts[0]] + data[cuts[0] - 4 :]  # the second trigger brings some rows again
    assert rows_of(drained(S.stream_gate(pieces(spark, sent_twice, schema, cuts), "u", "k", "eligible", "stable", "final"), "update")) == want


def test_sums_are_additive(spark):
    data = [(u, float(k), None if k == 3 else 1.5 * k) for k in range(6) for u in ("a", None)]
    schema = "u string, k double, v double"
    whole = rows_of(drained(S.stream_sums(pieces(spark, data, schema, []), "u", "k", "v"), "update").fillna("-"))
    parts = rows_of(drained(S.stream_sums(pieces(spark, data, schema, [3, 8]), "u", "k", "v"), "update").fillna("-"))
    assert whole == parts and ("a", 5.0, 18.0, 5) in whole and ("-", 3.0, 4.5, 3) in whole


@pytest.mark.parametrize("cuts", [[5], [3, 9]])
def test_slot_commits_cut_inside_chunks(spark, cuts):
    r = random.Random(4)
    data = [(u, c, s, s if s < 3 else s - 1, r.random() < 0.6) for c in range(3) for s in range(4) for u in (1, 2)]
    schema = "u long, chunk long, slot long, old long, c boolean"
    rows = spark.createDataFrame(data, schema)
    want = rows_of(C.new_commits(rows, "u", "chunk", "slot", "old", "c").select("u", "chunk", "committed", "new", "dropped"))
    got = latest(S.stream_commits(pieces(spark, data, schema, cuts), "u", "chunk", "slot", "old", "c"), ["u", "chunk"], "seen")
    assert rows_of(got.select("u", "chunk", "committed", "new", "dropped")) == want


def test_restart_after_a_batch_was_written(spark, tmp_path):
    data = [(u, k, float(u * k)) for k in range(9) for u in range(5)]
    stream = S.stream_sums(pieces(spark, data, "u long, k long, v double", [10, 20, 30]), "u", "k", "v")
    sink = R.KeyedSink(f"file://{tmp_path}/sink", ["u"], "k", 3)
    calls = []

    def dies(batch, epoch):
        calls.append(epoch)
        sink(batch, epoch)
        if epoch == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run_to_end(stream, dies, f"file://{tmp_path}/state")
    assert calls == [0, 1, 2]
    again = []
    run_to_end(stream, lambda b, e: (again.append(e), sink(b, e)), f"file://{tmp_path}/state")
    assert again == [2, 3]  # the batch that was written is run again, and no other
    assert rows_of(sink.read(spark, stream.schema)) == [(u, 8, 36.0 * u, 9) for u in range(5)]


def test_keyed_sink(spark, tmp_path):
    schema = "a long, b string, n long, v string"
    sink = R.KeyedSink(f"file://{tmp_path}/sink", ["a", "b"], "n", 4)
    make = lambda *rows: spark.createDataFrame(rows, schema)
    assert sink.read(spark, make().schema).count() == 0 and sink.epochs(spark) == []
    sink(make((1, "x", 1, "old"), (1, None, 5, "null key"), (2, "x", None, "no order")), 0)
    sink(make((1, "x", 3, "new"), (1, "x", 3, "newer"), (3, "y", 1, "third")), 1)
    sink(make((1, "x", 2, "late")), 2)
    want = sorted([(1, None, 5, "null key"), (1, "x", 3, "newer"), (2, "x", None, "no order"), (3, "y", 1, "third")], key=str)
    read = lambda: sorted(map(tuple, sink.read(spark, make().schema).collect()), key=str)
    assert read() == want
    sink(make((1, "x", 2, "late")), 2)  # once more
    sink(make(), 3)
    assert read() == want and sink.epochs(spark) == [0, 1, 2, 3]
    # rows without a list, as after a crash between the two, aren't seen
    make((9, "z", 1, "lost")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"file://{tmp_path}/sink/rows/version=4")
    assert read() == want
    assert sink.vacuum(spark) > 0 and read() == want and sink.epochs(spark) == [3]
    sink(make((9, "z", 1, "found")), 4)
    assert len(read()) == 5


def test_gate_on_unfinished_keys(spark):
    expected = spark.createDataFrame([(k,) for k in range(6)] + [(5,)], "key long")
    records = spark.createDataFrame([(0, "ok", "v2"), (1, "skipped", "v2"), (2, "ok", "v1"), (3, "odd", "v2"), (4, None, "v2"), (99, "ok", "v2")], "key long, status string, schema string")
    assert tuple(R.progress(expected, records, ["key"], "v2").first()) == (6, 1, 1, 1, 3)
    assert {r.key for r in R.remaining(expected, records, ["key"], "v2").collect()} == {2, 3, 4, 5}
    with pytest.raises(R.Unfinished, match="1 of 6 keys are missing and 3 malformed"):
        R.finished(expected, records, ["key"], "v2")
    done = R.finished(expected.where("key < 2"), records, ["key"], "v2")
    assert [tuple(r) for r in done.collect()] == [(0, "ok", "v2")]


def test_idle_keys_are_flushed(spark, tmp_path):
    """A key without a final tick gives its state when its timer ends, and begins anew after that."""
    schema = "u long, k long, v double, final boolean"
    data = [(1, 0, 1.0, False), (1, 1, 2.0, False), (2, 0, 5.0, True)]
    rows = S.online(pieces(spark, data, schema, []), "u", "k", "v", "final", idle_ms=500)
    got = []
    with S.keyed_state(spark):
        q = rows.writeStream.outputMode("update").foreachBatch(lambda b, e: got.extend(map(tuple, b.select("u", "k", "kind", "state_sum", "state_count").collect()))).option("checkpointLocation", f"file://{tmp_path}/state").start()
        until = time.time() + 60
        while len(got) < 4 and time.time() < until:
            time.sleep(0.2)
        q.stop()
    assert sorted(got) == [(1, 0, "tick", 1.0, 1), (1, 1, "flush", 3.0, 2), (1, 1, "tick", 3.0, 2), (2, 0, "final", 5.0, 1)]


def test_masks_of_moving_slots(spark):
    """By hand: an insertion in front moves slots, a revised token drops its commit, whole words alone are new."""
    state, first = C.next_masks(None, ["a", "b", "c"], [0, 0, 1], [True, True, False])
    assert first == {"cumulative": [True, True, False], "new": [True, True, False], "old_slot": [-1, -1, -1], "dropped": 0}
    state, second = C.next_masks(state, ["x", "a", "b", "c"], [0, 1, 1, 2], [True, False, False, True])
    assert second == {"cumulative": [True, True, True, True], "new": [True, False, False, True], "old_slot": [-1, 0, 1, 2], "dropped": 0}
    state, third = C.next_masks(state, ["x", "a", "z", "c"], [0, 1, 1, None], [False, False, True, False])
    assert third == {"cumulative": [True, True, True, True], "new": [False] * 4, "old_slot": [0, 1, -1, 3], "dropped": 1}
    assert C.next_masks(state, [], [], [])[1] == {"cumulative": [], "new": [], "old_slot": [], "dropped": 4}
    r = random.Random(9)
    data = [(u, k, [r.choice("abc") for _ in range(n)], [s // 2 for s in range(n)], [r.random() < 0.5 for _ in range(n)]) for u in (1, 2) for k in range(6) if (n := r.randint(0, 6)) >= 0]
    schema = "u long, k long, tokens array<string>, words array<int>, candidate array<boolean>"
    want = rows_of(C.chunk_masks(spark.createDataFrame(data, schema), "u", "k", "tokens", "words", "candidate"))
    got = rows_of(drained(S.stream_masks(pieces(spark, sorted(data, key=lambda d: d[1]), schema, [4, 5]), "u", "k", "tokens", "words", "candidate"), "update"))
    assert got == want and len(want) == 12


def test_pieces_by_key_are_written_and_read_by_many_tasks(spark, tmp_path):
    data = [(u, k, float(k), k // 3) for k in range(9) for u in range(40)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = in_pieces(spark.createDataFrame(data, "u long, k long, v double, piece int"), "piece", 3, "u")
        seen = []
        stream = stream.withColumn("file", F.input_file_name())
        run_to_end(stream, lambda batch, epoch: seen.append(batch.select("u", "k", "file").collect()), f"file://{tmp_path}/state")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(seen) == 3 and all(len({r.file for r in b}) > 1 for b in seen)
    assert [{r.k for r in b} for b in seen] == [{0, 1, 2}, {3, 4, 5}, {6, 7, 8}] and sum(map(len, seen)) == len(data)
    assert all(len({r.file for r in b if r.u == u}) == 1 for b in seen for u in range(40))


def test_keys_share_the_state_of_their_group(spark, tmp_path):
    """As many states as groups, however many keys; keys beyond 2^53 stay apart, beside a null key too."""
    keys = [2**53 + u for u in range(3000)] + [None]
    data = [(u, k, 1.0) for k in range(4) for u in keys]
    stream = S.stream_sums(pieces(spark, data, "u long, k long, v double", [len(keys) * 2]), "u", "k", "v")
    got = []
    with S.keyed_state(spark):
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, e: got.extend(map(tuple, b.collect()))).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 1024
    assert sorted(got, key=str) == sorted([(u, k, k + 1.0, k + 1) for u in keys for k in range(4)], key=str)


class Held:
    """A value of a state, without Spark."""

    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.ms


def test_each_key_of_a_group_has_its_own_time_to_live():
    p = S._Sums("u", "k", "v", 100)
    p.held = Held()

    def tick(now, *rows):
        frame = pd.DataFrame(rows, columns=["u", "k", "v"]).assign(key_is_null=False)
        return [tuple(r) for f in p.handleInputRows((0,), iter([frame]), Now(now)) for r in f.itertuples(index=False)]

    assert tick(0, ("a", 1, 1.0), ("b", 1, 5.0)) == [("a", 1, 1.0, 1), ("b", 1, 5.0, 1)]
    assert tick(60, ("a", 2, 1.0)) == [("a", 2, 2.0, 2)]
    assert tick(120, ("a", 2, 9.0)) == []  # sent twice: nothing is returned
    assert tick(140, ("b", 2, 5.0), ("a", 3, 1.0)) == [("b", 2, 5.0, 1), ("a", 3, 3.0, 3)]  # b began anew, a went on


def test_a_trigger_has_few_tasks(spark):
    from tidemark.streaming.stateful import TASKS_PER_CORE, keyed_state

    before = spark.conf.get("spark.sql.shuffle.partitions")
    most = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    try:
        for given, want in ((10 * most, most), (2, 2)):
            spark.conf.set("spark.sql.shuffle.partitions", str(given))
            with keyed_state(spark):
                assert int(spark.conf.get("spark.sql.shuffle.partitions")) == want
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == given
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
