"""Sequence features, commit windows and state on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import joins as J
from tidemark.operators import metrics as M
from tidemark.operators import sequence as Q
from tidemark.streaming import commits as C

from .registry import Tables, query

_K = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_ISL = f"(SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY k) - 1 AS island FROM (SELECT *, CASE WHEN k > 0 AND event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY k) THEN 0 ELSE 1 END AS chg FROM {_K}))"


def _ev(t: Tables) -> DataFrame:
    return Q.schedule(t.events.select("user_id", "event_id", "ts", "event_type", "value"), "user_id", ["ts", "event_id"]).withColumnRenamed("schedule_index", "k")


@query(f"SELECT user_id, island, any_value(event_type) AS event_type, count(*) AS len, round(avg(value), 6) AS mean FROM {_ISL} GROUP BY 1, 2")
def g1_g21_islands(t: Tables) -> DataFrame:
    rows = Q.islands(_ev(t), "user_id", ["k"], "event_type")
    return rows.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count("*").alias("len"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"SELECT user_id, event_id, k AS schedule_index, n AS schedule_count, round((k + 1) * 1.0::DOUBLE / n, 6) AS progress, lag(event_id) OVER (PARTITION BY user_id ORDER BY k) AS previous FROM {_K}")
def g2_g3_g4_schedule(t: Tables) -> DataFrame:
    prev = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("k"))
    return _ev(t).select("user_id", "event_id", F.col("k").cast("long").alias("schedule_index"), "schedule_count", F.round("progress", 6).alias("progress"), prev.alias("previous"))


@query(f"SELECT user_id, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.9), 6) AS p90 FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY k)) AS d FROM {_K}) WHERE d IS NOT NULL GROUP BY 1")
def g5_delta(t: Tables) -> DataFrame:
    d = _ev(t).select("user_id", Q.delta("value", "user_id", ["k"]).alias("d")).where("d IS NOT NULL")
    return d.groupBy("user_id").agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.percentile("d", F.lit(0.9)), 6).alias("p90"))


@query(
    f"WITH d AS (SELECT user_id, k, (k + 1) * 1.0::DOUBLE / n AS p, abs(value - last_value(value) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS d FROM {_K}), r AS (SELECT *, min(CASE WHEN d <= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM d) SELECT user_id, round(coalesce(min(CASE WHEN rest = 1 THEN p END), 1), 6) AS stable_from, min(CASE WHEN d <= 15 THEN k END) AS first_stable, round(avg(d), 6) AS mean_distance FROM r GROUP BY 1"
)
def g6_g7_g8_convergence(t: Tables) -> DataFrame:
    c = Q.convergence(_ev(t), "user_id", ["k"], "progress", "value", 15.0)
    return c.select("user_id", F.round("stable_from", 6).alias("stable_from"), F.col("first_stable").cast("long").alias("first_stable"), F.round("mean_distance", 6).alias("mean_distance"))


@query(
    f"WITH b AS (SELECT user_id, k // 4 AS chunk, k % 4 AS slot, value FROM {_K}) SELECT user_id, round(avg(CASE WHEN abs(a.value - b.value) > 5 THEN 1.0 ELSE 0.0 END), 6) AS revised, count(*) AS n FROM b a JOIN b USING (user_id, slot) WHERE a.chunk = b.chunk - 1 GROUP BY 1"
)
def g9_revision(t: Tables) -> DataFrame:
    rows = _ev(t).select("user_id", F.floor(F.col("k") / 4).alias("chunk"), (F.col("k") % 4).alias("slot"), "value")
    met = J.previous_slot(rows, "user_id", "chunk", "slot", "slot", "value").where("previous IS NOT NULL")
    return met.groupBy("user_id").agg(F.round(F.avg((F.abs(F.col("value") - F.col("previous")) > 5).cast("double")), 6).alias("revised"), F.count("*").alias("n"))


@query(
    "SELECT conv_id, turn, CASE WHEN p IS NULL THEN 0 ELSE len(list_filter(range(1, 1 + least(len(w), len(p))), lambda i: w[1:i] = p[1:i])) END AS shared FROM (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, string_split(text, 'e') AS w FROM conversations))"
)
def g10_stable_prefix(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.split("text", "e").alias("w"))
    rows = rows.withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", F.coalesce(V.common_prefix(F.col("w"), F.col("p")), F.lit(0)).cast("long").alias("shared"))


@query("SELECT conv_id, turn, md5(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS prompt FROM conversations")
def g11_k3_prompt(t: Tables) -> DataFrame:
    prompt = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("prompt"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity - avg(l_quantity) OVER w, 5) AS minus_mean, round(l_quantity / avg(l_quantity) OVER w, 5) AS ratio, count(*) OVER w AS size FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def g12_g13_relative(t: Tables) -> DataFrame:
    out = Q.relative_to_group(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("minus_mean", 5).alias("minus_mean"), F.round("ratio", 5).alias("ratio"), "size")


@query(f"WITH r AS (SELECT *, count(*) OVER (PARTITION BY user_id, island) AS len FROM {_ISL}), m AS (SELECT *, CASE WHEN event_type = 'view' AND len >= 2 THEN 0 ELSE 1 END AS keep FROM r) SELECT user_id, count(*) AS n FROM (SELECT *, max(keep) OVER (PARTITION BY user_id) AS have FROM m) WHERE keep = 1 OR have = 0 GROUP BY 1")
def g15_silence(t: Tables) -> DataFrame:
    return Q.drop_long_runs(_ev(t), "user_id", ["k"], "event_type", "view", 2).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    f"WITH q AS (SELECT user_id, k, value < 20 AS quiet FROM {_K}), i AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY k) AS island FROM (SELECT *, CASE WHEN quiet = lag(quiet) OVER (PARTITION BY user_id ORDER BY k) THEN 0 ELSE 1 END AS chg FROM q)), r AS (SELECT user_id, island, count(*) AS len FROM i WHERE quiet GROUP BY 1, 2) SELECT u.user_id, count(len) AS pause_count, round(coalesce(max(len) * 0.02, 0), 6) AS longest_pause FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id) GROUP BY 1"
)
def g16_pauses(t: Tables) -> DataFrame:
    out = Q.pauses(_ev(t).withColumn("quiet", F.col("value") < 20), "user_id", ["k"], "quiet", 0.02)
    return out.select("user_id", "pause_count", F.round("longest_pause", 6).alias("longest_pause"))


@query(f"SELECT user_id, bool_or(e0 = e1 AND e1 = e2) AS cyclic FROM (SELECT user_id, event_type AS e0, lead(event_type) OVER w AS e1, lead(event_type, 2) OVER w AS e2 FROM {_K} WINDOW w AS (PARTITION BY user_id ORDER BY k)) GROUP BY 1")
def g17_d9_cycles(t: Tables) -> DataFrame:
    g = _ev(t).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("k", "event_type")))["event_type"].alias("e"))
    return g.select("user_id", V.has_cycle(F.col("e"), 3, 1).alias("cyclic"))


@query(f"SELECT user_id, k, round(avg(value) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS local FROM {_K}")
def g18_local_frame(t: Tables) -> DataFrame:
    return _ev(t).select("user_id", F.col("k").cast("long").alias("k"), F.round(Q.local_mean("value", "user_id", ["k"], 4), 6).alias("local"))


@query(f"WITH r AS (SELECT * FROM {_K}) SELECT a.user_id, a.k, count(*) AS seen, round(sum(b.value), 5) AS seen_sum FROM r a JOIN r b ON a.user_id = b.user_id AND b.k <= (a.k // 4 + 1) * 4 - 1 + 2 GROUP BY 1, 2")
def g19_block_frame(t: Tables) -> DataFrame:
    out = Q.block_visible(_ev(t), "user_id", "k", "value", 4, 2)
    return out.select("user_id", F.col("k").cast("long").alias("k"), "seen", F.round("seen_sum", 5).alias("seen_sum"))


@query(
    f"WITH b AS (SELECT user_id, arg_max(value, k) AS final, avg(value) AS human FROM {_K} GROUP BY 1), a AS (SELECT user_id, bin, arg_max(value, k) AS v FROM {_K} JOIN (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS bin) ON (k + 1) * 1.0::DOUBLE / n <= bin + 1e-9 GROUP BY 1, 2) SELECT bin, count(*) AS n, round(avg(abs(v - human)), 6) AS mae_human, round(avg(abs(v - final)), 6) AS mae_final, round(CASE WHEN stddev_pop(v) > 1e-12 AND stddev_pop(human) > 1e-12 THEN covar_pop(v, human) / (stddev_pop(v) * stddev_pop(human)) END, 6) AS pcc FROM a JOIN b USING (user_id) GROUP BY 1"
)
def f32_f33_prefix_coverage(t: Tables) -> DataFrame:
    ev = _ev(t)
    ends = ev.groupBy("user_id").agg(F.max_by("value", "k").alias("final"), F.avg("value").alias("human"))
    bins = J.as_of_bins(ev, "user_id", "progress", "value", (0.25, 0.5, 0.75, 1.0)).join(ends, "user_id")
    d = lambda c: F.round(F.avg(F.abs(F.col("value") - F.col(c))), 6)
    return bins.groupBy("bin").agg(F.count("*").alias("n"), d("human").alias("mae_human"), d("final").alias("mae_final"), F.round(M.safe_corr("value", "human"), 6).alias("pcc"))


_DUR = "(SELECT user_id, count(*) * 0.3::DOUBLE AS t FROM events GROUP BY 1)"


def _durations(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg((F.count("*") * F.lit(0.3)).alias("t"))


_WIN = f"(SELECT user_id, chunk - 1 AS chunk_id, CASE WHEN chunk = n THEN t ELSE chunk * 0.64::DOUBLE END AS commit_time, CASE WHEN chunk = n THEN t ELSE least(t, chunk * 0.64::DOUBLE + 0.16) END AS audio_end, chunk = n AS is_final FROM (SELECT user_id, t, n, unnest(range(1, n + 1)) AS chunk FROM (SELECT user_id, t, greatest(CAST(ceil(t / 0.64 - 1e-6) AS BIGINT), 1) AS n FROM {_DUR})))"


@query(f"SELECT user_id, chunk_id, round(commit_time, 6) AS commit_time, round(audio_end, 6) AS audio_end, is_final, chunk_id = 0 AS state_reset, chunk_id - 1 AS previous_chunk_id FROM {_WIN}")
def k1_k9_windows(t: Tables) -> DataFrame:
    w = C.windows(_durations(t), "user_id", "t", 0.64, 0.16)
    return w.select("user_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.round("commit_time", 6).alias("commit_time"), F.round("audio_end", 6).alias("audio_end"), "is_final", "state_reset", F.col("previous_chunk_id").cast("long").alias("previous_chunk_id"))


@query(f"WITH w AS (SELECT user_id, (k + 1) * 0.3::DOUBLE AS e FROM {_K}) SELECT c.user_id, chunk_id, (SELECT count(*) FROM w WHERE w.user_id = c.user_id AND w.e <= c.commit_time + 1e-6) AS committed, (SELECT count(*) FROM w WHERE w.user_id = c.user_id AND w.e <= c.audio_end + 1e-6) AS visible FROM {_WIN} c")
def k2_k5_k12_visibility(t: Tables) -> DataFrame:
    words = _ev(t).select("user_id", ((F.col("k") + 1) * F.lit(0.3)).alias("e"))
    out = C.visibility(C.windows(_durations(t), "user_id", "t", 0.64, 0.16), words, "user_id", "e")
    return out.select("user_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("committed").cast("long").alias("committed"), F.col("visible").cast("long").alias("visible"))


@query(
    f"WITH c AS (SELECT user_id, k, max(CASE WHEN k = n - 1 THEN k + 1 ELSE least(k + 1, CAST(floor(value / 10) AS BIGINT)) END) OVER (PARTITION BY user_id ORDER BY k) AS committed FROM {_K}) SELECT user_id, k, committed, committed - coalesce(lag(committed) OVER (PARTITION BY user_id ORDER BY k), 0) AS new FROM c"
)
def k4_commit_gate(t: Tables) -> DataFrame:
    rows = _ev(t).select("user_id", F.col("k").cast("long").alias("k"), (F.col("k") + 1).cast("long").alias("eligible"), F.floor(F.col("value") / 10).alias("stable"), (F.col("k") + 1 == F.col("schedule_count")).alias("final"))
    return C.commit_gate(rows, "user_id", "k", "eligible", "stable", "final").select("user_id", "k", "committed", "new")


@query(
    f"WITH b AS (SELECT user_id, k // 4 AS chunk, k % 4 AS slot, value > 15 AS c FROM {_K}), x AS (SELECT user_id, chunk, count(*) FILTER (c) AS committed FROM b GROUP BY 1, 2), y AS (SELECT b.user_id, b.chunk, count(*) AS kept FROM b JOIN b a ON a.user_id = b.user_id AND a.slot = b.slot AND a.chunk = b.chunk - 1 WHERE a.c AND b.c GROUP BY 1, 2) SELECT x.user_id, x.chunk, x.committed, x.committed - coalesce(kept, 0) AS new, coalesce(p.committed, 0) - coalesce(kept, 0) AS dropped FROM x LEFT JOIN y USING (user_id, chunk) LEFT JOIN x p ON p.user_id = x.user_id AND p.chunk = x.chunk - 1"
)
def k6_k7_new_commits(t: Tables) -> DataFrame:
    rows = _ev(t).select("user_id", F.floor(F.col("k") / 4).alias("chunk"), (F.col("k") % 4).alias("slot"), (F.col("k") % 4).alias("old"), (F.col("value") > 15).alias("c"))
    return C.new_commits(rows, "user_id", "chunk", "slot", "old", "c")


@query(f"SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY k), 5) AS state_sum, k + 1 AS state_count FROM {_K}")
def k8_k10_running_state(t: Tables) -> DataFrame:
    out = C.running_state(_ev(t), "user_id", ["k"], "value")
    return out.select("user_id", "event_id", F.round("state_sum", 5).alias("state_sum"), "state_count")


@query("SELECT user_id, round(sum(value), 5) AS state_sum, count(*) AS state_count FROM events GROUP BY 1")
def k8_k13_k14_stream_state(t: Tables) -> DataFrame:
    """The streaming form: the last state of each key after all rows have come through a stream."""
    from tidemark.streaming.drain import drained

    schema = t.events.schema
    rows = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{t.folder}/events.parquet*")
    states = drained(C.stream_state(rows, "user_id", "event_id", "value"), "update")
    last = states.groupBy("user_id").agg(F.max_by("state_sum", "state_count").alias("state_sum"), F.max("state_count").alias("state_count"))
    return last.select("user_id", F.round("state_sum", 5).alias("state_sum"), "state_count")


@query("SELECT event_type, ts_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS ts_start, value FROM events) GROUP BY 1, 2")
def k_tumbling_stream(t: Tables) -> DataFrame:
    from tidemark.streaming.drain import drained

    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(C.stream_windows(rows, "ts", "value", "1 hour", "10 minutes", ["event_type"]), "complete")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("ts_start"), "n", F.round("total", 4).alias("total"))


def replies(t: Tables) -> DataFrame:
    """``reply, before, text``: every turn but the first of a conversation, with the text of the turn before; null texts are empty."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    text = F.coalesce("text", F.lit(""))
    rows = t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("reply"), F.lag(text).over(turns).alias("before"), text.alias("text"))
    return rows.where("before IS NOT NULL")


@query()
def e23_lcs_align(t: Tables) -> DataFrame:
    from tidemark.operators.align import align_rows

    words = lambda c: F.split(F.lower(F.col(c)), " ")
    pairs = replies(t).select("reply", words("before").alias("a"), words("text").alias("b"))
    return align_rows(pairs, "reply", "a", "b", "lcs")


@query()
def e24_e28_edit_align(t: Tables) -> DataFrame:
    from tidemark.operators.align import align_rows

    words = lambda c: F.split(F.lower(F.col(c)), " ")
    pairs = replies(t).select("reply", words("before").alias("a"), words("text").alias("b"))
    return align_rows(pairs, "reply", "a", "b", "edit")


@query()
def e25_o18_viterbi(t: Tables) -> DataFrame:
    from tidemark.operators.align import viterbi_rows

    e = t.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform(F.slice("embedding", i * 4 + 1, F.lit(4)), lambda x: x.cast("double"))).alias("m"))
    return viterbi_rows(e, "vec_id", "m")


@query()
def j8_j9_k11_confusion(t: Tables) -> DataFrame:
    from tidemark.operators.align import confusion_rows

    rows = t.lineitem.repartition("l_orderkey")  # one shuffle for both groupings
    rows = rows.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 5).cast("int").alias("p"), (F.col("l_discount") * 10).alias("q")))).alias("x"))
    hyps = rows.select("l_orderkey", F.ascii("l_returnflag").alias("rank"), F.col("x.p").alias("hyp"), F.col("x.q").alias("quality"), (1.0 / F.size("x")).alias("weight"))
    return confusion_rows(hyps, "l_orderkey", "rank", "hyp", "quality", "weight", 5)
