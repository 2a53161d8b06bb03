"""The streaming forms of gates, slot commits and states, resumed builds, and the online loop; their SQL is that of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import folder
from tidemark.streaming import resume as R
from tidemark.streaming import stateful as S
from tidemark.streaming.drain import drained, in_pieces, latest, run_to_end

from .registry import ORACLE_SQL, Tables, query
from .sequence_queries import _K, _ev

#: Triggers that the input is cut into.
PIECES = 3


def _ticks(t: Tables) -> DataFrame:
    """The events of a user, numbered, in pieces by that number."""
    ev = _ev(t)
    return ev.withColumn("piece", F.floor(F.col("k") * PIECES / F.col("schedule_count")))


@query(ORACLE_SQL["k4_commit_gate"])
def k4_stream_gate(t: Tables) -> DataFrame:
    rows = _ticks(t).select("piece", "user_id", F.col("k").cast("long").alias("k"), (F.col("k") + 1).cast("long").alias("eligible"), F.floor(F.col("value") / 10).alias("stable"), (F.col("k") + 1 == F.col("schedule_count")).alias("final"))
    return drained(S.stream_gate(in_pieces(rows, "piece", PIECES, "user_id"), "user_id", "k", "eligible", "stable", "final"), "update")


@query(ORACLE_SQL["k6_k7_new_commits"])
def k6_k7_stream_commits(t: Tables) -> DataFrame:
    rows = _ticks(t).select("piece", "user_id", F.floor(F.col("k") / 4).alias("chunk"), (F.col("k") % 4).alias("slot"), (F.col("k") % 4).alias("old"), (F.col("value") > 15).alias("c"))
    out = latest(S.stream_commits(in_pieces(rows, "piece", PIECES, "user_id"), "user_id", "chunk", "slot", "old", "c"), ["user_id", "chunk"], "seen")
    return out.drop("seen")


@query(
    f"WITH e AS (SELECT user_id, k AS e, event_id, value FROM {_K}), r AS (SELECT a.user_id, a.e AS k, b.e, (a.e + b.e) % 3 = 0 AND b.value > 5 AS c FROM e a JOIN e b ON a.user_id = b.user_id AND b.e BETWEEN a.e - 4 AND a.e WHERE a.e >= 4), u AS (SELECT *, bool_or(c) OVER (PARTITION BY user_id, e ORDER BY k) AS cum FROM r), m AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY user_id, e ORDER BY k), false) AS mapped FROM u), "
    "n AS (SELECT *, bool_and(c) OVER w AND NOT bool_or(mapped) OVER w AS new FROM m WINDOW w AS (PARTITION BY user_id, k, e // 2)), g AS (SELECT user_id, k, string_agg(CASE WHEN cum THEN '1' ELSE '0' END, '' ORDER BY e) AS cumulative, string_agg(CASE WHEN new THEN '1' ELSE '0' END, '' ORDER BY e) AS new, bool_or(cum AND e = k - 4) AS first FROM n GROUP BY 1, 2) SELECT user_id, k, cumulative, new, CASE WHEN lag(first) OVER (PARTITION BY user_id ORDER BY k) THEN 1 ELSE 0 END AS dropped, CASE WHEN k = 4 THEN '-1,-1,-1,-1,-1' ELSE '1,2,3,4,-1' END AS old_slot FROM g"
)
def k6_k11_stream_masks(t: Tables) -> DataFrame:
    """A window of five events that moves on by one: each chunk's slots lie one place further left, and the first is gone."""
    w = Window.partitionBy("user_id").orderBy("k").rowsBetween(-4, 0)
    ev = _ticks(t).select("piece", "user_id", F.col("k").cast("long").alias("k"), "event_id", "value")
    item = F.collect_list(F.struct("k", "event_id", "value")).over(w)
    rows = ev.select("piece", "user_id", "k", item.alias("x")).where("k >= 4")
    candidate = F.transform("x", lambda e: ((e["k"] + F.col("k")) % 3 == 0) & (e["value"] > 5))
    rows = rows.select("piece", "user_id", "k", F.col("x.event_id").alias("tokens"), F.transform("x", lambda e: F.floor(e["k"] / 2).cast("int")).alias("words"), candidate.alias("candidate"))
    out = drained(S.stream_masks(in_pieces(rows, "piece", PIECES, "user_id"), "user_id", "k", "tokens", "words", "candidate"), "update")
    mask = lambda c: F.array_join(F.transform(c, lambda v: F.when(v, "1").otherwise("0")), "").alias(c)
    return out.select("user_id", "k", mask("cumulative"), mask("new"), "dropped", F.array_join(F.transform("old_slot", lambda v: v.cast("string")), ",").alias("old_slot"))


@query(f"SELECT user_id, k, round(sum(value) OVER (PARTITION BY user_id ORDER BY k), 5) AS state_sum, k + 1 AS state_count FROM {_K}")
def k8_stream_sums(t: Tables) -> DataFrame:
    rows = _ticks(t).select("piece", "user_id", F.col("k").cast("long").alias("k"), "value")
    out = drained(S.stream_sums(in_pieces(rows, "piece", PIECES, "user_id"), "user_id", "k", "value"), "update")
    return out.select("user_id", "k", F.round("state_sum", 5).alias("state_sum"), "state_count")


class Killed(RuntimeError):
    """Stands for the loss of the driver."""


@query("SELECT user_id, round(sum(value), 5) AS state_sum, count(*) AS state_count FROM events GROUP BY 1")
def k13_resumed_build(t: Tables) -> DataFrame:
    """A build that dies after its second batch has written its rows, is started anew, and passes the gate on unfinished keys."""
    rows = _ticks(t).select("piece", "user_id", F.col("k").cast("long").alias("k"), "value")
    stream = S.stream_sums(in_pieces(rows, "piece", PIECES, "user_id"), "user_id", "k", "value")
    path = folder(t.spark, "resumed")
    sink = R.KeyedSink(f"{path}/sink", ["user_id"], "k", 16)

    def dies(batch: DataFrame, epoch: int) -> None:
        sink(batch, epoch)
        if epoch == 1:
            raise Killed("after the rows of a batch, before the stream knows that they are written")

    try:
        run_to_end(stream, dies, f"{path}/state")
    except Exception as e:  # the stream wraps what its function raises
        if "Killed" not in str(e):
            raise
    run_to_end(stream, sink, f"{path}/state")
    records = sink.read(t.spark, stream.schema).withColumns({"schema": F.lit("sums"), "status": F.lit("ok")})
    done = R.finished(t.events.select("user_id"), records, ["user_id"], "sums")
    return done.select("user_id", F.round("state_sum", 5).alias("state_sum"), "state_count")


@query(
    "WITH x AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 10) AS good FROM events GROUP BY 1), r AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 5 = 0 THEN 'broken' WHEN good * 2 < n THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN user_id % 11 = 0 THEN 'old' ELSE 'new' END AS schema FROM x WHERE user_id % 3 <> 0) "
    "SELECT count(*) AS expected, count(*) FILTER (schema = 'new' AND status = 'ok') AS ok, count(*) FILTER (schema = 'new' AND status = 'skipped') AS skipped, count(*) FILTER (schema IS NULL) AS missing, count(*) FILTER (schema IS NOT NULL AND NOT (schema = 'new' AND coalesce(status, '') IN ('ok', 'skipped'))) AS malformed FROM x LEFT JOIN r USING (user_id)"
)
def k13_a19_progress(t: Tables) -> DataFrame:
    """The count of finished, missing and malformed records before a build may end; the records are written and read again."""
    known = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("good"))
    user = F.col("user_id")
    status = F.when(user % 7 == 0, None).when(user % 5 == 0, "broken").when(F.col("good") * 2 < F.col("n"), "skipped").otherwise("ok")
    records = known.where(user % 3 != 0).select("user_id", status.alias("status"), F.when(user % 11 == 0, "old").otherwise("new").alias("schema"))
    path = folder(t.spark, "records")
    records.write.partitionBy("schema").json(path)
    found = t.spark.read.schema("user_id long, status string, schema string").json(path)
    return R.progress(known.select("user_id"), found, ["user_id"], "new")


@query(f"SELECT user_id, k, CASE WHEN k + 1 = n THEN 'final' ELSE 'tick' END AS kind, round(sum(value) OVER (PARTITION BY user_id ORDER BY k), 5) AS state_sum, k + 1 AS state_count FROM {_K}")
def k14_online_loop(t: Tables) -> DataFrame:
    rows = _ticks(t).select("piece", "user_id", F.col("k").cast("long").alias("k"), "value", (F.col("k") + 1 == F.col("schedule_count")).alias("final"))
    out = drained(S.online(in_pieces(rows, "piece", PIECES, "user_id"), "user_id", "k", "value", "final", idle_ms=3_600_000), "update", timers=True)
    return out.select("user_id", "k", "kind", F.round("state_sum", 5).alias("state_sum"), "state_count")
