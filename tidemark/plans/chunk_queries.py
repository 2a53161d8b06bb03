"""Chunk rows, alignments with interval and confidence terms, and targets of slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import aligned as A
from tidemark.functions.scalars import TIME_EPS, rounded
from tidemark.streaming import chunk_rows as K
from tidemark.streaming import commits as C

from .registry import Tables, query
from .sequence_queries import _K, _WIN, _durations, _ev

_SLOTS = f"(SELECT e.user_id, c.chunk_id, e.k AS slot, e.k // 2 AS word, CASE WHEN (e.k + 1) * 0.3::DOUBLE > c.audio_end - 0.3 AND NOT c.is_final THEN 'part' ELSE e.event_type END AS token, max((e.k + 1) * 0.3::DOUBLE) OVER (PARTITION BY e.user_id, c.chunk_id, e.k // 2) <= c.commit_time + 1e-6 OR c.is_final AS candidate, e.event_type AS truth FROM {_K} e JOIN {_WIN} c ON e.user_id = c.user_id AND (e.k + 1) * 0.3::DOUBLE <= c.audio_end + 1e-6)"


@query(
    f"WITH s AS (SELECT *, coalesce(lag(chunk_id) OVER w = chunk_id - 1 AND lag(token) OVER w = token, false) AS same FROM {_SLOTS} WINDOW w AS (PARTITION BY user_id, slot ORDER BY chunk_id)), i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, slot ORDER BY chunk_id) AS isl FROM s), "
    "c AS (SELECT *, bool_or(candidate) OVER (PARTITION BY user_id, slot, isl ORDER BY chunk_id) AS cumulative FROM i), p AS (SELECT c.*, coalesce(b.cumulative AND b.token = c.token, false) AS mapped, a.chunk_id IS NULL OR a.token <> c.token AS leaves FROM c LEFT JOIN c b ON b.user_id = c.user_id AND b.slot = c.slot AND b.chunk_id = c.chunk_id - 1 LEFT JOIN c a ON a.user_id = c.user_id AND a.slot = c.slot AND a.chunk_id = c.chunk_id + 1), "
    "n AS (SELECT *, bool_and(candidate) OVER w AND NOT bool_or(mapped) OVER w AS new FROM p WINDOW w AS (PARTITION BY user_id, chunk_id, word)), g AS (SELECT user_id, chunk_id, count(*) AS n, string_agg(token, ' ' ORDER BY slot) AS tokens, string_agg(CASE WHEN cumulative THEN '1' ELSE '0' END, '' ORDER BY slot) AS cumulative, string_agg(CASE WHEN new THEN '1' ELSE '0' END, '' ORDER BY slot) AS new, string_agg(CASE WHEN mapped THEN '1' ELSE '0' END, '' ORDER BY slot) AS mapped, string_agg(CASE WHEN cumulative AND token = truth THEN '1' ELSE '0' END, '' ORDER BY slot) AS target, count(DISTINCT word) FILTER (new) AS new_words, count(DISTINCT word) FILTER (cumulative) AS committed_words, count(*) FILTER (cumulative AND leaves) AS l FROM n GROUP BY 1, 2) "
    f"SELECT user_id, chunk_id, round(audio_end, 6) AS audio_end, is_final, coalesce(n, 0) AS n_slots, coalesce(tokens, '') AS tokens, coalesce(cumulative, '') AS cumulative, coalesce(new, '') AS new, coalesce(mapped, '') AS mapped, coalesce(target, '') AS target, coalesce(new_words, 0) AS new_words, coalesce(committed_words, 0) AS committed_words, coalesce(lag(l) OVER (PARTITION BY user_id ORDER BY chunk_id), 0) AS dropped FROM {_WIN} LEFT JOIN g USING (user_id, chunk_id)"
)
def k11_chunk_rows(t: Tables) -> DataFrame:
    """The last visible slot of a chunk is unsure and gets its token later, so each chunk revises one of the chunk before."""
    chunks = C.windows(_durations(t), "user_id", "t", 0.64, 0.16)
    slots = _ev(t).select("user_id", F.col("k").alias("slot"), F.floor(F.col("k") / 2).alias("word"), ((F.col("k") + 1) * F.lit(0.3)).alias("end"), "event_type")
    slots = slots.withColumn("ends", F.collect_list("end").over(Window.partitionBy("user_id", "word")))  # two of a word: its last visible end needs no window over the pairs
    seen = K.visible_slots(chunks, slots, "user_id", "end", every=True)
    token = F.when((F.col("end") > F.col("audio_end") - 0.3) & ~F.col("is_final"), "part").otherwise(F.col("event_type"))
    last = F.array_max(F.filter("ends", lambda e: e <= F.col("audio_end") + TIME_EPS))
    seen = seen.withColumn("token", token).withColumn("candidate", (last <= F.col("commit_time") + 1e-6) | F.col("is_final"))
    rows = K.committed_slots(seen, "user_id", "chunk_id", "slot", "token", "word", "candidate")
    out = K.chunk_rows(chunks, rows, "user_id", "chunk_id", "slot", "token", "word", {"target": F.col("cumulative") & (F.col("token") == F.col("event_type"))})
    mask = lambda c: F.array_join(F.transform(F.col("slots")[c], lambda x: F.when(x, "1").otherwise("0")), "").alias(c)
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("user_id", long("chunk_id"), F.round("audio_end", 6).alias("audio_end"), "is_final", F.size("slots").cast("long").alias("n_slots"), F.array_join(F.col("slots")["token"], " ").alias("tokens"), mask("cumulative"), mask("new"), mask("mapped"), mask("target"), long("new_words"), long("committed_words"), long("dropped"))


_SIDE = "list({t} ORDER BY {o}) AS {p}, list(l_linenumber::DOUBLE ORDER BY {o}) AS {p}0, list(l_linenumber + l_quantity::DOUBLE / 20 ORDER BY {o}) AS {p}1"
_TOKEN = "l_returnflag || l_linestatus || (l_partkey % 3)"
_PAIR = "greatest((CASE WHEN a[i] = b[d + 1 - i] THEN 0 ELSE 1 END) - (greatest(least(a1[i], b1[d + 1 - i]) - greatest(a0[i], b0[d + 1 - i]), 0) / (greatest(a1[i], b1[d + 1 - i]) - least(a0[i], b0[d + 1 - i])) * 0.3 + least(greatest(conf[d + 1 - i], 0), 1) * 0.1), 0)"
_FARS = "coalesce({x}, 1e18::DOUBLE)"


@query(
    f"WITH RECURSIVE s AS (SELECT l_orderkey AS k, {_SIDE.format(t=_TOKEN, o='l_linenumber, l_partkey, l_quantity', p='a')}, {_SIDE.format(t=_TOKEN, o='l_partkey, l_linenumber, l_quantity', p='b')}, list(l_discount::DOUBLE * 10 ORDER BY l_partkey, l_linenumber, l_quantity) AS conf, count(*) AS n FROM lineitem GROUP BY 1), "
    "dp AS (SELECT *, 0 AS d, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0::DOUBLE ELSE 1e18::DOUBLE END) AS one, list_transform(range(0, n + 1), lambda i: 1e18::DOUBLE) AS two, CAST([] AS INTEGER[][]) AS moves FROM s UNION ALL "
    "SELECT k, a, a0, a1, b, b0, b1, conf, n, d + 1, list_transform(c, lambda x: x[1]), one, list_append(moves, list_transform(c, lambda x: CAST(x[2] AS INTEGER))) FROM ("
    "SELECT *, list_transform(range(0, n + 1), lambda i: CASE WHEN d + 1 - i < 0 OR d + 1 - i > n THEN [1e18::DOUBLE, 0] WHEN i = 0 THEN [one[1] + 1, 2] WHEN d + 1 - i = 0 THEN [one[i] + 1, 1] "
    f"ELSE [least(two[i] + {_PAIR}, one[i] + 1, one[i + 1] + 1), CASE WHEN two[i] + {_PAIR} <= one[i] + 1 AND two[i] + {_PAIR} <= one[i + 1] + 1 THEN 0 WHEN one[i] <= one[i + 1] THEN 1 ELSE 2 END] END) AS c FROM dp WHERE d < 2 * n)), "
    "tb AS (SELECT k, n AS i, n AS j, moves, one[n + 1] AS cost, '' AS pairs FROM dp WHERE d = 2 * n UNION ALL SELECT k, CASE WHEN mv <> 2 THEN i - 1 ELSE i END, CASE WHEN mv <> 1 THEN j - 1 ELSE j END, moves, cost, (CASE WHEN mv <> 2 THEN CAST(i - 1 AS VARCHAR) ELSE '' END) || '-' || (CASE WHEN mv <> 1 THEN CAST(j - 1 AS VARCHAR) ELSE '' END) || ' ' || pairs FROM (SELECT *, moves[i + j][i + 1] AS mv FROM tb WHERE i + j > 0)) "
    "SELECT k AS l_orderkey, round(cost, 6) AS cost, pairs FROM tb WHERE i + j = 0"
)
def e24_reward_alignment(t: Tables) -> DataFrame:
    """The lines of an order by number and by part, aligned with rewards for overlap and confidence."""
    token = F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 3).cast("string"))
    start, end = F.col("l_linenumber").cast("double"), F.col("l_linenumber") + F.col("l_quantity").cast("double") / 20
    item = lambda *order: F.sort_array(F.collect_list(F.struct(*order, token.alias("token"), F.struct(start.alias("start"), end.alias("end")).alias("time"), (F.col("l_discount").cast("double") * 10).alias("conf"))))
    sides = t.lineitem.groupBy("l_orderkey").agg(item("l_linenumber", "l_partkey", "l_quantity").alias("a"), item("l_partkey", "l_linenumber", "l_quantity").alias("b"))
    reward = A.overlap_and_confidence(F.col("a")["time"], F.col("b")["time"], F.col("b")["conf"])
    out = sides.select("l_orderkey", A.edit_alignment(F.col("a")["token"], F.col("b")["token"], reward=reward).alias("r"))
    shown = F.transform(F.col("r.pairs"), lambda p: F.concat(F.coalesce(p["a"].cast("string"), F.lit("")), F.lit("-"), F.coalesce(p["b"].cast("string"), F.lit("")), F.lit(" ")))
    return out.select("l_orderkey", rounded(F.col("r.cost"), 6).alias("cost"), F.array_join(shown, "").alias("pairs"))


@query()
def e28_slot_targets(t: Tables) -> DataFrame:
    """Truth: the lines of an order by number. Slots: the same by part, some with another phone, with posteriors from quantity and price."""
    phones = ["A", "N", "R"]
    truth = F.struct("l_linenumber", F.col("l_returnflag").alias("phone"), (F.col("l_discount").cast("double") * 10).alias("phone_score"), (F.col("l_linenumber") % 3).cast("int").alias("word_id"), F.col("l_quantity").cast("double").alias("accuracy"), (F.col("l_tax").cast("double") * 100).alias("stress"), (F.col("l_quantity").cast("double") / 5).alias("total"))
    weights = F.array(*[F.lit(1.0) + F.when(F.col("l_returnflag") == p, F.col("l_quantity").cast("double")).otherwise(F.lit(0.0)) for p in phones])
    sums = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    posterior = F.transform(weights, lambda w: w / sums(weights))
    slot = F.struct("l_partkey", "l_linenumber", F.when(F.col("l_partkey") % 4 == 0, "N").when(F.col("l_partkey") % 9 != 0, F.col("l_returnflag")).alias("phone"), posterior.alias("posterior"), F.reverse(posterior).alias("support"), (F.col("l_tax").cast("double") * 10).alias("divergence"), (F.col("l_linenumber") <= 3).alias("committed"))
    seen = F.collect_set(F.when(F.col("l_partkey") % 5 != 0, (F.col("l_linenumber") % 3).cast("int")))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(truth)).alias("truth"), F.sort_array(F.collect_list(slot)).alias("slots"), seen.alias("seen"))
    out = rows.select("l_orderkey", F.posexplode(A.slot_targets(F.col("truth"), F.col("slots"), phones, F.col("seen"))).alias("slot", "target"))
    return out.select("l_orderkey", "slot", "target.*")
