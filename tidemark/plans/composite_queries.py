"""Composite operators on the driver tables: events stand for frames, slots, words and teacher rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import composites as C
from tidemark.operators import metrics as M
from tidemark.operators import sets
from tidemark.sources import readers as R
from tidemark.sources import writers as W
from tidemark.sources.scratch import folder

from .join_queries import _IV, _intervals
from .metric_queries import _corr
from .registry import Tables, query

_PROSODY = "duration f0_mean f0_std f0_slope voiced energy_mean energy_std energy_slope silence_ratio pause_count longest_pause word_rate phone_rate articulation_rate".split()


@query(
    "WITH f AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value / 100 AS rms, CASE WHEN event_type <> 'view' THEN 50 + value END AS f0, event_id % 10 / 10.0::DOUBLE AS vp FROM events), l AS (SELECT utt, greatest(quantile_cont(rms, 0.2), 1e-8) AS lv FROM f GROUP BY 1), r AS (SELECT f.*, rms <= lv AS quiet, ln(greatest(rms, 1e-8)) AS en, CASE WHEN f0 IS NOT NULL THEN count(f0) OVER (PARTITION BY utt ORDER BY i) END AS v FROM f JOIN l USING (utt)), runs AS (SELECT utt, count(*) AS k FROM (SELECT utt, quiet, i - row_number() OVER (PARTITION BY utt, quiet ORDER BY i) AS g FROM r) WHERE quiet GROUP BY utt, g), p AS (SELECT utt, count(*) AS pc, max(k) * 0.01 AS lp FROM runs GROUP BY 1), a AS (SELECT utt, avg(f0) AS fm, stddev_pop(f0) AS fs, coalesce(regr_slope(f0, v), 0) AS fl, avg(vp) AS vo, avg(en) AS em, stddev_pop(en) AS es, coalesce(regr_slope(en, i), 0) AS el, avg(quiet::INTEGER) AS sr, count(f0) / count(*) AS vd FROM r GROUP BY 1), u AS (SELECT c_custkey AS utt, greatest(c_acctbal / 1000, 1e-8) AS d, c_nationkey AS w, c_nationkey * 3 AS ph FROM customer)"
    " SELECT utt, round(CASE WHEN vd IS NULL THEN 0 ELSE d END, 6) AS duration, round(coalesce(fm, 0), 6) AS f0_mean, round(coalesce(fs, 0), 6) AS f0_std, round(coalesce(fl, 0), 6) AS f0_slope, round(coalesce(vo, 0), 6) AS voiced, round(coalesce(em, 0), 6) AS energy_mean, round(coalesce(es, 0), 6) AS energy_std, round(coalesce(el, 0), 6) AS energy_slope, round(coalesce(sr, 0), 6) AS silence_ratio, coalesce(pc, 0)::DOUBLE AS pause_count, round(coalesce(lp, 0)::DOUBLE, 6) AS longest_pause, round(CASE WHEN vd IS NULL THEN 0 ELSE w / d END, 6) AS word_rate, round(CASE WHEN vd IS NULL THEN 0 ELSE ph / d END, 6) AS phone_rate, round(CASE WHEN vd IS NULL THEN 0 ELSE ph / greatest(vd * d, 1e-8) END, 4) AS articulation_rate FROM u LEFT JOIN a USING (utt) LEFT JOIN p USING (utt)"
)
def j12_prosody_vector(t: Tables) -> DataFrame:
    """An event is a frame, a customer an utterance; a balance below 0 is a duration of nearly 0."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    frames = t.events.select(F.col("user_id").alias("utt"), i.alias("frame"), (F.col("value") / 100).alias("rms"), F.when(F.col("event_type") != "view", F.col("value") + 50).alias("f0"), (F.col("event_id") % 10 / 10).alias("voiced_prob"))
    utts = t.customer.select(F.col("c_custkey").alias("utt"), (F.col("c_acctbal") / 1000).alias("audio_end"), F.col("c_nationkey").alias("words"), (F.col("c_nationkey") * 3).alias("phones"))
    return C.prosody_vector(frames, utts, "utt").select("utt", *[F.round(c, 4 if c == "articulation_rate" else 6).alias(c) for c in _PROSODY])


@query(
    _IV
    + ", sl AS (SELECT user_id, k AS slot, s AS ls, e AS le, CASE WHEN k % 10 <> 9 THEN k // 6 END AS word, ['AA', 'B', 'E', 'K', 'OW'][1 + k % 5] AS phone, CASE WHEN k % 4 < 3 THEN k % 4 END AS stress FROM iv WHERE event_type = 'click'), p AS (SELECT a.user_id, slot, count(*) AS n, count(CASE WHEN event_type <> 'view' THEN 1 END) AS nv, avg(value) AS em, stddev_pop(value) AS es, max(value) AS ex, avg(CASE WHEN event_type <> 'view' THEN value * 2 END) AS fm, stddev_pop(CASE WHEN event_type <> 'view' THEN value * 2 END) AS fs, max(CASE WHEN event_type <> 'view' THEN value * 2 END) AS fx FROM sl a JOIN iv b ON a.user_id = b.user_id AND b.s >= a.ls AND b.s <= a.le GROUP BY 1, 2), j AS (SELECT sl.*, le - ls AS d, n, nv, coalesce(em, 0) AS em, coalesce(es, 0) AS es, coalesce(ex, 0) AS ex, coalesce(fm, 0) AS fm, coalesce(fs, 0) AS fs, coalesce(fx, 0) AS fx, coalesce('w' || word, 's' || slot) AS g FROM sl LEFT JOIN p USING (user_id, slot))"
    " SELECT user_id, slot::BIGINT AS slot, round(d, 6) AS duration, round(em, 6) AS energy_mean, round(es, 6) AS energy_std, round(ex, 6) AS energy_max, round(fm, 6) AS f0_mean, round(fs, 6) AS f0_std, round(fx, 6) AS f0_max, round(coalesce(nv / n, 0), 6) AS voiced_ratio, round((row_number() OVER (PARTITION BY user_id, g ORDER BY slot) - 1) / greatest(count(*) OVER o - 1, 1), 6) AS position, (count(*) OVER o)::DOUBLE AS word_phones, round(em - avg(em) OVER o, 6) AS energy_relative, round(d / greatest(avg(d) OVER o, 1e-8), 6) AS duration_relative, round(fm - avg(fm) OVER o, 6) AS f0_relative, (phone[1] IN ('A', 'E', 'I', 'O', 'U'))::INTEGER::DOUBLE AS is_vowel, coalesce(stress = 0, false)::INTEGER::DOUBLE AS stress_0, coalesce(stress = 1, false)::INTEGER::DOUBLE AS stress_1, coalesce(stress = 2, false)::INTEGER::DOUBLE AS stress_2 FROM j WINDOW o AS (PARTITION BY user_id, g)"
)
def j13_slot_prosody(t: Tables) -> DataFrame:
    """Clicks are slots; every event is a frame, unvoiced in views."""
    iv = _intervals(t)
    k, phones = F.col("k"), F.array(*[F.lit(p) for p in ("AA", "B", "E", "K", "OW")])
    slots = iv.where("event_type = 'click'").select(
        "user_id", k.cast("long").alias("slot"), F.col("s").alias("ls"), F.col("e").alias("le"), F.when(k % 10 != 9, F.floor(k / 6)).alias("word"), F.get(phones, k % 5).alias("phone"), F.when(k % 4 < 3, k % 4).alias("stress")
    )
    frames = iv.select("user_id", F.col("s").alias("time"), F.col("value").alias("energy"), F.when(F.col("event_type") != "view", F.col("value") * 2).alias("f0"))
    out = C.slot_prosody(frames, slots, "user_id", 4.0)
    return out.select("user_id", "slot", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), m AS (SELECT user_id AS utt, k // 2 AS chunk, event_id AS idx, event_type = 'purchase' AS is_final FROM e), t AS (SELECT user_id AS utt, k // 2 AS chunk, arg_max(value, event_id) AS a, arg_max(CASE WHEN event_id % 4 <> 0 THEN value * 2 ELSE 0 END, event_id) AS f FROM e WHERE event_id % 3 <> 0 AND event_type <> 'error' GROUP BY 1, 2), j AS (SELECT m.*, a, f, t.utt IS NOT NULL AS hit FROM m LEFT JOIN t USING (utt, chunk)), fr AS (SELECT utt, coalesce(max(idx) FILTER (is_final), -1) AS fr FROM j WHERE hit GROUP BY 1), en AS (SELECT utt, a AS ea, f AS ef FROM j JOIN fr USING (utt) WHERE hit AND idx >= fr QUALIFY row_number() OVER (PARTITION BY utt ORDER BY chunk DESC, idx) = 1)"
    " SELECT utt, chunk::BIGINT AS chunk, idx, hit::INTEGER AS mask, round(coalesce(a, 0), 6) AS prefix_accuracy, round(coalesce(f, 0), 6) AS prefix_fluency, round(CASE WHEN hit THEN ea ELSE 0 END, 6) AS final_accuracy, round(CASE WHEN hit THEN ef ELSE 0 END, 6) AS final_fluency FROM j LEFT JOIN en USING (utt)"
)
def o8_teacher_targets(t: Tables) -> DataFrame:
    """Events as chunk rows, purchases as final ones; the teacher lacks every third event and fails on errors."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t.events.select(F.col("user_id").alias("utt"), F.floor(k / 2).alias("chunk"), "event_id", "event_type", "value")
    manifest = rows.select("utt", "chunk", F.col("event_id").alias("idx"), (F.col("event_type") == "purchase").alias("is_final"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "ok")
    teacher = rows.where("event_id % 3 <> 0").select("utt", "chunk", status.alias("status"), F.col("event_id").alias("at"), F.col("value").alias("accuracy"), F.when(F.col("event_id") % 4 != 0, F.col("value") * 2).alias("fluency"))
    out = C.teacher_targets(manifest, teacher, ["accuracy", "fluency"])
    return out.select("utt", "chunk", "idx", "mask", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query(
    _IV
    + ", p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS place, s, e, value % 10 AS a, value % 3 AS b FROM iv WHERE event_type = 'click'), g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY k) AS place, s, e, value % 7 AS a, value % 5 AS b FROM iv WHERE event_type = 'view'), kind AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'invalid' WHEN coalesce(np, 0) = coalesce(ng, 0) THEN 'equal' WHEN user_id % 7 <> 3 THEN 'interval' ELSE 'skip' END AS branch FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, count(*) AS np FROM p GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS ng FROM g GROUP BY 1) USING (user_id)), m AS (SELECT p.user_id, p.place, avg(g.a) AS ga, avg(g.b) AS gb FROM p JOIN g ON p.user_id = g.user_id AND p.s < g.e AND g.s < p.e GROUP BY 1, 2), x AS (SELECT user_id, branch, 1.0::DOUBLE AS pa, 2.0::DOUBLE AS pb, g.a AS ga, g.b AS gb FROM kind JOIN g USING (user_id) WHERE branch = 'invalid' UNION ALL SELECT kind.user_id, branch, p.a, p.b, g.a, g.b FROM kind JOIN g ON kind.user_id = g.user_id JOIN p ON p.user_id = g.user_id AND p.place = g.place WHERE branch = 'equal' UNION ALL SELECT kind.user_id, branch, p.a, p.b, coalesce(ga, 0), coalesce(gb, 5) FROM kind JOIN p ON kind.user_id = p.user_id LEFT JOIN m ON m.user_id = p.user_id AND m.place = p.place WHERE branch = 'interval' UNION ALL SELECT user_id, branch, NULL, NULL, NULL, NULL FROM kind WHERE branch = 'skip')"
    f" SELECT branch, count(DISTINCT user_id) AS utts, count(pa) AS words, round(sum(pa), 4) AS pred, round(sum(ga), 4) AS gold, round({_corr('pa', 'ga')}, 6) AS pcc_accuracy, round({_corr('pb', 'gb')}, 6) AS pcc_stress FROM x GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT user_id), count(pa), round(sum(pa), 4), round(sum(ga), 4), round({_corr('pa', 'ga')}, 6), round({_corr('pb', 'gb')}, 6) FROM x WHERE branch <> 'skip'"
)
def o9_open_response(t: Tables) -> DataFrame:
    """Clicks as predicted words, views as reference words; a user's words all have one text, so equal counts are equal texts."""
    iv = _intervals(t)
    place, text = F.row_number().over(Window.partitionBy("user_id").orderBy("k")), F.concat(F.lit("w"), F.col("user_id") % 2)
    words = lambda kind, m, n: iv.where(F.col("event_type") == kind).select("user_id", place.alias("place"), text.alias("text"), "s", "e", (F.col("value") % m).alias("accuracy"), (F.col("value") % n).alias("stress"))
    utts = t.events.select("user_id").distinct().select("user_id", (F.col("user_id") % 5 == 0).alias("invalid"), (F.col("user_id") % 7 != 3).alias("aligned"), F.lit(1.0).alias("accuracy"), F.lit(2.0).alias("stress"))
    pairs = C.open_response(words("click", 10, 3), words("view", 7, 5), utts, "user_id", ["accuracy", "stress"], 4.0, C.UNMATCHED[:2])
    sums = [
        F.countDistinct("user_id").alias("utts"), F.count("pred_accuracy").alias("words"), F.round(F.sum("pred_accuracy"), 4).alias("pred"), F.round(F.sum("gold_accuracy"), 4).alias("gold"),
        F.round(M.safe_corr("pred_accuracy", "gold_accuracy"), 6).alias("pcc_accuracy"), F.round(M.safe_corr("pred_stress", "gold_stress"), 6).alias("pcc_stress"),
    ]
    return W.union_all([pairs.groupBy("branch").agg(*sums), pairs.where("branch <> 'skip'").agg(*sums).withColumn("branch", F.lit("all"))])


@query(
    "WITH w AS (SELECT l_orderkey, list({'t': l_returnflag || l_linenumber, 'e': l_linenumber * 0.5, 's': CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ws FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS t, o_orderkey % 4 AS cut, coalesce(ws, []) AS ws FROM orders LEFT JOIN w ON o_orderkey = l_orderkey)"
    " SELECT o_orderkey, CASE WHEN t <> '' THEN t ELSE array_to_string(list_transform(ws, lambda x: x.t), ' ') END AS target, array_to_string(list_transform(list_filter(ws, lambda x: x.e <= cut), lambda x: x.t), ' ') AS prefix, list_transform(list_filter(ws, lambda x: x.e <= cut), lambda x: coalesce(x.s, 0)::DOUBLE) AS scores FROM d"
)
def o4_o12_prefix_rows(t: Tables) -> DataFrame:
    """Orders as rows, their lines as words; every other order has no text of its own."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    word = F.struct(F.concat("l_returnflag", "l_linenumber").alias("text"), (F.col("l_linenumber") * 0.5).alias("end"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("double")).alias("score"))
    words = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, word.alias("w")))), lambda x: x["w"]).alias("ws"))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("t"), (F.col("o_orderkey") % 4).alias("cut")).join(words, "o_orderkey", "left")
    none = F.array().cast("array<struct<text:string,end:double,score:double>>")
    return C.prefix_rows(rows, F.col("t"), F.coalesce("ws", none), F.col("cut")).select("o_orderkey", "target", "prefix", "scores")


@query("SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def a13_header_records(t: Tables) -> DataFrame:
    path = folder(t.spark, "header")
    W.write_csv(t.nation.select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"), path)
    out = R.header_records(t.spark, path, "n_nationkey int, n_name string, n_regionkey int", "n_regionkey")
    return out.select("n_regionkey", F.size("records").cast("long").alias("n"), F.array_join(F.col("records.n_name"), ",").alias("names"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q6_status_counts(t: Tables) -> DataFrame:
    return sets.status_counts(t.lineitem, ["l_returnflag", "l_linestatus"], {"l_returnflag": ["A", "N", "R"]})


@query("SELECT label, count(*) AS n, count_if(embedding[1] > 0) AS voiced, count_if(embedding[2] > 0 AND label % 2 = 0) AS vowels FROM embeddings GROUP BY 1")
def q9_member_counts(t: Tables) -> DataFrame:
    e = R.require_columns(t.embeddings, ["vec_id", "label", "embedding"])  # from the schema alone
    at = lambda k: F.get("embedding", F.lit(k)) > 0
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(at(0)).alias("voiced"), F.count_if(at(1) & (F.col("label") % 2 == 0)).alias("vowels"))
