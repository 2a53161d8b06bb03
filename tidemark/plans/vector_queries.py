"""Array and numeric vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import vectors as V
from tidemark.operators import sequence as Q

from .registry import Tables, query

_SOFT = "WITH s AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, label, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings))"


def _soft(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", V.doubles(F.col("embedding")).alias("e")).select("vec_id", "label", V.plain_softmax(F.col("e")).alias("p"))


@query(_SOFT + " SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-8)))), 6) AS entropy, round(list_sort(p, 'DESC')[1], 8) AS top, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 8) AS margin, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS best, 1.0::DOUBLE AS ones FROM s")
def j1_j3_h1_h2_h3_posterior(t: Tables) -> DataFrame:
    top, margin = V.top_and_margin(F.col("p"))
    return _soft(t).select("vec_id", F.round(V.entropy(F.col("p")), 6).alias("entropy"), F.round(top, 8).alias("top"), F.round(margin, 8).alias("margin"), V.argmax(F.col("p")).cast("long").alias("best"), V.total(V.one_hot(F.col("p"))).alias("ones"))


@query(
    _SOFT
    + """, m AS (SELECT label, i, avg(p[i]) AS q FROM s, range(1, 65) r(i) GROUP BY label, i), c AS (SELECT label, list(q ORDER BY i) AS q FROM m GROUP BY label),
 j AS (SELECT s.vec_id, p, q, list_transform(range(1, 65), lambda k: (p[k] + q[k]) / 2) AS mid FROM s JOIN c USING (label))
 SELECT vec_id, round(0.5 * list_sum(list_transform(range(1, 65), lambda k: p[k] * ln(p[k] / mid[k]))) + 0.5 * list_sum(list_transform(range(1, 65), lambda k: q[k] * ln(q[k] / mid[k]))), 6) AS js FROM j"""
)
def j4_j5_j6_divergence(t: Tables) -> DataFrame:
    s = _soft(t)
    mean = s.groupBy("label").agg(V.mean_by_place(F.col("p"), 64).alias("q"))
    return s.join(mean, "label").select("vec_id", F.round(V.js_divergence(F.col("p"), F.col("q")), 6).alias("js"))


@query("SELECT event_id, round(CASE WHEN greatest(a + 2, 51) - least(a, 50) > 0 THEN greatest(least(a + 2, 51) - greatest(a, 50), 0) / (greatest(a + 2, 51) - least(a, 50)) ELSE 0 END, 6) AS iou FROM (SELECT event_id, value AS a FROM events)")
def j7_iou(t: Tables) -> DataFrame:
    a = F.col("value")
    return t.events.select("event_id", F.round(S.iou(a, a + 2, F.lit(50.0), F.lit(51.0)), 6).alias("iou"))


@query("SELECT l_orderkey, round(sum(l_quantity * m) / greatest(sum(m), 1), 6) AS mean FROM (SELECT l_orderkey, l_quantity, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS m FROM lineitem) GROUP BY 1")
def j14_masked_mean(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", (F.col("l_returnflag") == "N").cast("double").alias("m"))).alias("x"))
    return per.select("l_orderkey", F.round(V.masked_mean(F.col("x.l_quantity"), F.col("x.m")), 6).alias("mean"))


@query("SELECT l_returnflag, round(sum(g * l_quantity + (1 - g) * l_extendedprice), 2) AS mixed FROM (SELECT *, 1 / (1 + exp(-(l_discount * 10 - 0.5))) AS g FROM lineitem) GROUP BY 1")
def j15_gate(t: Tables) -> DataFrame:
    g = 1 / (1 + F.exp(-(F.col("l_discount") * 10 - 0.5)))
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(g * F.col("l_quantity") + (1 - g) * F.col("l_extendedprice")), 2).alias("mixed"))


@query("SELECT l_linestatus, round(sum(CASE WHEN o > 0 THEN o ELSE greatest(0.2 * l_discount, 0.2 * l_tax) END), 5) AS relaxed, round(sum(o), 5) AS original FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS o FROM lineitem) GROUP BY 1")
def j16_supervision(t: Tables) -> DataFrame:
    o = F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)
    w = lambda relaxed: F.round(F.sum(S.supervision_weight(o, F.col("l_discount"), F.col("l_tax"), relaxed)), 5)
    return t.lineitem.groupBy("l_linestatus").agg(w(True).alias("relaxed"), w(False).alias("original"))


@query("WITH x AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, n, (SELECT max(n) FROM x) AS width, round(q - ((SELECT max(n) FROM x) - n), 4) AS padded FROM x")
def j17_dense_padding(t: Tables) -> DataFrame:
    """Each order's quantities padded to the longest order's length with -1."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.collect_list(F.col("l_quantity").cast("double")).alias("q"))
    width = per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("width")).first().width
    return per.select("l_orderkey", "n", F.lit(width).cast("long").alias("width"), F.round(V.total(S.fit_length(F.col("q"), width, F.lit(-1.0))), 4).alias("padded"))


@query("SELECT user_id, round(coalesce(regr_slope(value, k), 0), 6) AS slope, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS std FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) GROUP BY 1")
def j12_g20_contour(t: Tables) -> DataFrame:
    rows = Q.schedule(t.events, "user_id", ["ts", "event_id"]).withColumn("k", F.col("schedule_index").cast("double"))
    return rows.groupBy("user_id").agg(F.round(Q.slope("value", "k"), 6).alias("slope"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("SELECT label, k, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT label, k, embedding[k + 1]::DOUBLE AS x FROM embeddings, range(0, 64) r(k)) GROUP BY 1, 2")
def f34_f35_column_stats(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("k", "x"))
    return rows.groupBy("label", F.col("k").cast("long").alias("k")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))
