"""Joins, set operations and merges on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import sets

from .registry import Tables, query

BINS = (0.25, 0.5, 0.75, 1.0)
#: Events as intervals: the rank within the user, in ticks; each lasts by its value.
_IV = "WITH iv AS (SELECT event_id, user_id, event_type, value, k * 1.0::DOUBLE AS s, k + 0.2 + value % 3 AS e, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events))"


def _intervals(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t.events.withColumn("k", k)
    return rows.select("event_id", "user_id", "event_type", "value", F.col("k").cast("double").alias("s"), (F.col("k") + 0.2 + F.col("value") % 3).alias("e"), "k")


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    iv = _intervals(t)
    left = iv.where("event_type = 'click'").select("event_id", "user_id", F.col("s").alias("ls"), F.col("e").alias("le"), "k")
    right = iv.where("event_type <> 'click'").select(F.col("event_id").alias("rid"), "user_id", F.col("s").alias("rs"), F.col("e").alias("re"), "value", F.col("k").alias("rk"))
    return left, right


@query("SELECT l_returnflag, p_brand, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY 1, 2")
def e1_inner_key(t: Tables) -> DataFrame:
    part = t.part.where("p_size > 25").select("p_partkey", "p_brand")
    return t.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_returnflag", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(first, 'none') AS first FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS first FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def e2_left_defaults(t: Tables) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("first"))
    j = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("first", F.lit("none")).alias("first"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def e3_q2_anti(t: Tables) -> DataFrame:
    done = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return sets.remaining(t.customer, done, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def e4_semi(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.where("quality = 1"), "doc_id", "left_semi")


@query("SELECT l_orderkey, l_linenumber, arg_max(l_quantity, (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS q FROM lineitem GROUP BY 1, 2")
def e5_composite_keep_last(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("o", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), "o")
    return J.keep_last(rows, ["l_orderkey", "l_linenumber"], "o").select("l_orderkey", "l_linenumber", "q")


@query(
    "WITH r AS (SELECT user_id, event_type, min(value) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), u AS (SELECT user_id, min(v) AS v FROM r GROUP BY 1), e AS (SELECT event_type, min(v) AS v FROM r GROUP BY 1) SELECT event_id, round(coalesce(r.v, u.v, e.v), 6) AS v, CASE WHEN r.v IS NOT NULL THEN 0 WHEN u.v IS NOT NULL THEN 1 WHEN e.v IS NOT NULL THEN 2 END AS hit FROM events x LEFT JOIN r USING (user_id, event_type) LEFT JOIN u USING (user_id) LEFT JOIN e USING (event_type)"
)
def e6_e7_fallback(t: Tables) -> DataFrame:
    right = t.events.where("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.min("value").alias("v"))
    out = J.fallback_join(t.events.select("event_id", "user_id", "event_type"), right, [("user_id", "event_type"), ("user_id",), ("event_type",)], "v")
    return out.select("event_id", F.round("v", 6).alias("v"), "hit")


@query("SELECT a.conv_id, a.place, a.text AS q, b.text AS a FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations WHERE role = 'user') a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.place = b.place")
def e8_positional(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "role", "text")
    a, b = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("t2"), F.col("text").alias("a"))
    return J.positional_join(a, b, "conv_id", ["turn", "q"], ["t2", "a"]).select("conv_id", "place", "q", "a")


@query("WITH f AS (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1), v AS (SELECT event_type, row_number() OVER (ORDER BY first, event_type) - 1 AS id FROM f) SELECT event_id, id FROM events JOIN v USING (event_type)")
def e9_f36_vocabulary(t: Tables) -> DataFrame:
    from tidemark.operators.sequence import vocabulary

    v = vocabulary(t.events, "event_type", "event_id")
    return t.events.select("event_id", "event_type").join(v, "event_type").select("event_id", F.col("id").cast("long").alias("id"))


@query(
    _IV
    + ", a AS (SELECT * FROM iv WHERE event_type = 'click'), b AS (SELECT * FROM iv WHERE event_type <> 'click'), m AS (SELECT a.event_id, b.value, least(a.e, b.e) - greatest(a.s, b.s) AS w FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 0.3) SELECT a.event_id, round(coalesce(sum(w * m.value) / sum(w), 5), 6) AS value, count(w) AS n_overlap FROM a LEFT JOIN m USING (event_id) GROUP BY 1"
)
def e10_e11_e12_overlap_weighted(t: Tables) -> DataFrame:
    left, right = _sides(t)
    out = J.overlap_weighted(left, right, "user_id", 4.0, 0.3, ["value"], [5.0], "event_id")
    return out.select("event_id", F.round("value", 6).alias("value"), "n_overlap")


@query(_IV + " SELECT a.event_id, count(*) AS n, min(b.event_id) AS first, max(b.event_id) AS last FROM iv a JOIN iv b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'click' AND b.event_type <> 'click' GROUP BY 1")
def e13_sweep(t: Tables) -> DataFrame:
    left, right = _sides(t)
    return J.interval_pairs(left, right, "user_id", 4.0).groupBy("event_id").agg(F.count("*").alias("n"), F.min("rid").alias("first"), F.max("rid").alias("last"))


@query(
    _IV
    + ", a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS place FROM iv WHERE event_type = 'click'), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS place FROM iv WHERE event_type <> 'click'), m AS (SELECT a.event_id, b.event_id AS rid, b.value, (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) AS iou FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e), best AS (SELECT event_id, value FROM m WHERE iou >= 0.2 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY iou DESC, rid) = 1) SELECT a.event_id, round(coalesce(best.value, b.value), 6) AS value, CASE WHEN best.event_id IS NOT NULL THEN 'iou' WHEN b.event_id IS NOT NULL THEN 'ordinal' END AS by FROM a LEFT JOIN best USING (event_id) LEFT JOIN b ON a.user_id = b.user_id AND a.place = b.place"
)
def e14_e15_e16_best_iou(t: Tables) -> DataFrame:
    left, right = _sides(t)
    place = lambda k: F.row_number().over(Window.partitionBy("user_id").orderBy(k))
    out = J.best_iou(left.withColumn("place", place("k")), right.withColumn("place", place("rk")), "user_id", 4.0, 0.2, "event_id", "rid", "value", "place")
    return out.select("event_id", F.round("value", 6).alias("value"), "by")


_PROGRESS = "SELECT user_id, event_id, value, k, n, k * 1.0::DOUBLE / n AS progress FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _progress(t: Tables) -> DataFrame:
    from tidemark.operators.sequence import schedule

    return schedule(t.events.select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"])


@query(f"SELECT user_id, bin, round(arg_max(value, progress), 6) AS value, round(max(progress), 6) AS progress FROM ({_PROGRESS}) JOIN (SELECT unnest([0.25, 0.5, 0.75, 1.0])::DOUBLE AS bin) ON progress <= bin + 1e-9 GROUP BY 1, 2")
def e17_as_of(t: Tables) -> DataFrame:
    out = J.as_of_bins(_progress(t), "user_id", "progress", "value", BINS)
    return out.select("user_id", "bin", F.round("value", 6).alias("value"), F.round("progress", 6).alias("progress"))


@query(f"SELECT user_id, node, round(value, 6) AS value FROM ({_PROGRESS}) JOIN (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS node) ON true QUALIFY row_number() OVER (PARTITION BY user_id, node ORDER BY abs(progress - node), progress, event_id) = 1")
def e18_nearest(t: Tables) -> DataFrame:
    return J.nearest_node(_progress(t), "user_id", "progress", "event_id", "value", (0.2, 0.5, 0.8)).select("user_id", "node", F.round("value", 6).alias("value"))


@query(_IV + ", c AS (SELECT DISTINCT user_id, cut FROM iv JOIN (SELECT unnest([2.0, 5.0, 9.5])::DOUBLE AS cut) ON true) SELECT user_id, cut, (SELECT count(*) FROM iv WHERE iv.user_id = c.user_id AND iv.e <= c.cut + 1e-6) AS n FROM c")
def e19_count_until(t: Tables) -> DataFrame:
    iv = _intervals(t)
    cuts = iv.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(2.0), F.lit(5.0), F.lit(9.5))).alias("cut"))
    return J.count_until(iv.select("user_id", "e"), cuts, "user_id", "e", "cut").select("user_id", "cut", F.col("n").cast("long").alias("n"))


@query("SELECT o_custkey, count(*) AS pairs, round(sum(greatest(10 - sign(ti - tj) * (pi - pj), 0)), 5) AS loss FROM (SELECT a.o_custkey, a.o_totalprice / 1000 AS pi, b.o_totalprice / 1000 AS pj, ascii(a.o_orderpriority) AS ti, ascii(b.o_orderpriority) AS tj FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey) WHERE ti <> tj GROUP BY 1")
def e20_ranking_pairs(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("p"), F.ascii("o_orderpriority").alias("t"))
    return J.ranking_pairs(rows, "o_custkey", "o_orderkey", "p", "t", 10.0).select("o_custkey", "pairs", F.round("loss", 5).alias("loss"))


@query("SELECT count(*) AS n, round(avg(x - y), 6) AS d FROM (SELECT user_id, avg(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1) JOIN (SELECT user_id, avg(value) AS y FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id)")
def e21_paired_keys(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.avg("value").alias("x"))
    b = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.avg("value").alias("y"))
    return a.join(b, "user_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("d"))


@query("WITH r AS (SELECT DISTINCT conv_id, turn, length(text) AS v FROM conversations), c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn FROM r)) SELECT r.conv_id, r.turn, r.v, o.v AS previous FROM r JOIN c USING (conv_id, turn) LEFT JOIN r o ON o.conv_id = r.conv_id AND o.turn = c.prev")
def e22_previous_chunk(t: Tables) -> DataFrame:
    r = t.conversations.select("conv_id", "turn", F.lit(0).alias("slot"), F.length("text").cast("long").alias("v")).distinct()
    return J.previous_slot(r, "conv_id", "turn", "slot", "slot", "v").select("conv_id", "turn", "v", "previous")


@query("SELECT conv_id, min(len(string_split(text, ' '))) AS shared, count(*) AS n FROM conversations GROUP BY 1")
def e26_positional_min_length(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.min(F.size(F.split("text", " "))).cast("long").alias("shared"), F.count("*").alias("n"))


# Set operations and merges.


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_type FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_type FROM events WHERE event_id % 4 = 3) GROUP BY 1")
def i1_i6_shards(t: Tables) -> DataFrame:
    from tidemark.sources.writers import union_all

    return union_all([sets.shard(t.events, "event_id", k, 4) for k in (0, 1, 3)]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def i2_keep_first(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", F.col("event_id").alias("o"))
    return J.keep_first(rows, ["user_id"], "o").drop("o")


@query("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both, count(*) FILTER (b IS NULL) AS only_first, count(*) FILTER (a IS NULL) AS only_second FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders WHERE o_orderkey % 5 = 0) ON a = b")
def i3_f53_cross_audit(t: Tables) -> DataFrame:
    return sets.cross_audit(t.customer, t.orders.where("o_orderkey % 5 = 0").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT ['a'] AS in_all, ['a', 'b'] AS in_any")
def i4_key_sets(t: Tables) -> DataFrame:
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).otherwise(F.create_map(F.lit("a"), F.lit(1)))
    return sets.key_sets(t.events.select(m.alias("m")), "m")


@query("SELECT user_id, coalesce(sum(n) OVER (ORDER BY md5('7:' || user_id), user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < ceil(sum(n) OVER () * 0.3) AS held_out FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def i5_hold_out(t: Tables) -> DataFrame:
    return sets.hold_out(t.events, "user_id", 0.3, 7)


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value <= 30, event_id) = 1")
def q1_merge_preferring(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    out = sets.merge_preferring(rows, ["user_id", "event_type"], F.col("value") > 30, ["event_id"])
    return out.withColumn("value", F.round("value", 6))


@query("SELECT c_mktsegment, count(*) AS rows, count(ok) AS hit, CAST(coalesce(sum(ok), 0) AS BIGINT) AS ok, coalesce(sum(ok), 0) * 1.0::DOUBLE / count(*) AS ok_share FROM customer LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS ok FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1")
def d16_q3_q4_coverage_gate(t: Tables) -> DataFrame:
    done = t.orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("good"))
    return sets.require(sets.coverage(t.customer, done, ["c_custkey"], "c_mktsegment", "good"), "ok_share", 0.0)


@query("SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN m END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN m END) AS O, max(CASE WHEN o_orderstatus = 'P' THEN m END) AS P FROM (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 3) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def q7_o11_pivot(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 3))


@query("SELECT user_id, list(event_id ORDER BY event_id)[1:10] AS ids, count(*) AS n FROM events GROUP BY 1")
def h6_o13_index(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"), F.count("*").alias("n"))
    return g.select("user_id", F.slice("ids", 1, 10).alias("ids"), "n")


@query("SELECT doc_id, contains(text, 'GNU') OR contains(text, 'CC BY') AS licensed FROM documents")
def o14_text_evidence(t: Tables) -> DataFrame:
    tokens = F.array(F.lit("GNU"), F.lit("CC BY"))
    return t.documents.select("doc_id", F.exists(tokens, lambda x: F.contains(F.col("text"), x)).alias("licensed"))


@query(_IV + " SELECT user_id, CASE WHEN bool_or(e - s > 3.15) THEN 0 ELSE count(*) END AS n FROM iv GROUP BY 1")
def o5_all_or_nothing(t: Tables) -> DataFrame:
    g = _intervals(t).groupBy("user_id").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    kept = F.when(F.exists("x", lambda v: v["e"] - v["s"] > 3.15), F.slice("x", 1, 0)).otherwise(F.col("x"))
    return g.select("user_id", F.size(kept).cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS idx FROM lineitem")
def o2_flatten_index(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.row_number().over(w) - 1).cast("long").alias("idx"))


@query("SELECT upper(trim(p_type)) AS label, min(p_partkey) AS id FROM part WHERE trim(p_type) <> '' GROUP BY 1")
def o3_label_map(t: Tables) -> DataFrame:
    return t.part.where(F.trim("p_type") != "").groupBy(F.upper(F.trim("p_type")).alias("label")).agg(F.min("p_partkey").alias("id"))


@query("SELECT user_id, event_id, is_last, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS r, event_type = 'purchase' AS is_last FROM events) WHERE r = 1")
def f45_final_row(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", (F.col("event_type") == "purchase").alias("is_last"), "value", F.struct(F.col("event_type") == "purchase", "ts", "event_id").alias("o"))
    return J.keep_last(rows, ["user_id"], "o").select("user_id", "event_id", "is_last", F.round("value", 6).alias("value"))


@query("SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(p_type), first) = 1")
def f37_vote(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return g.groupBy("p_brand").agg(F.min_by(F.struct("p_type", "n"), F.struct(-F.col("n"), F.length("p_type"), "first")).alias("x")).select("p_brand", "x.*")


@query("SELECT l_orderkey, round(least(sum(l_quantity), 100), 4) AS m, round(greatest(max(l_quantity) - 50, -10), 4) AS d FROM lineitem GROUP BY 1")
def o6_o7_teacher_rows(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.least(F.sum("l_quantity"), F.lit(100)), 4).alias("m"), F.round(F.greatest(F.max("l_quantity") - 50, F.lit(-10)), 4).alias("d"))

