"""Metrics on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import text as X
from tidemark.operators import metrics as M

from .registry import Tables, query

_CORR = "CASE WHEN count(*) >= 2 AND stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _corr(x: str, y: str) -> str:
    return _CORR.format(x=x, y=y)


#: Prediction, target and confidence from lineitem.
_LI = "(SELECT *, l_extendedprice / 1000 AS pred, l_quantity * 2.0 AS target, l_discount * 10 AS conf, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS lab FROM lineitem)"


def _li(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "*", (F.col("l_extendedprice") / 1000).alias("pred"), (F.col("l_quantity") * 2.0).alias("target"), (F.col("l_discount") * 10).alias("conf"), (F.col("l_returnflag") == "N").cast("int").alias("lab")
    )


@query(f"SELECT l_returnflag, l_linestatus, round({_corr('pred', 'target')}, 6) AS pcc, round(avg((pred - target) * (pred - target)), 4) AS mse, round(avg(abs(pred - target)), 5) AS mae, count(*) AS n FROM {_LI} GROUP BY 1, 2")
def f1_f4_f6_errors(t: Tables) -> DataFrame:
    n, mse, mae = M.errors("pred", "target")
    g = M.pairs_only(_li(t), "pred", "target").groupBy("l_returnflag", "l_linestatus").agg(M.safe_corr("pred", "target").alias("pcc"), n, mse, mae)
    return g.select("l_returnflag", "l_linestatus", F.round("pcc", 6).alias("pcc"), F.round("mse", 4).alias("mse"), F.round("mae", 5).alias("mae"), "n")


@query(f"SELECT l_orderkey, round(coalesce({_corr('x', 'y')}, 0), 6) AS zero, round({_corr('x', 'y')}, 6) AS none FROM (SELECT l_orderkey, l_quantity AS x, l_discount AS y FROM lineitem) GROUP BY 1")
def f2_f3_degenerate_corr(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(M.safe_corr("l_quantity", "l_discount", 0.0).alias("zero"), M.safe_corr("l_quantity", "l_discount").alias("none"))
    return g.select("l_orderkey", F.round("zero", 6).alias("zero"), F.round("none", 6).alias("none"))


@query(
    "SELECT dim, count(*) AS n, round(avg((p - q) * (p - q)), 5) AS mse, round(" + _corr("p", "q") + ", 6) AS pcc FROM (SELECT 'quantity' AS dim, l_quantity AS p, l_extendedprice / 1000 AS q FROM lineitem UNION ALL SELECT 'tax', l_tax, l_discount FROM lineitem UNION ALL SELECT 'line', l_linenumber, l_quantity FROM lineitem) GROUP BY 1"
)
def f5_o10_o17_dimensions(t: Tables) -> DataFrame:
    rows = M.long_form(t.lineitem.withColumn("price", F.col("l_extendedprice") / 1000), [], {"quantity": ("l_quantity", "price"), "tax": ("l_tax", "l_discount"), "line": ("l_linenumber", "l_quantity")})
    n, mse, _ = M.errors("pred", "target")
    return rows.groupBy("dim").agg(n, F.round(mse, 5).alias("mse"), F.round(M.safe_corr("pred", "target"), 6).alias("pcc"))


@query(f"SELECT count(*) AS words, round({_corr('pred', 'target')}, 6) AS pcc, round(avg((pred - target) * (pred - target)), 4) AS mse FROM (SELECT l_orderkey, avg(pred) AS pred, round_even(avg(target), 2) AS target FROM {_LI} WHERE target >= 0 GROUP BY 1)")
def f7_f8_f9_word_metrics(t: Tables) -> DataFrame:
    words = _li(t).where(F.col("target") >= 0).groupBy("l_orderkey").agg(F.avg("pred").alias("pred"), F.bround(F.avg("target"), 2).alias("target"))
    _, mse, _ = M.errors("pred", "target")
    return words.agg(F.count("*").alias("words"), F.round(M.safe_corr("pred", "target"), 6).alias("pcc"), F.round(mse, 4).alias("mse"))


@query("SELECT l_returnflag, round(sum(d * d * m * w) / greatest(sum(m * w), 1), 6) AS mse, round(sum(d * d * m * w) / greatest(sum(m), 1), 6) AS by_rows FROM (SELECT *, l_discount - l_tax AS d, CASE WHEN l_quantity > 10 THEN 1.0 ELSE 0.0 END AS m, l_linenumber / 7.0 AS w FROM lineitem) GROUP BY 1")
def f14_f15_masked_mse(t: Tables) -> DataFrame:
    m, w = F.when(F.col("l_quantity") > 10, 1.0).otherwise(0.0), F.col("l_linenumber") / F.lit(7.0)
    p, q = F.col("l_discount"), F.col("l_tax")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(M.masked_mse(p, q, m, w), 6).alias("mse"), F.round(F.sum((p - q) * (p - q) * m * w) / F.greatest(F.sum(m), F.lit(1.0)), 6).alias("by_rows"))


@query(f"SELECT l_linestatus, round(1 - coalesce({_corr('x', 'y')}, 1), 6) AS loss, round(avg(CASE WHEN abs(x - y) < 0.05 THEN 0.5 * (x - y) * (x - y) / 0.05 ELSE abs(x - y) - 0.025 END), 6) AS huber, round(avg(greatest(x, 0) - x * b + ln(1 + exp(-abs(x)))), 6) AS bce FROM (SELECT l_linestatus, l_discount AS x, l_tax AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS b FROM lineitem WHERE l_quantity > 5) GROUP BY 1")
def f16_f17_losses(t: Tables) -> DataFrame:
    x, y = F.col("l_discount"), F.col("l_tax")
    b = (F.col("l_quantity") > 25).cast("int")
    g = t.lineitem.where("l_quantity > 5").groupBy("l_linestatus")
    return g.agg(F.round(1 - M.safe_corr(x, y, 1.0), 6).alias("loss"), F.round(F.avg(S.smooth_l1(x - y)), 6).alias("huber"), F.round(F.avg(S.bce_with_logits(x, b)), 6).alias("bce"))


@query("SELECT round(sum(w * v), 6) AS mixed, round(sum(v * n) / sum(n), 6) AS weighted FROM (SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.0 ELSE 2.0 END AS w, avg(l_discount) AS v, count(*) AS n FROM lineitem GROUP BY 1)")
def f18_f25_loss_mix(t: Tables) -> DataFrame:
    w = F.when(F.col("l_returnflag") == "A", 0.5).when(F.col("l_returnflag") == "N", 0.0).otherwise(2.0)
    g = t.lineitem.groupBy("l_returnflag").agg(F.avg("l_discount").alias("v"), F.count("*").alias("n")).withColumn("w", w)
    return g.agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("mixed"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


_BIN = "CASE " + " ".join(f"WHEN conf < {e} THEN {k}" for k, e in enumerate(M.TENTHS[1:-1])) + " ELSE 9 END"


@query(f"SELECT l_linestatus, round(sum(n * abs(c - t)) / sum(n), 6) AS ece FROM (SELECT l_linestatus, {_BIN} AS bin, count(*) AS n, avg(conf) AS c, avg(lab) AS t FROM {_LI} GROUP BY 1, 2) GROUP BY 1")
def f19_ece(t: Tables) -> DataFrame:
    return M.ece(_li(t), ["l_linestatus"], "conf", "lab").select("l_linestatus", F.round("ece", 6).alias("ece"))


@query(f"SELECT l_linestatus, round(avg((least(greatest(conf, 0), 1) - lab) * (least(greatest(conf, 0), 1) - lab)), 6) AS brier FROM {_LI} GROUP BY 1")
def f20_brier(t: Tables) -> DataFrame:
    d = S.clip(F.col("conf"), 0.0, 1.0) - F.col("lab")
    return _li(t).groupBy("l_linestatus").agg(F.round(F.avg(d * d), 6).alias("brier"))


@query(
    "WITH r AS (SELECT user_id, k, k * 1.0::DOUBLE / n AS x, s / k AS y FROM (SELECT user_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, sum(abs(value - 20)) OVER (PARTITION BY user_id ORDER BY value % 7 DESC, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value % 7 DESC, event_id))) SELECT user_id, round(sum(a), 6) AS aurc FROM (SELECT user_id, (x - lag(x) OVER (PARTITION BY user_id ORDER BY k)) * (y + lag(y) OVER (PARTITION BY user_id ORDER BY k)) / 2 AS a FROM r) GROUP BY 1"
)
def f21_g14_aurc(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", (F.col("value") % 7).alias("conf"), F.abs(F.col("value") - 20).alias("err"))
    points = M.risk_coverage(rows, "user_id", "conf", "err", ["event_id"])
    return M.aurc(points, "user_id").select("user_id", F.round("aurc", 6).alias("aurc"))


_LAB = "(SELECT d.lang, d.n_chars, l.quality, d.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL)"


def _lab(t: Tables) -> DataFrame:
    return t.labels.where("quality IS NOT NULL").join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")


@query(
    f"SELECT lang, round((sum(quality * r) - sum(quality) * (sum(quality) + 1) / 2) / nullif(sum(quality) * (count(*) - sum(quality)), 0), 6) AS auroc FROM (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM {_LAB}) GROUP BY 1"
)
def f22_auroc(t: Tables) -> DataFrame:
    return M.auroc(_lab(t), "lang", "n_chars", "quality").select("lang", F.round("auroc", 6).alias("auroc"))


@query(
    f"WITH r AS (SELECT lang, k, tp * 1.0::DOUBLE / k AS y, tp * 1.0::DOUBLE / nullif(total, 0) AS x FROM (SELECT lang, row_number() OVER w AS k, sum(quality) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS tp, sum(quality) OVER (PARTITION BY lang) AS total FROM {_LAB} WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id))) SELECT lang, round(sum(a), 6) AS auprc FROM (SELECT lang, (x - lag(x) OVER (PARTITION BY lang ORDER BY k)) * (y + lag(y) OVER (PARTITION BY lang ORDER BY k)) / 2 AS a FROM r) GROUP BY 1"
)
def f23_auprc(t: Tables) -> DataFrame:
    return M.auprc(_lab(t), "lang", "n_chars", "quality", ["doc_id"]).select("lang", F.round("auprc", 6).alias("auprc"))


@query()
def f24_wer(t: Tables) -> DataFrame:
    """Word error rate of each turn against the turn before, whole texts."""
    from tidemark.operators.align import distance_rows

    from .sequence_queries import replies

    words = lambda c: F.filter(F.split(X.normalize_for_wer(F.col(c)), " "), lambda w: w != "")
    pairs = replies(t).select("reply", words("before").alias("r"), words("text").alias("h"))
    each = distance_rows(pairs, "reply", "r", "h").select(F.col("distance").alias("d"), F.greatest("size", F.lit(1)).alias("n"))
    return each.agg(F.sum("d").alias("errors"), F.sum("n").alias("words"), F.round(F.sum("d") / F.sum("n"), 6).alias("wer"))


@query("SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, list(l_quantity ORDER BY l_quantity)[1 + CAST(floor(0.25 * (count(*) - 1)) AS INTEGER)] AS p25, round(avg(l_quantity), 6) AS mean, list(l_quantity ORDER BY l_quantity)[1 + CAST(floor(0.75 * (count(*) - 1)) AS INTEGER)] AS p75, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def f26_nearest_rank(t: Tables) -> DataFrame:
    return M.nearest_ranks(t.lineitem, "l_returnflag", "l_quantity", {"p25": 0.25, "p75": 0.75}).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.2), 6) AS p20, round(median(value), 6) AS p50 FROM events GROUP BY 1")
def f27_percentiles(t: Tables) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return t.events.groupBy("event_type").agg(q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.2).alias("p20"), q(0.5).alias("p50"))


@query(
    "WITH q AS (SELECT quantile_cont(l_discount, 1.0 / 3) AS a, quantile_cont(l_discount, 2.0 / 3) AS b FROM lineitem) SELECT CASE WHEN l_discount <= a THEN 'low' WHEN l_discount <= b THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, round("
    + _corr("l_extendedprice", "l_quantity")
    + ", 6) AS pcc FROM lineitem, q GROUP BY 1"
)
def f28_gate_terciles(t: Tables) -> DataFrame:
    a, b = t.lineitem.agg(F.percentile("l_discount", F.array(F.lit(1.0 / 3), F.lit(2.0 / 3))).alias("q")).first().q
    bucket = F.when(F.col("l_discount") <= a, "low").when(F.col("l_discount") <= b, "mid").otherwise("high")
    return t.lineitem.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.stddev_pop("l_discount"), 6).alias("std"), F.round(M.safe_corr("l_extendedprice", "l_quantity"), 6).alias("pcc")
    )


def _draws(t: Tables, reps: int = 20) -> DataFrame:
    units = t.nation.select(F.col("n_nationkey").alias("unit"))
    rep = units.select("unit", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    return rep.withColumn("times", F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "unit").cast("binary")), 1, 4), 16, 10).cast("int") % 3)


@query(
    "WITH d AS (SELECT rep, n_nationkey AS unit, CAST('0x' || substr(md5(rep || ':' || n_nationkey), 1, 4) AS INTEGER) % 3 AS times FROM nation, range(0, 20) r(rep)), x AS (SELECT c_nationkey AS unit, c_acctbal / 1000 AS p, o_totalprice / 100000 AS q FROM customer JOIN orders ON c_custkey = o_custkey), s AS (SELECT rep, sum(times) AS n, sum(p * times) AS x, sum(q * times) AS y, sum(p * p * times) AS xx, sum(q * q * times) AS yy, sum(p * q * times) AS xy FROM x JOIN d USING (unit) GROUP BY 1) SELECT rep, round((xy / n - x / n * y / n) / sqrt((xx / n - (x / n) * (x / n)) * (yy / n - (y / n) * (y / n))), 5) AS pcc FROM s"
)
def f29_f30_bootstrap(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("unit"), (F.col("c_acctbal") / 1000).alias("p"), (F.col("o_totalprice") / 100000).alias("q"))
    out = M.bootstrap(rows, "unit", _draws(t), "p", "q")
    return out.select(F.col("rep").cast("long").alias("rep"), F.round("pcc", 5).alias("pcc"))


@query(
    "WITH x AS (SELECT c_nationkey AS unit, c_acctbal / 1000 AS p, o_totalprice / 100000 AS q FROM customer JOIN orders ON c_custkey = o_custkey), u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT unit FROM x)), d AS (SELECT rep, u.unit, count(*) AS times FROM (SELECT rep, a.i AS k, CAST('0x' || substr(md5('7:' || rep || ':' || a.i), 1, 7) AS INTEGER) % a.m AS pick FROM range(0, 200) r(rep), u a) JOIN u ON u.i = pick GROUP BY 1, 2), s AS (SELECT rep, sum(times) AS n, sum(p * times) AS x, sum(q * times) AS y, sum(p * p * times) AS xx, sum(q * q * times) AS yy, sum(p * q * times) AS xy FROM x JOIN d USING (unit) GROUP BY 1), v AS (SELECT list_sort(list((xy / n - x / n * y / n) / sqrt((xx / n - (x / n) * (x / n)) * (yy / n - (y / n) * (y / n))))) AS l FROM s) SELECT len(l) AS n, round(l[1 + CAST(floor(0.025 * (len(l) - 1)) AS INTEGER)], 5) AS low, round(l[1 + CAST(floor(0.975 * (len(l) - 1)) AS INTEGER)], 5) AS high FROM v"
)
def f29_interval(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("unit"), (F.col("c_acctbal") / 1000).alias("p"), (F.col("o_totalprice") / 100000).alias("q"))
    out = M.bootstrap(rows, "unit", M.draws(rows, "unit", 200, 7), "p", "q").withColumn("all", F.lit(1))
    ranks = M.nearest_ranks(out, "all", "pcc", {"low": 0.025, "high": 0.975})
    return ranks.select("n", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(
    f"WITH r AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value % 5 DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, share, count(*) AS n, round(avg(abs(value - 20)), 4) AS mae, round({_corr('value', 'event_id')}, 6) AS pcc FROM r, (SELECT unnest([1.0, 0.9, 0.8, 0.7])::DOUBLE AS share) WHERE k <= ceil(round(n * share, 9)) GROUP BY 1, 2"
)
def f31_h4_top_confident(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "value", (F.col("value") % 5).alias("conf"))
    kept = M.top_confident(rows, ["user_id"], "conf", ["event_id"], (1.0, 0.9, 0.8, 0.7))
    return kept.groupBy("user_id", "share").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("value") - 20)), 4).alias("mae"), F.round(M.safe_corr("value", "event_id"), 6).alias("pcc"))


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1) ORDER BY n DESC, first LIMIT 3")
def f38_top_counts(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(3).select("event_type", "n")


@query("SELECT round_even(l_discount * 10, 1) AS score, count(*) AS n FROM lineitem GROUP BY 1")
def f39_histogram(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.bround(F.col("l_discount") * 10, 1).alias("score")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(*) AS n FROM events")
def f40_f41_counts(t: Tables) -> DataFrame:
    return t.events.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"), F.count("*").alias("n"))


@query("SELECT count(*) AS users, sum(n) AS rows, max(span) AS longest, round(avg(span), 4) AS mean FROM (SELECT user_id, count(*) AS n, max(value) AS span FROM events GROUP BY 1)")
def f42_f46_manifest(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("span"))
    return g.agg(F.count("*").alias("users"), F.sum("n").alias("rows"), F.max("span").alias("longest"), F.round(F.avg("span"), 4).alias("mean"))


@query("SELECT level, count(*) AS n, round(avg(x), 4) AS mean, round(min(x), 4) AS lo, round(max(x), 4) AS hi FROM (SELECT 'utt' AS level, c_acctbal AS x FROM customer UNION ALL SELECT 'word', o_totalprice FROM orders UNION ALL SELECT 'phone', l_quantity FROM lineitem) GROUP BY 1")
def f43_target_distribution(t: Tables) -> DataFrame:
    part = lambda df, level, c: df.select(F.lit(level).alias("level"), F.col(c).alias("x"))
    rows = part(t.customer, "utt", "c_acctbal").unionByName(part(t.orders, "word", "o_totalprice")).unionByName(part(t.lineitem, "phone", "l_quantity"))
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.min("x"), 4).alias("lo"), F.round(F.max("x"), 4).alias("hi"))


@query(
    "WITH r AS (SELECT DISTINCT user_id, event_type, event_id, value FROM events), s AS (SELECT user_id, event_type, count(*) AS n FROM r GROUP BY 1, 2), k AS (SELECT user_id, count(DISTINCT event_type) AS c FROM r GROUP BY 1), w AS (SELECT event_id, 1.0::DOUBLE / (n * c) * CASE WHEN value < 10 THEN 2 ELSE 1 END AS w FROM r JOIN s USING (user_id, event_type) JOIN k USING (user_id)) SELECT event_id, round(w / (SELECT avg(w) FROM w), 6) AS w FROM w"
)
def f44_inverse_frequency(t: Tables) -> DataFrame:
    r = t.events.select("user_id", "event_type", "event_id", "value").distinct()
    s = r.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    k = s.groupBy("user_id").agg(F.count("*").alias("c"))
    w = r.join(s, ["user_id", "event_type"]).join(k, "user_id").select("event_id", (F.lit(1.0) / (F.col("n") * F.col("c")) * F.when(F.col("value") < 10, 2).otherwise(1)).alias("w"))
    mean = w.agg(F.avg("w").alias("mean"))
    return w.select("event_id", F.round(F.col("w") / mean.scalar(), 6).alias("w"))


@query("SELECT l_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last, max(l_linenumber) AS longest, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def f47_f48_bounds(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.max("l_linenumber").alias("longest"), F.countDistinct("l_partkey").alias("parts"))


@query("WITH r AS (SELECT user_id % 5 AS run, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1) SELECT count(*) AS runs, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM r")
def f49_repeat_runs(t: Tables) -> DataFrame:
    r = t.events.groupBy((F.col("user_id") % 5).alias("run")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return r.agg(F.count("*").alias("runs"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query("SELECT s_nationkey, count(*) AS n, CASE WHEN count(*) > 5 THEN 'done' WHEN count(*) > 2 THEN 'partial' ELSE 'missing' END AS status, sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS covered FROM supplier GROUP BY 1")
def f50_f51_registry(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.supplier.groupBy("s_nationkey").agg(n.alias("n"), F.when(n > 5, "done").when(n > 2, "partial").otherwise("missing").alias("status"), F.sum((F.col("s_acctbal") > 0).cast("int")).alias("covered"))


@query("SELECT l_orderkey, count(*) AS visible, count(*) FILTER (l_linestatus = 'F') AS committed, count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.03) AS supervised FROM lineitem GROUP BY 1")
def f54_f55_mask_counts(t: Tables) -> DataFrame:
    f = F.col("l_linestatus") == "F"
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("visible"), F.count_if(f).alias("committed"), F.count_if(f & (F.col("l_discount") > 0.03)).alias("supervised"))


@query("SELECT event_type, level, count(*) AS n, round(avg(x), 5) AS m FROM (SELECT event_type, 'value' AS level, value AS x FROM events UNION ALL SELECT event_type, 'hour', extract(hour FROM ts) FROM events) GROUP BY 1, 2")
def f10_f13_f52_normalised(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.explode(F.create_map(F.lit("value"), F.col("value"), F.lit("hour"), F.hour("ts").cast("double"))).alias("level", "x"))
    return rows.groupBy("event_type", "level").agg(F.count("*").alias("n"), F.round(F.avg("x"), 5).alias("m"))
