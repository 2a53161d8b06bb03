"""Paired bootstrap, gate analysis, and balancing of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import balance as B
from tidemark.operators import metrics as M

from .metric_queries import _corr
from .registry import Tables, query

_SUMS = "sum(times) AS n, " + ", ".join(f"sum({v} * times) AS {k}" for k, v in {"a": "a", "b": "b", "y": "y", "aa": "a * a", "bb": "b * b", "yy": "y * y", "ay": "a * y", "by_": "b * y"}.items())
_PCC = "({c}{y} / n - {c} / n * y / n) / sqrt(({c}{c} / n - ({c} / n) * ({c} / n)) * (yy / n - (y / n) * (y / n)))"
_DELTA = f"{_PCC.format(c='a', y='y')} - {_PCC.format(c='b', y='y').replace('by /', 'by_ /')}"


@query(
    "WITH x AS (SELECT c_nationkey AS unit, c_acctbal::DOUBLE / 1000 AS a, (o_orderkey % 1000)::DOUBLE / 100 AS b, o_totalprice::DOUBLE / 100000 AS y FROM customer JOIN orders ON c_custkey = o_custkey), u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT unit FROM x)), "
    "d AS (SELECT rep, u.unit, count(*) AS times FROM (SELECT rep, a.i AS k, CAST('0x' || substr(md5('1337:' || rep || ':' || a.i), 1, 7) AS INTEGER) % a.m AS pick FROM range(0, 500) r(rep), u a) JOIN u ON u.i = pick GROUP BY 1, 2), "
    f"s AS (SELECT rep, {_SUMS} FROM x JOIN d USING (unit) GROUP BY 1), w AS (SELECT {_SUMS} FROM (SELECT *, 1 AS times FROM x)), v AS (SELECT list_sort(list({_DELTA})) AS l FROM s) "
    f"SELECT round({_DELTA}, 5) AS delta, round(l[1 + CAST(floor(0.025 * (len(l) - 1)) AS INTEGER)], 5) AS ci_low, round(l[1 + CAST(floor(0.975 * (len(l) - 1)) AS INTEGER)], 5) AS ci_high, CAST(n AS BIGINT) AS paired_n FROM w, v"
)
def f30_paired_delta(t: Tables) -> DataFrame:
    double = lambda c: F.col(c).cast("double")
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("unit"), (double("c_acctbal") / 1000).alias("a"), ((F.col("o_orderkey") % 1000).cast("double") / 100).alias("b"), (double("o_totalprice") / 100000).alias("y"))
    out = M.paired_delta(rows, "unit", M.draws(rows, "unit", 500, 1337), "a", "b", "y")
    return out.select(*[F.round(c, 5).alias(c) for c in ("delta", "ci_low", "ci_high")], "paired_n")


_THIRD = ", ".join(f"round({_corr('CASE WHEN k = {0} THEN q END', 'CASE WHEN k = {0} THEN p END').format(i)}, 6) AS {n}_pcc, count(*) FILTER (k = {i}) AS {n}_n" for i, n in enumerate(("low", "mid", "high")))


@query(
    "WITH x AS (SELECT l_returnflag AS flag, l_discount::DOUBLE + l_linenumber::DOUBLE / 1000 AS gate, l_quantity::DOUBLE AS q, l_tax::DOUBLE AS tax, l_extendedprice::DOUBLE AS p, l_tax::DOUBLE * 10 + (l_partkey % 97)::DOUBLE / 97 AS unsure FROM lineitem), "
    f"g AS (SELECT flag, count(*) AS count, round(avg(gate), 6) AS mean, round(stddev_pop(gate), 6) AS std, {', '.join(f'round(quantile_cont(gate, {s}), 6) AS {n}' for n, s in {'q05': 0.05, 'q25': 0.25, 'q50': 0.5, 'q75': 0.75, 'q95': 0.95}.items())}, round({_corr('gate', 'q')}, 6) AS by_quantity, round({_corr('gate', 'tax')}, 6) AS by_tax, round({_corr('gate', 'p')}, 6) AS by_price, quantile_cont(unsure, 1.0 / 3) AS c1, quantile_cont(unsure, 2.0 / 3) AS c2 FROM x GROUP BY 1), "
    f"k AS (SELECT x.*, CASE WHEN unsure <= c1 THEN 0 WHEN unsure <= c2 THEN 1 ELSE 2 END AS k FROM x JOIN g USING (flag)), h AS (SELECT flag, {_THIRD} FROM k GROUP BY 1) SELECT * EXCLUDE (c1, c2) FROM g JOIN h USING (flag)"
)
def f28_gate_analysis(t: Tables) -> DataFrame:
    """Cuts lie between values that differ, so that the last bit of an interpolated quantile moves no row."""
    d = lambda c: F.col(c).cast("double")
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), (d("l_discount") + d("l_linenumber") / 1000).alias("gate"), d("l_quantity").alias("q"), d("l_tax").alias("tax"), d("l_extendedprice").alias("p"), (d("l_tax") * 10 + (F.col("l_partkey") % 97).cast("double") / 97).alias("unsure"))
    out = M.gate_analysis(rows, "flag", "gate", {"by_quantity": "q", "by_tax": "tax", "by_price": "p"}, "unsure", "q", "p")
    return out.select("flag", *[F.round(c, 6).alias(c) if c.endswith("pcc") or c in ("mean", "std", "q05", "q25", "q50", "q75", "q95", "by_quantity", "by_tax", "by_price") else c for c in out.columns if c != "flag"])


def _u(seed: int, *columns: str) -> str:
    return f"((CAST('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(columns)}), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)"


@query(
    f"WITH x AS (SELECT l_shipdate, l_returnflag || l_linestatus AS label, {_u(11, 'l_orderkey', 'l_linenumber', 'l_partkey')} AS u FROM lineitem), c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM x GROUP BY 1), r AS (SELECT label, unnest(range(0, CAST(floor(most::DOUBLE / n + u) AS BIGINT))) AS copy FROM x JOIN c USING (label)) SELECT label, copy, count(*) AS n FROM r GROUP BY 1, 2"
)
def l8_oversampled(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("label"), "l_orderkey", "l_linenumber", "l_partkey")
    out = B.oversampled(rows, "label", ["l_orderkey", "l_linenumber", "l_partkey"], 11)
    return out.groupBy("label", F.col("copy").cast("long").alias("copy")).agg(F.count("*").alias("n"))


@query(
    f"SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY -ln({_u(12, 'event_id')}) / value, event_id) AS r FROM events WHERE value > 0) WHERE r <= 20"
)
def l8_weighted_sample(t: Tables) -> DataFrame:
    return B.weighted_sample(t.events, ["event_type"], "value", ["event_id"], 20, 12).select("event_type", "event_id")


_EX = "(SELECT user_id % 20 AS cls, event_id, CASE WHEN value % 10 < 3 + user_id % 20 % 6 THEN 2 ELSE event_id % 2 END AS label FROM events)"


@query(
    f"WITH c AS (SELECT cls, count(*) AS n, count(*) FILTER (label = 2) AS own FROM {_EX} GROUP BY 1), l AS (SELECT cls AS dest, 2 * own - n AS lacks, own FROM c WHERE 2 * own > n), p AS (SELECT *, row_number() OVER (ORDER BY {_u(13, 'event_id')}, event_id) - 1 AS place, count(*) OVER () AS size FROM {_EX} WHERE label = 2), "
    f"w AS (SELECT dest, lacks, s, (CAST(floor({_u(13, 'dest')} * size) AS BIGINT) + s) % size AS place FROM (SELECT *, unnest(range(0, least(lacks + own, size))) AS s FROM l, (SELECT count(*) AS size FROM p))), m AS (SELECT dest, p.event_id, row_number() OVER (PARTITION BY dest ORDER BY s) AS r, lacks FROM w JOIN p USING (place) WHERE p.cls <> dest) "
    f"SELECT cls, label, false AS borrowed, count(*) AS n, sum(event_id) AS ids FROM {_EX} GROUP BY 1, 2 UNION ALL SELECT dest, 0, true, count(*), sum(event_id) FROM m WHERE r <= lacks GROUP BY 1"
)
def l8_borrowed(t: Tables) -> DataFrame:
    cls = F.col("user_id") % 20
    rows = t.events.select(cls.alias("cls"), "event_id", F.when(F.col("value") % 10 < 3 + cls % 6, 2).otherwise(F.col("event_id") % 2).alias("label"))
    out = B.with_borrowed(rows, "cls", "label", ["event_id"], 13)
    return out.groupBy("cls", "label", "borrowed").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
