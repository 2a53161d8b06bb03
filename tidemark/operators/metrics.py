"""Metrics with explicit rules for degenerate input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite

from .ordering import numbered, quantiles, running

CORR_TOL = 1e-12


def safe_corr(x: Column | str, y: Column | str, default: float | None = None, tol: float = CORR_TOL) -> Column:
    """Pearson's correlation; ``default`` for fewer than two rows or a side whose deviation is ``tol`` or less."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.coalesce(F.when((F.count("*") >= 2) & (sx > tol) & (sy > tol), F.try_divide(F.covar_pop(x, y), sx * sy)), F.lit(default).cast("double"))


def pairs_only(df: DataFrame, pred: str, target: str) -> DataFrame:
    return df.where(finite(F.col(pred)) & finite(F.col(target)))


def errors(pred: str, target: str) -> list[Column]:
    d = F.col(pred) - F.col(target)
    return [F.count("*").alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae")]


def long_form(df: DataFrame, keys: Sequence[str], dims: dict[str, tuple[str, str]]) -> DataFrame:
    """``keys, dim, pred, target``: one row per dimension."""
    parts = [F.struct(F.lit(k).alias("dim"), F.col(p).cast("double").alias("pred"), F.col(t).cast("double").alias("target")) for k, (p, t) in dims.items()]
    return df.select(*keys, F.explode(F.array(*parts)).alias("x")).select(*keys, "x.*")


def masked_mse(pred: Column, target: Column, mask: Column, weight: Column | None = None, floor: float = 1.0) -> Column:
    """Squared errors under mask and weight, by their sum or ``floor`` if that is more; what isn't finite counts as 0."""
    w = mask if weight is None else mask * weight
    d = F.when(finite(pred - target), pred - target).otherwise(0.0)
    return F.sum(d * d * w) / F.greatest(F.sum(w), F.lit(floor))


def bins(conf: Column, edges: Sequence[float]) -> Column:
    """The half-open bin of ``conf``, the last one closed; edges are literals so that two engines agree."""
    out = F.lit(len(edges) - 2)
    for k in range(len(edges) - 3, -1, -1):
        out = F.when(conf < edges[k + 1], k).otherwise(out)
    return out


#: Ten equal bins.
TENTHS = tuple(k / 10 for k in range(11))


def ece(df: DataFrame, group: Sequence[str], conf: str, target: str) -> DataFrame:
    """Expected calibration error over ten bins."""
    per_bin = df.withColumn("bin", bins(F.col(conf), TENTHS)).groupBy(*group, "bin").agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(target).alias("t"))
    return per_bin.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("t"))) / F.sum("n")).alias("ece"))


def risk_coverage(df: DataFrame, group: str, conf: str, error: str, tie: Sequence[str]) -> DataFrame:
    """``coverage, risk, k`` after each row, the most confident first, and ``risk_before`` it (null for the first). Groups of any size."""
    each = running(df.select(group, conf, error, *[t for t in tie if t not in (group, conf, error)]), [group], [F.desc(conf), *tie], error, "_sum")
    k = F.col("place") + 1
    before = F.try_divide(F.col("_sum") - F.coalesce(error, F.lit(0)), F.col("place"))
    return each.select(group, (k / F.col("size")).alias("coverage"), (F.col("_sum") / k).alias("risk"), before.alias("risk_before"), k.alias("k"), "size")


def aurc(points: DataFrame, group: str) -> DataFrame:
    """Trapezoids under the risk over the coverage of ``risk_coverage``."""
    return points.groupBy(group).agg(F.sum((F.col("risk") + F.col("risk_before")) / (2 * F.col("size"))).alias("aurc"))


def auroc(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """By rank sums with average ranks for ties; null without both classes.

    Rows are first counted by score, so the window runs over distinct scores.
    """
    per = df.groupBy(group, score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("rank", before + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(group).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    return sums.select(group, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * neg).alias("auroc"))


def auprc(df: DataFrame, group: str, score: str, label: str, tie: Sequence[str]) -> DataFrame:
    """Trapezoids of precision over recall, without a point at recall 0. Groups of any size: no task orders a whole one."""
    each = running(df.select(group, score, label, *[t for t in tie if t not in (group, score, label)]), [group], [F.desc(score), *tie], label, "_tp")
    total = df.groupBy(F.col(group).alias("_g")).agg(F.sum(label).alias("_total"))
    met = each.join(total, F.col(group).eqNullSafe(F.col("_g")))
    k, tp, before = F.col("place") + 1, F.col("_tp"), F.col("_tp") - F.coalesce(label, F.lit(0))
    width = F.try_divide(tp, F.col("_total")) - F.try_divide(before, F.col("_total"))
    height = tp / k + F.try_divide(before, k - 1)  # null for the first row, which has no trapezoid
    return met.groupBy(group).agg(F.sum(width * height / 2).alias("auprc"))


def nearest_ranks(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group: ``n, lo, hi, mean``, and for each named share q the value at index ``floor(q * (n - 1))`` of the sorted values.

    Values are counted first, so that windows run over distinct values and no group is collected.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_k"))
    per = per.withColumn("_upto", F.sum("_k").over(Window.partitionBy(group).orderBy(value))).withColumn("_n", F.sum("_k").over(Window.partitionBy(group)))
    at = [F.min(F.when(F.col("_upto") > F.floor(q * (F.col("_n") - 1)), F.col(value))).alias(name) for name, q in shares.items()]
    return per.groupBy(group).agg(F.max("_n").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), (F.sum(F.col("_k") * F.col(value)) / F.sum("_k")).alias("mean"), *at)


def top_confident(df: DataFrame, group: Sequence[str], conf: str, tie: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """For each share the rows among the ``ceil(n * share)`` most confident, with ``share``. Groups of any size."""
    ranked = numbered(df, group, [F.desc(conf), *tie], "_k", "_n")
    each = ranked.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    return each.where(F.col("_k") < F.ceil(F.round(F.col("_n") * F.col("share"), 9))).drop("_k", "_n")


def last_word_safe(df: DataFrame, keys: Sequence[str], word: str, pred: str, target: str) -> DataFrame:
    """Means by word; every word counts, the last one too."""
    return df.where(F.col(target) >= 0).groupBy(*keys, word).agg(F.avg(pred).alias("pred"), F.round(F.avg(target), 2).alias("target"))


def draws(df: DataFrame, unit: str, reps: int, seed: int) -> DataFrame:
    """``rep, unit, times``: for each replicate as many units as ``df`` has, drawn with replacement by a seeded hash.

    Units are few (speakers): they are numbered in their order, and a replicate has a row for each.
    """
    units = df.select(unit).distinct().withColumn("_i", F.row_number().over(Window.orderBy(unit)) - 1)
    n = units.count()
    picks = df.sparkSession.range(reps * n).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), (F.col("id") % max(n, 1)).alias("k"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "k").cast("binary")), 1, 7)
    picks = picks.select("rep", F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(max(n, 1))).cast("int").alias("_i"))
    return picks.groupBy("rep", "_i").agg(F.count("*").alias("times")).join(units, "_i").select("rep", unit, "times")


def bootstrap(df: DataFrame, unit: str, draws: DataFrame, pred: str, target: str) -> DataFrame:
    """Per replicate: the correlation over the units drawn. ``draws`` has ``rep, unit, times`` and is small: units times replicates.

    Sums per unit are made first, so the join handles units, not rows.
    """
    x, y = F.col(pred), F.col(target)
    sums = df.groupBy(unit).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    t = lambda c: F.sum(F.col(c) * F.col("times")).alias(c)
    s = sums.join(draws, unit).groupBy("rep").agg(*[t(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    cov = F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n")
    vx, vy = F.col("xx") / F.col("n") - F.pow(F.col("x") / F.col("n"), 2), F.col("yy") / F.col("n") - F.pow(F.col("y") / F.col("n"), 2)
    return s.select("rep", F.when((vx > CORR_TOL) & (vy > CORR_TOL), cov / F.sqrt(vx * vy)).alias("pcc"))


def paired_bootstrap(df: DataFrame, unit: str, draws: DataFrame, pred_a: str, pred_b: str, target: str) -> DataFrame:
    """Per replicate: ``pcc_a, pcc_b, delta`` of two predictions of one target, over the same units drawn.

    One table of joint sums a unit serves both; rows with a null in any of the three are left out of both.
    """
    a, b, y = (F.col(c).cast("double") for c in (pred_a, pred_b, target))
    parts = {"n": F.lit(1.0), "a": a, "b": b, "y": y, "aa": a * a, "bb": b * b, "yy": y * y, "ay": a * y, "by": b * y}
    sums = df.where(a.isNotNull() & b.isNotNull() & y.isNotNull()).groupBy(unit).agg(*[F.sum(v).alias(k) for k, v in parts.items()])
    s = sums.join(draws, unit).groupBy("rep").agg(*[F.sum(F.col(k) * F.col("times")).alias(k) for k in parts])
    mean = lambda c: F.col(c) / F.col("n")
    var = lambda c: mean(c + c) - mean(c) * mean(c)
    pcc = lambda c: F.when((var(c) > CORR_TOL) & (var("y") > CORR_TOL), (mean(c + "y") - mean(c) * mean("y")) / F.sqrt(var(c) * var("y")))
    return s.select("rep", pcc("a").alias("pcc_a"), pcc("b").alias("pcc_b")).withColumn("delta", F.col("pcc_a") - F.col("pcc_b"))


def paired_delta(df: DataFrame, unit: str, draws: DataFrame, pred_a: str, pred_b: str, target: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: ``delta`` over all rows, ``ci_low, ci_high`` over the replicates, ``paired_n``. Without a replicate the interval is the delta."""
    once = df.select(unit).distinct().select(unit, F.lit(0).alias("rep"), F.lit(1).alias("times"))
    keyed = lambda d: d.withColumn("_all", F.lit(1))
    whole = keyed(paired_bootstrap(df, unit, once, pred_a, pred_b, target).select("delta"))
    reps = keyed(paired_bootstrap(df, unit, draws, pred_a, pred_b, target).where("delta IS NOT NULL").withColumnRenamed("delta", "_d"))
    ranks = nearest_ranks(reps, "_all", "_d", {"ci_low": low, "ci_high": high}).select("_all", "ci_low", "ci_high")
    n = keyed(df.where(F.col(pred_a).isNotNull() & F.col(pred_b).isNotNull() & F.col(target).isNotNull()).agg(F.count("*").alias("paired_n")))
    joined = n.join(whole, "_all", "left").join(ranks, "_all", "left")
    return joined.select("delta", F.coalesce("ci_low", "delta").alias("ci_low"), F.coalesce("ci_high", "delta").alias("ci_high"), "paired_n")


def gate_analysis(df: DataFrame, group: str, gate: str, against: dict[str, str], unsure: str, pred: str, target: str) -> DataFrame:
    """A row a group: ``count, mean, std, q05, q25, q50, q75, q95`` of ``gate``, its correlations with the columns ``against`` by name,
    and in each third by ``unsure`` the correlation of prediction and target (``low_pcc, low_n`` and so on).

    Rows without a gate are left out. Thirds are cut at interpolated quantiles, which come from the neighbouring rows in a
    range sort; no group is ordered in one task.
    """
    rows = df.where(F.col(gate).isNotNull())
    pairs = rows.where(F.col(unsure).isNotNull() & F.col(pred).isNotNull() & F.col(target).isNotNull())
    q = quantiles(rows, [group], gate, {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95})
    base = rows.groupBy(group).agg(F.count("*").alias("count"), F.avg(gate).alias("mean"), F.stddev_pop(gate).alias("std"), *[safe_corr(gate, c).alias(n) for n, c in against.items()])
    cuts = quantiles(pairs, [group], unsure, {"_low": 1 / 3, "_high": 2 / 3})
    third = F.when(F.col(unsure) <= F.col("_low"), "low").when(F.col(unsure) <= F.col("_high"), "mid").otherwise("high")
    met = pairs.join(cuts, group).withColumn("_third", third)
    parts = []
    for name in ("low", "mid", "high"):
        own = F.col("_third") == name
        parts += [safe_corr(F.when(own, F.col(pred)), F.when(own, F.col(target))).alias(f"{name}_pcc"), F.count_if(own).alias(f"{name}_n")]
    return base.join(q, group).join(met.groupBy(group).agg(*parts), group, "left")
