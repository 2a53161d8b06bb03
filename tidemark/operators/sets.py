"""Merging, splitting, sharding, and gates on coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CoverageError(ValueError):
    """A gate found too few rows."""


def merge_preferring(rows: DataFrame, keys: Sequence[str], good: Column, order: Sequence[str]) -> DataFrame:
    """One row a key: the first good one, else the first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((~good).alias("bad"), *order)).alias("_r")).select(*keys, "_r.*")


def remaining(manifest: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return manifest.join(done.select(*keys).distinct(), list(keys), "left_anti")


def coverage(manifest: DataFrame, done: DataFrame, keys: Sequence[str], group: str, good: str) -> DataFrame:
    """Per group: rows, rows found, good rows, and the good share."""
    side = done.groupBy(*keys).agg(F.max(F.col(good).cast("int")).alias("_ok"))
    out = manifest.join(side, list(keys), "left").groupBy(group)
    return out.agg(F.count("*").alias("rows"), F.count("_ok").alias("hit"), F.coalesce(F.sum("_ok"), F.lit(0)).alias("ok"), (F.coalesce(F.sum("_ok"), F.lit(0)) / F.count("*")).alias("ok_share"))


def require(report: DataFrame, share: str, least: float) -> DataFrame:
    """``report``; raises if a group's share is below ``least`` or there is no group."""
    low = report.agg(F.count("*").alias("n"), F.min(share).alias("least")).first()
    if not low.n or low.least < least:
        raise CoverageError(f"{share} is {low.least} in some group; {least} is required")
    return report


def status_counts(df: DataFrame, by: Sequence[str], required: dict[str, Sequence[str]]) -> DataFrame:
    """Rows by ``by``; raises if there are none or a required value of a column has none."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(F.when(F.col(c) == v, F.col("n"))), F.lit(0)).alias(f"{c}={v}") for c, vs in required.items() for v in vs]).first().asDict()
    if empty := [k for k, n in seen.items() if not n]:
        raise CoverageError(f"no rows: {empty}")
    return counts


def shard(df: DataFrame, index: str, k: int, n: int) -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(n)) == k)


def hold_out(df: DataFrame, unit: str, quota: float, seed: int) -> DataFrame:
    """``unit, held_out``: whole units, in a seeded order, until the share ``quota`` of rows is reached.

    The order is that of a hash, so its first digits cut it into 4096 even stretches: rows before a stretch are summed over
    their totals, rows before a unit inside its stretch.
    """
    counts = df.groupBy(unit).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(unit).cast("string")).cast("binary"))).withColumn("_b", F.substring("_h", 1, 3))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("_b").agg(F.sum("n").alias("_n"))  # 4096 rows at most
    parts = parts.select("_b", ahead(Window.orderBy("_b"), "_n").alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    run = counts.withColumn("_in", ahead(Window.partitionBy("_b").orderBy("_h", unit), "n")).join(F.broadcast(parts), "_b")
    return run.select(unit, (F.col("_before") + F.col("_in") < F.ceil(F.col("_total") * quota)).alias("held_out"))


def key_sets(df: DataFrame, column: str) -> DataFrame:
    """One row: the map keys found in every row, and those found in any."""
    keys = df.select(F.explode(F.map_keys(column)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    n = df.agg(F.count("*").alias("rows"))
    joined = keys.join(F.broadcast(n), F.col("n") <= F.col("rows"))
    return joined.agg(F.sort_array(F.collect_list(F.when(F.col("n") == F.col("rows"), F.col("k")))).alias("in_all"), F.sort_array(F.collect_list("k")).alias("in_any"))


def cross_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in both, in the first only, and in the second only."""
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second")
    )


def constraint(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, violations``: rows that break each rule (null counts as broken)."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(k))])).alias("rule", "violations"))


def skip_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that holds; null for good rows."""
    out = F.lit(None).cast("string")
    for name, cond in reversed(checks):
        out = F.when(F.coalesce(cond, F.lit(False)), name).otherwise(out)
    return out
