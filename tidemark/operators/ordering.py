"""Places in an order without one task that sorts a whole group: a range sort, and offsets by task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import folder


def _placed(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], place: str, size: str, sums: dict[str, str]) -> DataFrame:
    """``numbered`` and, by name, the sums of columns up to and with each row."""
    keys, spark, path = list(group), df.sparkSession, folder(df.sparkSession, "ordered")
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_task", F.shiftright("_at", 33))
    counts = placed.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_here"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*keys)
    before = lambda c: F.coalesce(F.sum(c).over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = (before("_here") - F.col("_first")).alias("_shift")
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_task").alias("_t"), shift, F.sum("_here").over(whole).alias(size), *[before(f"_sum_{n}").alias(f"_before_{n}") for n in sums])
    if sums:  # within a task, whose share of a group the range sort bounds
        run = Window.partitionBy(*keys, "_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumns({n: F.coalesce(F.sum(c).over(run), F.lit(0)) for n, c in sums.items()})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_task") == F.col("_t"))
    out = placed.join(counts, same).withColumns({place: F.col("_at") + F.col("_shift"), **{n: F.col(n) + F.col(f"_before_{n}") for n in sums}})
    return out.drop("_at", "_task", "_t", "_shift", *[f"_k{i}" for i in range(len(keys))], *[f"_before_{n}" for n in sums])


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], place: str = "place", size: str = "size") -> DataFrame:
    """``df`` with the place of each row in its group, from 0, and the group's size. ``group`` may be empty; null keys are a group.

    The sorted rows are written, so that places stay the same whatever is computed again; a row's place is its place in its
    task and the rows of its group in earlier tasks, of which there is one count a group and task. Rows equal in ``order``
    get different places in no defined order.
    """
    return _placed(df, group, order, place, size, {})


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], value: str, total: str = "running") -> DataFrame:
    """``numbered``, with the sum of ``value`` up to and with each row: in its task, and of the group's rows in earlier tasks."""
    return _placed(df, group, order, "place", "size", {total: value})


def quantiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values, a row a group: of the rows next to each place only."""
    placed = numbered(df.where(F.col(value).isNotNull()).select(*group, value), group, [value])
    at = {n: F.lit(s) * (F.col("size") - 1) for n, s in shares.items()}
    near = [F.abs(F.col("place") - p) < 1 for p in at.values()]
    kept = placed.where(reduce(lambda a, b: a | b, near))
    each = [F.sum(F.when(c, F.col(value) * (1 - F.abs(F.col("place") - at[n])))).alias(n) for c, n in zip(near, shares, strict=True)]
    return kept.groupBy(*group).agg(*each)
