"""Balancing of classes: oversampling, weighted sampling, and examples borrowed from other classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


def unit_hash(seed: int, *columns: Column | str) -> Column:
    """A number in (0, 1) that depends on the values and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *columns).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 32)


def oversampled(df: DataFrame, label: str, ids: Sequence[str], seed: int) -> DataFrame:
    """Each class about as often as the largest: a row comes r times, with r = largest / own, rounded up or down by a hash.

    The expected size of each class is the largest's; rows of the largest come once. ``copy`` counts a row's repeats from 0.
    Class counts are a small table, so nothing but its join moves. Null labels are a class.
    """
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_most", F.max("_n").over(Window.partitionBy()))  # a row a class
    times = F.floor(F.col("_most") / F.col("_n") + unit_hash(seed, *ids)).cast("int")
    out = df.join(counts, F.col(label).eqNullSafe(F.col("_label"))).withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    return out.drop("_label", "_n", "_most")


def weighted_sample(df: DataFrame, group: Sequence[str], weight: str, ids: Sequence[str], k: int, seed: int) -> DataFrame:
    """k rows a group without replacement, in proportion to ``weight``: those with the least exponential keys.

    A row's key is -ln(u) / weight; rows with a weight of 0, less or null are never drawn. ``ids`` break ties and should
    name a row. Groups of any size: no task orders a whole one.
    """
    key = -F.ln(unit_hash(seed, *ids)) / F.col(weight)
    drawn = numbered(df.where(F.col(weight) > 0).withColumn("_key", key), group, ["_key", *ids], "_place", "_size")
    return drawn.where(F.col("_place") < k).drop("_key", "_place", "_size")


def with_borrowed(df: DataFrame, cls: str, label: str, ids: Sequence[str], seed: int, top: int = 2, as_label: int = 0) -> DataFrame:
    """``df`` and examples labelled ``top`` of other classes, labelled ``as_label``, until a class has twice its own ``top`` examples.

    A class lacks ``2 * n(top) - n`` examples. All ``top`` examples are shuffled once by hash; a class takes the ones that
    follow a place of its own, without those of itself, as many as it lacks or as there are. ``borrowed`` marks them.
    """
    counts = df.groupBy(cls).agg(F.count("*").alias("n"), F.count_if(F.col(label) == top).alias("own"))
    lacking = counts.select(F.col(cls).alias("_to"), (2 * F.col("own") - F.col("n")).alias("_lacks"), "own").where("_lacks > 0")
    pool = numbered(df.where(F.col(label) == top).withColumn("_key", unit_hash(seed, *ids)), [], ["_key", *ids], "_place", "_size")
    size = pool.count()
    # own + lacks places in a row hold at least as many examples of others as are lacking
    reach = F.least(F.col("_lacks") + F.col("own"), F.lit(size)).cast("long")
    first = F.floor(unit_hash(seed, "_to") * size).cast("long")
    wanted = lacking.where(F.lit(size > 0)).select("_to", "_lacks", F.posexplode(F.sequence(first, first + reach - 1)).alias("_step", "_at")).withColumn("_at", F.col("_at") % max(size, 1))
    met = wanted.join(pool, F.col("_at") == F.col("_place")).where(~F.col("_to").eqNullSafe(F.col(cls)))
    taken = numbered(met.drop("_place", "_size"), ["_to"], ["_step"], "_place", "_size").where(F.col("_place") < F.col("_lacks"))
    columns = [F.col("_to").alias(c) if c == cls else F.lit(as_label).cast(df.schema[c].dataType).alias(c) if c == label else F.col(c) for c in df.columns]
    return df.withColumn("borrowed", F.lit(False)).unionByName(taken.select(*columns, F.lit(True).alias("borrowed")))
