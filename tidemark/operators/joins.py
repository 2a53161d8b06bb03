"""Joins: fallback keys, intervals, best overlap, as-of, nearest, positional, ranking pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import BIN_EPS, TIME_EPS, iou, overlap


def keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: that of the greatest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def fallback_join(left: DataFrame, right: DataFrame, key_sets: Sequence[Sequence[str]], value: str) -> DataFrame:
    """``value`` of the first key set that finds a row, and ``hit``, its number from 0 (null: none).

    ``right`` has one row a key for every key set, or the one of the least value is taken.
    """
    out = left
    for k, keys in enumerate(key_sets):
        side = right.groupBy(*keys).agg(F.min(value).alias(f"_v{k}"), F.lit(k).alias(f"_h{k}"))
        out = out.join(side, list(keys), "left")
    n = range(len(key_sets))
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{k}") for k in n])).withColumn("hit", F.coalesce(*[F.col(f"_h{k}") for k in n])).drop(*[f"_{x}{k}" for k in n for x in "vh"])


def interval_pairs(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of the same key whose intervals overlap (touching ones don't), each once.

    ``left`` has ``key, ls, le``, ``right`` has ``key, rs, re``. Both are dealt to time buckets of ``width``; a pair meets
    in every bucket it shares and is kept in the one where the later of the two begins. So a hot key spreads over its
    buckets and no key is compared as a whole.
    """
    bucket = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor(e / width)))
    a = left.withColumn("_b", bucket(F.col("ls"), F.col("le")))
    b = right.withColumn("_b", bucket(F.col("rs"), F.col("re")))
    met = a.join(b, [key, "_b"]).where((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
    return met.where(F.col("_b") == F.floor(F.greatest("ls", "rs") / width)).drop("_b")


def overlap_weighted(left: DataFrame, right: DataFrame, key: str, width: float, least: float, values: Sequence[str], defaults: Sequence[float], left_id: str) -> DataFrame:
    """Per row of ``left``: the means of ``values`` of the overlapping rows, weighted by overlap; ``defaults`` without any."""
    met = interval_pairs(left, right, key, width).withColumn("w", overlap(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"))).where(F.col("w") >= least)
    agg = met.groupBy(left_id).agg(*[F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum("w")).alias(f"_{v}") for v in values], F.count("*").alias("n_overlap"))
    out = left.join(agg, left_id, "left")
    for v, d in zip(values, defaults, strict=True):
        out = out.withColumn(v, F.coalesce(f"_{v}", F.lit(d))).drop(f"_{v}")
    return out.withColumn("n_overlap", F.coalesce("n_overlap", F.lit(0)))


def best_iou(left: DataFrame, right: DataFrame, key: str, width: float, least: float, left_id: str, right_id: str, value: str, ordinal: str) -> DataFrame:
    """``value`` of the row of greatest IoU if it reaches ``least`` (ties: the least ``right_id``), else of the same ordinal."""
    met = interval_pairs(left, right.drop(ordinal), key, width).withColumn("iou", iou(F.col("ls"), F.col("le"), F.col("rs"), F.col("re")))
    best = met.where(F.col("iou") >= least).groupBy(left_id).agg(F.max_by(value, F.struct("iou", -F.col(right_id))).alias("_best"))
    by_place = right.groupBy(key, ordinal).agg(F.min_by(value, right_id).alias("_place"))
    out = left.join(best, left_id, "left").join(by_place, [key, ordinal], "left")
    return out.withColumn(value, F.coalesce("_best", "_place")).withColumn("by", F.when(F.col("_best").isNotNull(), "iou").when(F.col("_place").isNotNull(), "ordinal")).drop("_best", "_place")


def as_of_bins(rows: DataFrame, key: str, progress: str, value: str, bins: Sequence[float]) -> DataFrame:
    """Per key and bin: the value at the latest progress up to the bin. Keys without one drop out.

    The bins are a literal array, so each row is read once and aggregated before the shuffle.
    """
    each = rows.select(key, progress, value, F.explode(F.array(*[F.lit(b) for b in bins])).alias("bin")).where(F.col(progress) <= F.col("bin") + BIN_EPS)
    return each.groupBy(key, "bin").agg(F.max_by(value, progress).alias(value), F.max(progress).alias(progress))


def nearest_node(rows: DataFrame, key: str, coverage: str, order: str, value: str, nodes: Sequence[float]) -> DataFrame:
    """Per key and node: the value at the coverage nearest to it; ties: the least coverage, then ``order``."""
    each = rows.select(key, coverage, order, value, F.explode(F.array(*[F.lit(n) for n in nodes])).alias("node"))
    rank = F.struct(F.abs(F.col(coverage) - F.col("node")), coverage, order)
    return each.groupBy(key, "node").agg(F.min_by(value, rank).alias(value), F.min_by(coverage, rank).alias(coverage))


def count_until(words: DataFrame, cuts: DataFrame, key: str, end: str, cut: str) -> DataFrame:
    """Per cut: how many of the key's words end by then (with tolerance)."""
    by_time = words.select(key, F.col(end).alias("_t"), F.lit(1).alias("_w"), F.lit(None).cast("double").alias(cut))
    marks = cuts.select(key, (F.col(cut) + TIME_EPS).alias("_t"), F.lit(0).alias("_w"), cut)
    run = Window.partitionBy(key).orderBy("_t", F.desc("_w")).rowsBetween(Window.unboundedPreceding, 0)
    return by_time.unionByName(marks).withColumn("n", F.sum("_w").over(run)).where("_w = 0").select(key, cut, "n")


def positional_join(left: DataFrame, right: DataFrame, group: str, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of equal place in their group; the longer side's rest drops out."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*left_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*right_order)))
    return a.join(b, [group, "place"])


def ranking_pairs(rows: DataFrame, group: str, item: str, pred: str, target: str, margin: float) -> DataFrame:
    """Per group: the pairs with different targets, and the sum of their hinges ``max(0, margin - sign * difference)``.

    No pair is made. Targets of a group are ranked; two ranks part at one highest bit, so each pair is met once, in the node
    of that bit and the bits above. In a node a hinge is ``max(0, low + margin - high)``, and the sum over all rows of the
    higher side comes from running counts and sums in the order of the predictions. A row is in one node for each bit.
    Groups without a pair are left out; rows with a null are in no pair; ``item`` tells rows apart and isn't needed here.
    """
    known = rows.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(F.col(group).alias("g"), F.col(pred).cast("double").alias("p"), F.col(target).alias("t"))
    levels = known.groupBy("g", "t").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("g")
    levels = levels.select(F.col("g").alias("lg"), F.col("t").alias("lt"), (F.row_number().over(whole.orderBy("t")) - 1).alias("rank"), F.ceil(F.log2(F.count("*").over(whole).cast("double"))).cast("int").alias("bits"))
    ranked = known.join(levels, F.col("g").eqNullSafe(F.col("lg")) & (F.col("t") == F.col("lt"))).select("g", "p", "rank", "bits").where("bits > 0")
    bit = ranked.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    shift = lambda n: F.call_function("shiftright", F.col("rank"), n)
    high = shift(F.col("b")).bitwiseAND(F.lit(1))
    nodes = bit.select("g", "b", shift(F.col("b") + 1).alias("node"), high.alias("high"), (F.col("p") + F.when(high == 1, 0.0).otherwise(margin)).alias("at"), F.col("p"))
    run = Window.partitionBy("g", "b", "node").orderBy("at", F.desc("high")).rowsBetween(Window.unboundedPreceding, 0)
    side = F.col("high") == 1
    met = nodes.withColumn("k", F.count(F.when(side, 1)).over(run)).withColumn("s", F.sum(F.when(side, F.col("p")).otherwise(0.0)).over(run)).withColumn("all", F.count(F.when(side, 1)).over(Window.partitionBy("g", "b", "node")))
    lows = met.where(~side)
    return lows.groupBy(F.col("g").alias(group)).agg(F.sum("all").alias("pairs"), F.sum(F.col("at") * F.col("k") - F.col("s")).alias("loss")).where("pairs > 0")



def previous_slot(rows: DataFrame, key: str, chunk: str, slot: str, old_slot: str, value: str) -> DataFrame:
    """The value that the mapped slot had in the chunk before."""
    chunks = rows.select(key, chunk).distinct().withColumn("_prev", F.lag(chunk).over(Window.partitionBy(key).orderBy(chunk)))
    old = rows.select(key, F.col(chunk).alias("_prev"), F.col(slot).alias("_old"), F.col(value).alias("previous"))
    now = rows.join(chunks, [key, chunk]).withColumn("_old", F.col(old_slot))
    return now.join(old, [key, "_prev", "_old"], "left").drop("_prev", "_old")


def changed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, missing ones included."""
    both = a.select(key, F.col(value).alias("old")).join(b.select(key, F.col(value).alias("new")), key, "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def frames_in_slots(frames: DataFrame, slots: DataFrame, key: str, time: str, width: float, closed: bool = False) -> DataFrame:
    """Pairs of a slot (``ls, le``) and the frames of its key from its start to before its end, or to its end if ``closed``, by time buckets."""
    f = frames.withColumn("_b", F.floor(F.col(time) / width))
    s = slots.withColumn("_b", F.explode(F.sequence(F.floor(F.col("ls") / width), F.floor(F.col("le") / width))))
    return s.join(f, [key, "_b"]).where((F.col(time) >= F.col("ls")) & (F.col(time) <= F.col("le") if closed else F.col(time) < F.col("le"))).drop("_b")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash; the same rows every time."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(n).drop("_h")
