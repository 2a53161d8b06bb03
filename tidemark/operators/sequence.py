"""Sequence features through windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .ordering import numbered


def islands(df: DataFrame, key: str, order: Sequence[str], value: str, name: str = "island") -> DataFrame:
    """Numbers the runs of equal ``value`` within a key, from 0."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def schedule(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``schedule_index`` from 0, ``schedule_count`` and ``progress``, the share of rows up to this one."""
    w = Window.partitionBy(key)
    k = F.row_number().over(w.orderBy(*order))
    return df.withColumn("schedule_index", k - 1).withColumn("schedule_count", F.count("*").over(w)).withColumn("progress", (F.col("schedule_index") + 1) / F.col("schedule_count"))


def delta(value: str, key: str, order: Sequence[str]) -> Column:
    return F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def convergence(df: DataFrame, key: str, order: Sequence[str], progress: str, value: str, eps: float) -> DataFrame:
    """Per key: the earliest progress from which on all values are within ``eps`` of the last (1.0 if none), the index of the
    first value that close, and the mean distance to the last value."""
    w = Window.partitionBy(key).orderBy(*order)
    final = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = df.withColumn("_d", F.abs(F.col(value) - final)).withColumn("_k", F.row_number().over(w) - 1).withColumn("_ok", (F.col("_d") <= eps).cast("int"))
    near = near.withColumn("_rest", F.min("_ok").over(w.rowsBetween(0, Window.unboundedFollowing)))
    return near.groupBy(key).agg(
        F.coalesce(F.min(F.when(F.col("_rest") == 1, F.col(progress))), F.lit(1.0)).alias("stable_from"),
        F.min(F.when(F.col("_ok") == 1, F.col("_k"))).alias("first_stable"),
        F.avg("_d").alias("mean_distance"),
        F.count("*").alias("n"),
    )


def drop_long_runs(df: DataFrame, key: str, order: Sequence[str], label: str, silence: str, least: int) -> DataFrame:
    """Without runs of ``silence`` of ``least`` rows or more; a key that would lose all rows keeps them all."""
    runs = islands(df, key, order, label)
    size = F.count("*").over(Window.partitionBy(key, "island"))
    keep = ~((F.col(label) == silence) & (size >= least))
    kept = runs.withColumn("_keep", F.coalesce(keep, F.lit(True)).cast("int")).withColumn("_any", F.max("_keep").over(Window.partitionBy(key)))
    return kept.where("_keep = 1 OR _any = 0").drop("_keep", "_any", "island")


def pauses(df: DataFrame, key: str, order: Sequence[str], quiet: str, step: float) -> DataFrame:
    """Per key: the runs of true, and the longest in time."""
    runs = islands(df, key, order, quiet).where(F.col(quiet)).groupBy(key, "island").agg(F.count("*").alias("k"))
    per_key = runs.groupBy(key).agg(F.count("*").alias("pause_count"), (F.max("k") * step).alias("longest_pause"))
    return df.select(key).distinct().join(per_key, key, "left").select(key, F.coalesce("pause_count", F.lit(0)).alias("pause_count"), F.coalesce("longest_pause", F.lit(0.0)).alias("longest_pause"))


def local_mean(value: str, key: str, order: Sequence[str], size: int) -> Column:
    """Over this row and the ``size - 1`` before it."""
    return F.avg(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0))


def block_visible(df: DataFrame, key: str, index: str, value: str, block: int, right: int) -> DataFrame:
    """Per row: the count and sum of values up to its block's end and ``right`` rows beyond, by cumulative sums."""
    run = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select(key, F.col(index).alias("_at"), F.sum(value).over(run).alias("seen_sum"), F.count("*").over(run).alias("seen"))
    last = F.max(index).over(Window.partitionBy(key))
    end = F.least((F.floor(F.col(index) / block) + 1) * block - 1 + right, last).cast("int")
    return df.withColumn("_at", end).join(sums.withColumn("_at", F.col("_at").cast("int")), [key, "_at"]).drop("_at")


def slope(y: str, x: str) -> Column:
    """Least squares; 0 without spread."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def vocabulary(df: DataFrame, value: str, order: str) -> DataFrame:
    """``value, id``: dense ids from 0 by first appearance, of any number of values: no task orders them all."""
    firsts = df.groupBy(value).agg(F.min(order).alias("first"))
    return numbered(firsts, [], ["first", value], "id", "_size").select(value, "id")


def relative_to_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Difference and ratio to the group's mean, place in the group from 0 to 1, and its size."""
    w = Window.partitionBy(*keys)
    mean = F.avg(value).over(w)
    return df.withColumn("minus_mean", F.col(value) - mean).withColumn("ratio", F.try_divide(F.col(value), mean)).withColumn("size", F.count("*").over(w))


def loop_kind(tokens: Column, repeats: int = 4, longest: int = 12, coverage: float = 0.6, ratio: float = 0.5, strict: bool = True) -> Column:
    """Why a token array counts as looping, or null: ``cycle`` (a run that comes ``repeats`` times in a row), and if strict
    ``dominant`` (one token has the share ``ratio``, 8 times or twice ``repeats`` at least) or ``periodic`` (copies of one
    run, not overlapping, cover the share ``coverage``)."""
    from collections import defaultdict

    def cycle(t: np.ndarray) -> bool:
        for n in range(1, min(longest, len(t) // repeats) + 1):
            same, need = t[:-n] == t[n:], n * (repeats - 1)  # tokens in a row that equal the one n places before
            if len(same) and np.count_nonzero(same) >= need:
                breaks = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
                if np.diff(breaks).max() - 1 >= need:
                    return True
        return False

    def periodic(t: np.ndarray, counts: np.ndarray) -> bool:
        for n in range(2, min(longest, len(t) // repeats) + 1):
            need = max(repeats, int(coverage * len(t) / n))  # copies at least; each token of theirs comes as often
            if counts[counts >= need].sum() < need * n:
                continue
            free, times, tokens = defaultdict(int), defaultdict(int), t.tolist()
            for i in range(len(tokens) - n + 1):
                gram = tuple(tokens[i : i + n])
                if i >= free[gram]:
                    free[gram], times[gram] = i + n, times[gram] + 1
            best = max(times.values(), default=0)
            if best >= repeats and best * n >= coverage * len(t):
                return True
        return False

    def kind(t: np.ndarray) -> str | None:
        if not len(t) or repeats < 1:
            return None
        if cycle(t):
            return "cycle"
        if not strict:
            return None
        counts = np.unique(t, return_counts=True)[1]
        top = counts.max()
        if top >= max(2 * repeats, 8) and top >= ratio * len(t):
            return "dominant"
        return "periodic" if periodic(t, counts) else None

    @F.arrow_udf(StringType())
    def run(arrays: pa.Array) -> pa.Array:
        codes = arrays.flatten().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = arrays.value_lengths().to_pylist()
        out, at = [], 0
        for size in sizes:
            out.append(None if size is None else kind(codes[at : at + size]))
            at += size or 0
        return pa.array(out, pa.string())

    return run(tokens)


def pad_to_reference(reference: Column, words: Column, scores: Column) -> Column:
    """A score for each reference word: that of the next predicted word if it is the same, else the one before (before the
    first: the last); when the predicted words have run out, one more and then none."""
    at = lambda i: F.try_element_at(scores, F.when(i > 0, i).otherwise(-1))

    def step(acc: Column, w: Column) -> Column:
        i, out, done = acc["i"], acc["out"], acc["done"]
        over = i >= F.size(words)
        hit = ~over & (F.get(words, i) == w)
        value = F.when(hit, F.get(scores, i)).otherwise(at(i))
        return F.struct(F.when(hit, i + 1).otherwise(i).alias("i"), F.when(done, out).otherwise(F.concat(out, F.array(value))).alias("out"), (done | over).alias("done"))

    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<double>").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(reference, start, step, lambda acc: acc["out"])


def words_of_tokens(tokens: DataFrame, key: str, pos: str, text: str, logprob: str) -> DataFrame:
    """Words (runs of letters and apostrophes across tokens) with the mean log-probability of their letters and its exponential."""
    chars = tokens.select(key, pos, logprob, F.posexplode(F.split(text, "")).alias("_c", "ch")).where("ch <> ''")
    letter = F.rlike("ch", F.lit(r"[\p{L}']"))
    w = Window.partitionBy(key).orderBy(pos, "_c")
    rows = chars.withColumn("_l", letter).withColumn("_gap", F.sum((~F.col("_l")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_l")
    each = rows.groupBy(key, F.col("_gap").alias("word_no")).agg(F.sort_array(F.collect_list(F.struct(pos, "_c", "ch")))["ch"].alias("cs"), F.avg(logprob).alias("logprob"), F.min(pos).alias("first"), F.max(pos).alias("last"))
    return each.select(key, "word_no", F.array_join("cs", "").alias("word"), "first", "last", "logprob", F.least(F.exp("logprob"), F.lit(1.0)).alias("confidence"))


def phones_of_words(words: DataFrame, lexicon: DataFrame, word: str, default: str = "AH") -> DataFrame:
    """``phones`` and their ``source``: of the lexicon, else a default phone for every three letters."""
    side = lexicon.select(F.col("word").alias(word), F.col("phones").alias("_p"))
    letters = F.length(F.regexp_replace(F.upper(word), "[^A-Z]", ""))
    fallback = F.array_repeat(F.lit(default), F.greatest(F.ceil(letters / 3), F.lit(1)).cast("int"))
    out = words.join(side, word, "left")
    return out.withColumn("phones", F.coalesce("_p", fallback)).withColumn("source", F.when(F.col("_p").isNotNull(), "lexicon").otherwise("fallback")).drop("_p")
