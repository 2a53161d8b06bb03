"""Commit windows over growing prefixes, in batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import TIME_EPS
from tidemark.operators.align import edit_pairs


def commit_times(duration: Column, step: float) -> Column:
    """``step, 2 * step, ...`` and at last ``duration``; every window begins at 0."""
    n = F.greatest(F.ceil(duration / step - TIME_EPS).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k == n, duration).otherwise(k * step))


def windows(utts: DataFrame, key: str, duration: str, step: float, right: float) -> DataFrame:
    """One row a chunk: ``chunk_id`` from 0, ``commit_time, audio_end, is_final, state_reset, previous_chunk_id``."""
    each = utts.select(key, duration, F.posexplode(commit_times(F.col(duration), step)).alias("chunk_id", "commit_time"))
    final = F.abs(F.col("commit_time") - F.col(duration)) <= TIME_EPS
    return each.select(
        key,
        "chunk_id",
        "commit_time",
        F.when(final, F.col(duration)).otherwise(F.least(F.col(duration), F.col("commit_time") + right)).alias("audio_end"),
        final.alias("is_final"),
        (F.col("chunk_id") == 0).alias("state_reset"),
        (F.col("chunk_id") - 1).alias("previous_chunk_id"),
    )


def visibility(ticks: DataFrame, words: DataFrame, key: str, end: str) -> DataFrame:
    """Per chunk: the words visible (end by ``audio_end``) and committed (end by ``commit_time``), by merged order, not by pairs."""
    marks = lambda at, kind: ticks.select(key, (F.col(at) + TIME_EPS).alias("_t"), F.lit(0).alias("_w"), F.lit(kind).alias("_k"), "chunk_id")
    ends = words.select(key, F.col(end).alias("_t"), F.lit(1).alias("_w"), F.lit("").alias("_k"), F.lit(None).cast("int").alias("chunk_id"))
    run = Window.partitionBy(key).orderBy("_t", F.desc("_w")).rowsBetween(Window.unboundedPreceding, 0)
    counted = ends.unionByName(marks("commit_time", "c")).unionByName(marks("audio_end", "v")).withColumn("n", F.sum("_w").over(run)).where("_w = 0")
    return counted.groupBy(key, "chunk_id").agg(F.max(F.when(F.col("_k") == "c", F.col("n"))).alias("committed"), F.max(F.when(F.col("_k") == "v", F.col("n"))).alias("visible"))


def commit_gate(chunks: DataFrame, key: str, order: str, eligible: str, stable: str, final: str) -> DataFrame:
    """The words committed so far: the least of what time and stability allow, all eligible at the end, never fewer than before."""
    now = F.when(F.col(final), F.col(eligible)).otherwise(F.least(eligible, stable))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = chunks.withColumn("committed", F.max(now).over(w))
    return out.withColumn("new", F.col("committed") - F.coalesce(F.lag("committed").over(Window.partitionBy(key).orderBy(order)), F.lit(0)))


def new_commits(rows: DataFrame, key: str, chunk: str, slot: str, old_slot: str, committed: str) -> DataFrame:
    """Per chunk: committed slots, those whose mapped slot was not committed in the chunk before, and earlier ones dropped."""
    now = rows.where(F.col(committed)).select(key, chunk, slot, old_slot)
    order = rows.select(key, chunk).distinct().withColumn("_prev", F.lag(chunk).over(Window.partitionBy(key).orderBy(chunk)))
    old = now.select(key, F.col(chunk).alias("_prev"), F.col(slot).alias(old_slot), F.lit(True).alias("_had"))
    met = now.join(order, [key, chunk]).join(old, [key, "_prev", old_slot], "left")
    per = met.groupBy(key, chunk).agg(F.count("*").alias("committed"), F.count_if(F.col("_had").isNull()).alias("new"), F.count("_had").alias("kept"))
    before = now.groupBy(key, F.col(chunk).alias("_prev")).agg(F.count("*").alias("_n"))
    out = order.join(per, [key, chunk], "left").join(before, [key, "_prev"], "left")
    zero = F.lit(0)
    return out.select(key, chunk, *[F.coalesce(c, zero).alias(c) for c in ("committed", "new")], (F.coalesce("_n", zero) - F.coalesce("kept", zero)).alias("dropped"))


def running_state(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Sum and count after each row: additive state, so that A then B equals A and B at once."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("state_sum", F.sum(value).over(w)).withColumn("state_count", F.count(value).over(w))


_STATE = "total double, n long, last double"


def stream_state(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The streaming form of ``running_state``: per trigger and key ``key, state_sum, state_count, last``, from state kept between triggers.

    Rows of one trigger are ordered by ``order``; what arrives later than a row already counted is added, not reordered.
    """
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, n, last = state.get if state.exists else (0.0, 0, float("nan"))
        got = pd.concat(list(batches)).sort_values(order)
        total, n, last = total + float(got[value].sum()), n + int(got[value].count()), float(got[value].iloc[-1])
        state.update((total, n, last))
        yield pd.DataFrame({key: [k[0]], "state_sum": [total], "state_count": [n], "last": [last]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state_sum double, state_count long, last double", _STATE, "update", "NoTimeout")


def stream_windows(rows: DataFrame, ts: str, value: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Tumbling windows with a watermark; rows later than ``late`` are dropped."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def next_masks(before: tuple[list, list[int]] | None, tokens: list, words: list, candidate: list[bool]) -> tuple[tuple[list, list[int]], dict]:
    """One chunk's masks from its slots and the state ``(tokens, committed slots)`` of the chunk before; the new state comes first.

    Slots are mapped by a cheapest alignment of the tokens; a pair counts if its tokens are equal. ``cumulative``: candidates
    and mapped committed slots. ``new``: the slots of words that are candidates as a whole and have no mapped slot.
    ``old_slot``: the mapped slot of the chunk before, or -1. ``dropped``: committed slots that map to none. Words below 0
    or null are none.
    """
    pairs = [(i, j) for i, j in edit_pairs(before[0], tokens) if i is not None and j is not None and before[0][i] == tokens[j]] if before else []
    to = dict(pairs)
    mapped = {to[s] for s in before[1] if s in to} if before else set()
    cumulative = [bool(c) or s in mapped for s, c in enumerate(candidate)]
    places: dict = {}
    for s, w in enumerate(words):
        if w is not None and w == w and w >= 0:
            places.setdefault(w, []).append(s)
    new = [False] * len(tokens)
    for own in places.values():
        if all(candidate[s] for s in own) and not mapped.intersection(own):
            for s in own:
                new[s] = True
    old = dict((j, i) for i, j in pairs)
    made = {"cumulative": cumulative, "new": new, "old_slot": [old.get(s, -1) for s in range(len(tokens))], "dropped": sum(s not in to for s in before[1]) if before else 0}
    return (tokens, [s for s, c in enumerate(cumulative) if c]), made


MASKS = "cumulative array<boolean>, new array<boolean>, old_slot array<int>, dropped int"


def chunk_masks(chunks: DataFrame, key: str, order: str, tokens: str, words: str, candidate: str) -> DataFrame:
    """``key, order`` and the masks of each chunk (``next_masks``), for slots that may move. ``tokens, words, candidate`` are arrays by slot.

    A group is the chunks of one utterance, each with its slots.
    """
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in (key, order))

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for at, t, w, c in pdf.sort_values(order)[[order, tokens, words, candidate]].itertuples(index=False):
            state, made = next_masks(state, list(t), list(w), list(c))
            out.append({key: k[0], order: at, **made})
        return pd.DataFrame(out)

    return chunks.select(key, order, tokens, words, candidate).groupBy(key).applyInPandas(run, f"{kinds}, {MASKS}")
