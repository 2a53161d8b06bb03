"""Chunk rows: for each commit of an utterance one row with its visible slots, what is committed, what is new, and what was revised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.functions.scalars import TIME_EPS


#: Fixed value: pairs of slots and chunks that a task is to have at most, as far as keys allow.
ITEMS_PER_TASK = 250_000


def tasks(chunks: DataFrame, slots: DataFrame, key: str) -> int:
    """How many tasks the pairs of slots and chunks of a key need: they grow from few bytes, so no size read before tells."""
    sizes = slots.groupBy(key).agg(F.count("*").alias("_s")).join(chunks.groupBy(key).agg(F.count("*").alias("_c")), key)
    pairs = sizes.agg(F.sum(F.col("_s") * F.col("_c"))).first()[0] or 0
    return max(-(-pairs // ITEMS_PER_TASK), chunks.sparkSession.sparkContext.defaultParallelism)


def visible_slots(chunks: DataFrame, slots: DataFrame, key: str, end: str, n: int | None = None, every: bool = False) -> DataFrame:
    """Each slot in each chunk whose audio reaches its end; the rows of a chunk row, so their number is that of the result's items.

    The rows lie in ``n`` tasks (by default ``tasks``) by key, which serves all that ``committed_slots`` and ``chunk_rows``
    do with them. ``every``: a chunk without a slot has one row, and ``_seen`` tells the others from it.
    """
    n = n or tasks(chunks, slots, key)
    reached = F.col(end) <= F.col("audio_end") + TIME_EPS
    if not every:
        return slots.repartition(n, key).join(chunks.repartition(n, key), key).where(reached)
    items = slots.withColumnRenamed(key, "_key").withColumn("_seen", F.lit(True)).repartition(n, "_key")
    return chunks.repartition(n, key).join(items, (F.col(key) == F.col("_key")) & reached, "left").drop("_key")


def committed_slots(rows: DataFrame, key: str, chunk: str, slot: str, token: str, word: str, candidate: str) -> DataFrame:
    """``rows`` with ``mapped, cumulative, new, leaves``: the state that one chunk hands to the next, without going through them one by one.

    A slot's state lives as long as its token: a run of following chunks with the same token is an island, and inside it a
    slot is committed from the first chunk on where it is a candidate. ``mapped``: committed in the chunk before with the
    same token. ``new``: all slots of the word are candidates and none is mapped. ``leaves``: committed here, but revised
    or gone in the next chunk. Null words are never new. A (key, chunk, slot) comes once.
    """
    of_slot = Window.partitionBy(key, slot).orderBy(chunk)
    upto = of_slot.rowsBetween(Window.unboundedPreceding, 0)
    same = (F.lag(chunk).over(of_slot) == F.col(chunk) - 1) & F.lag(token).over(of_slot).eqNullSafe(F.col(token))
    out = rows.withColumn("_same", F.coalesce(same, F.lit(False)))
    began, met = (F.max(F.when(c, F.col(chunk))).over(upto) for c in (~F.col("_same"), F.col(candidate)))  # the island's first chunk, the last candidate
    out = out.withColumn("cumulative", F.coalesce(met >= began, F.lit(False)))
    out = out.withColumn("mapped", F.col("_same") & F.coalesce(F.lag("cumulative").over(of_slot), F.lit(False)))
    out = out.withColumn("leaves", F.col("cumulative") & ~F.coalesce(F.lead("_same").over(of_slot), F.lit(False)))
    of_word = Window.partitionBy(key, chunk, word)
    new = F.min(F.coalesce(candidate, F.lit(False))).over(of_word) & ~F.max("mapped").over(of_word) & F.col(word).isNotNull()
    return out.withColumn("new", new).drop("_same")


def chunk_rows(chunks: DataFrame, rows: DataFrame, key: str, chunk: str, slot: str, token: str, word: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``chunks``, those without a slot included: its columns and ``slots`` (structs by slot), counts and ``stability``.

    ``rows`` comes from ``committed_slots``. ``dropped`` counts slots committed in the chunk before that are revised or gone.
    ``stability``: the share of the tokens before that still begin this chunk's; 1 where there were none. ``extra``: more
    fields of the slots. Rows that hold every chunk (``_seen`` of ``visible_slots``) are grouped where they lie: no item is
    written to a shuffle.
    """
    more = [c.alias(n) for n, c in (extra or {}).items()]
    item = F.struct(F.col(slot).alias("slot"), F.col(token).alias("token"), F.col(word).alias("word"), "cumulative", "new", "mapped", *more)
    every = "_seen" in rows.columns
    seen = F.col("_seen").isNotNull() if every else F.lit(True)
    own = [F.first(c).alias(c) for c in chunks.columns if every and c not in (key, chunk)]
    out = rows.groupBy(key, chunk).agg(
        *own,
        F.sort_array(F.collect_list(F.when(seen, item))).alias("slots"),  # the slots of one chunk of one utterance
        F.count_if(seen & F.col("leaves")).alias("_leaves"),
    )
    if not every:
        out = chunks.join(out, [key, chunk], "left").withColumn("slots", F.coalesce("slots", F.array().cast(out.schema["slots"].dataType)))

    def words(flag: str) -> Column:  # from the array: distinct counts would expand and shuffle the rows
        held = F.filter("slots", lambda s: s[flag] & s["word"].isNotNull())
        return F.size(F.array_distinct(F.transform(held, lambda s: s["word"]))).cast("long")

    order = Window.partitionBy(key).orderBy(chunk)
    before = F.lag(F.col("slots")["token"]).over(order)
    kept = F.when(F.size(before) > 0, V.common_prefix(before, F.col("slots")["token"]) / F.size(before)).otherwise(F.lit(1.0))
    return out.select(
        *chunks.columns,
        "slots",
        words("new").alias("new_words"),
        words("cumulative").alias("committed_words"),
        F.coalesce(F.lag("_leaves").over(order), F.lit(0)).alias("dropped"),
        kept.alias("stability"),
    )
