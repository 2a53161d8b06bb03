"""Operators made of several others: prosody vectors, teacher targets, open-response word pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import frames_in_slots, interval_pairs
from .sequence import pauses, slope

#: The least duration and energy; the quantile below which a frame is silent; the seconds between frames.
EPS, QUIET, HOP = 1e-8, 0.2, 0.01
#: Accuracy, stress and total of a word that overlaps no reference word.
UNMATCHED = (0.0, 5.0, 1.0)
VOWELS = ("A", "E", "I", "O", "U")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def prosody_vector(frames: DataFrame, utts: DataFrame, key: str) -> DataFrame:
    """Per utterance 14 features, from ``frames`` (``key, frame, rms, f0, voiced_prob``; null f0: unvoiced) and ``utts`` (``key, audio_end, words, phones``).

    Utterances without frames have zeros. Slopes are by frame, and for f0 by the place among voiced frames.
    """
    level = frames.groupBy(key).agg(F.greatest(F.percentile("rms", QUIET), F.lit(EPS)).alias("_level"))
    by_frame = Window.partitionBy(key).orderBy("frame")
    rows = frames.join(level, key).withColumn("quiet", F.col("rms") <= F.col("_level")).withColumn("energy", F.log(F.greatest("rms", F.lit(EPS))))
    rows = rows.withColumn("i", F.row_number().over(by_frame)).withColumn("v", F.when(F.col("f0").isNotNull(), F.count("f0").over(by_frame)))
    per = rows.groupBy(key).agg(
        F.avg("f0").alias("f0_mean"), F.stddev_pop("f0").alias("f0_std"), slope("f0", "v").alias("f0_slope"), F.avg("voiced_prob").alias("voiced"), F.avg("energy").alias("energy_mean"), F.stddev_pop("energy").alias("energy_std"),
        slope("energy", "i").alias("energy_slope"), F.avg(F.col("quiet").cast("double")).alias("silence_ratio"), (F.count("f0") / F.count("*")).alias("_voiced"),
    )
    out = utts.join(per, key, "left").join(pauses(rows, key, ["frame"], "quiet", HOP), key, "left")
    length, any_frame = F.greatest("audio_end", F.lit(EPS)), F.col("_voiced").isNotNull()
    features = {
        "duration": length, **{c: F.col(c) for c in ("f0_mean", "f0_std", "f0_slope", "voiced", "energy_mean", "energy_std", "energy_slope", "silence_ratio", "pause_count", "longest_pause")},
        "word_rate": F.col("words") / length, "phone_rate": F.col("phones") / length, "articulation_rate": F.col("phones") / F.greatest(F.col("_voiced") * length, F.lit(EPS)),
    }
    return out.select(key, *[F.when(any_frame, _or_zero(c)).otherwise(0.0).alias(n) for n, c in features.items()])


def slot_prosody(frames: DataFrame, slots: DataFrame, key: str, width: float) -> DataFrame:
    """Per slot 17 features, from ``frames`` (``key, time, energy, f0``) and ``slots`` (``key, slot, ls, le, word, phone, stress``).

    A frame counts from a slot's start to its end, both included. A slot without frames has zeros; a null word is a word of
    its own. ``stress`` is 0, 1, 2 or null.
    """
    met = frames_in_slots(frames, slots, key, "time", width, closed=True)
    per = met.groupBy(key, "slot").agg(
        F.count("*").alias("n"), F.count("f0").alias("nv"), F.avg("energy").alias("em"), F.stddev_pop("energy").alias("es"), F.max("energy").alias("ex"), F.avg("f0").alias("fm"), F.stddev_pop("f0").alias("fs"), F.max("f0").alias("fx")
    )
    word = F.when(F.col("word").isNull(), F.struct(F.lit(True), F.col("slot").cast("string"))).otherwise(F.struct(F.lit(False), F.col("word").cast("string")))
    rows = slots.join(per, [key, "slot"], "left").withColumn("_w", word).withColumn("length", F.greatest(F.col("le") - F.col("ls"), F.lit(0.0)))
    own = Window.partitionBy(key, "_w")
    size = F.count("*").over(own)
    around = lambda c: F.avg(_or_zero(F.col(c))).over(own)
    features = {
        "duration": F.col("length"), "energy_mean": F.col("em"), "energy_std": F.col("es"), "energy_max": F.col("ex"), "f0_mean": F.col("fm"), "f0_std": F.col("fs"), "f0_max": F.col("fx"),
        "voiced_ratio": F.try_divide("nv", "n"), "position": (F.row_number().over(own.orderBy("slot")) - 1) / F.greatest(size - 1, F.lit(1)), "word_phones": size,
        "energy_relative": _or_zero(F.col("em")) - around("em"), "duration_relative": F.col("length") / F.greatest(around("length"), F.lit(EPS)), "f0_relative": _or_zero(F.col("fm")) - around("fm"),
        "is_vowel": F.upper(F.substring("phone", 1, 1)).isin(*VOWELS), **{f"stress_{k}": F.col("stress") == k for k in range(3)},
    }
    return rows.select(key, "slot", *[_or_zero(c).alias(n) for n, c in features.items()])


def teacher_targets(manifest: DataFrame, teacher: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Per row of ``manifest`` (``utt, chunk, is_final, idx``): whether the teacher has the row, its scores, and its scores at the utterance's end.

    ``teacher`` (``utt, chunk, status, at``, the scores): of a key's rows with status ``ok`` the last (by ``at``) counts; null scores are 0. The end is the last row
    marked final that the teacher has, or a later row of a higher chunk; without a mark, the first row of the highest chunk.
    """
    known = teacher.where(F.coalesce("status", F.lit("ok")) == "ok").groupBy("utt", "chunk").agg(F.max_by(F.struct(*[_or_zero(F.col(s)).alias(s) for s in scores]), "at").alias("t"))
    rows = manifest.join(known, ["utt", "chunk"], "left")
    seen = rows.where("t IS NOT NULL")
    last = seen.groupBy("utt").agg(F.coalesce(F.max(F.when(F.col("is_final"), F.col("idx"))), F.lit(-1)).alias("from"))
    ends = seen.join(last, "utt").where(F.col("idx") >= F.col("from")).groupBy("utt").agg(F.max_by("t", F.struct(F.col("chunk"), -F.col("idx"))).alias("end"))
    out = rows.join(ends, "utt", "left")
    masked = lambda c, s: F.when(F.col("t").isNotNull(), F.col(c)[s]).otherwise(0.0)
    return out.select("utt", "chunk", "idx", F.col("t").isNotNull().cast("int").alias("mask"), *[masked("t", s).alias(f"prefix_{s}") for s in scores], *[masked("end", s).alias(f"final_{s}") for s in scores])


def open_response(predicted: DataFrame, reference: DataFrame, utts: DataFrame, key: str, scores: Sequence[str], width: float, defaults: Sequence[float] = UNMATCHED) -> DataFrame:
    """``key, branch, place``, and ``pred_*`` and ``gold_*`` of each score: the word pairs that an open response is judged by.

    ``predicted`` and ``reference`` are words (``key, place, text, s, e``, the scores). ``utts`` has ``key, invalid``, the invalid
    rows' own scores, and ``aligned`` (whether the reference has times). An invalid row's scores are set against all reference
    words; equal texts go by place; others by overlap in time, predicted words without one getting ``defaults``; without
    times they are skipped (one row, place null). Predicted words are cut or continued with their last.
    """
    texts = lambda d, n: d.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias(n))
    both = utts.join(texts(predicted, "_p"), key, "left").join(texts(reference, "_g"), key, "left")
    same = F.array_join(F.coalesce("_p", F.array().cast("array<string>")), " ") == F.array_join(F.coalesce("_g", F.array().cast("array<string>")), " ")
    branch = F.when(F.col("invalid"), "invalid").when(same, "equal").when(F.col("aligned"), "interval").otherwise("skip")
    kind = both.select(key, branch.alias("branch"), *[F.col(s).alias(f"_{s}") for s in scores])
    gold = lambda c: [c(s).cast("double").alias(f"gold_{s}") for s in scores]
    pred = lambda c: [c(s).cast("double").alias(f"pred_{s}") for s in scores]

    words = kind.where("branch IN ('invalid', 'equal')").join(reference, key)
    invalid = words.where("branch = 'invalid'").select(key, "branch", "place", *pred(lambda s: F.col(f"_{s}")), *gold(F.col))
    ends = predicted.groupBy(key).agg(F.max_by(F.struct(*scores), "place").alias("_last"))
    own = predicted.select(key, "place", F.struct(*scores).alias("_own"))
    fitted = words.where("branch = 'equal'").join(own, [key, "place"], "left").join(ends, key, "left")
    equal = fitted.select(key, "branch", "place", *pred(lambda s: F.coalesce(F.coalesce("_own", "_last")[s], F.lit(0.0))), *gold(F.col))

    timed = predicted.join(kind.where("branch = 'interval'").select(key), key)
    left = timed.select(key, "place", F.col("s").alias("ls"), F.col("e").alias("le"))
    met = interval_pairs(left, reference.select(key, F.col("s").alias("rs"), F.col("e").alias("re"), *scores), key, width)
    means = met.groupBy(key, "place").agg(*[F.avg(s).alias(f"g_{s}") for s in scores])
    interval = timed.join(means, [key, "place"], "left").select(key, F.lit("interval").alias("branch"), "place", *pred(F.col), *[F.coalesce(f"g_{s}", F.lit(d)).alias(f"gold_{s}") for s, d in zip(scores, defaults, strict=True)])
    nothing = F.lit(None).cast("double")
    skipped = kind.where("branch = 'skip'").select(key, "branch", F.lit(None).cast("int").alias("place"), *pred(lambda s: nothing), *gold(lambda s: nothing))
    return invalid.unionByName(equal).unionByName(interval).unionByName(skipped)


def prefix_rows(rows: DataFrame, text: Column, words: Column, cut: Column) -> DataFrame:
    """Rows with ``target``: the text, or the words joined where it is empty, and the words that end by ``cut`` (``words``: arrays of ``text, end, score``), with their scores, missing ones 0."""
    kept = F.filter(words, lambda w: w["end"] <= cut)
    joined = F.array_join(F.transform(words, lambda w: w["text"]), " ")
    return rows.select("*", F.coalesce(F.nullif(text, F.lit("")), joined).alias("target"), F.array_join(F.transform(kept, lambda w: w["text"]), " ").alias("prefix"), F.transform(kept, lambda w: F.coalesce(w["score"], F.lit(0.0))).alias("scores"))
