"""Numeric helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerances of time, progress bins, and the test for the end.
TIME_EPS, BIN_EPS, FINAL_EPS = 1e-6, 1e-9, 1e-5
# Lower bounds of the bands, from the best down.
PHONE_BANDS = (1.7, 1.1, 0.5)
WORD_BANDS = (9.0, 7.0, 4.0, 2.0)
STRESS_BANDS = (7.5,)
UTTERANCE_BANDS = (9.0, 7.0, 5.0, 3.0)
FLUENCY_BANDS = (8.0, 6.0, 4.0)
PROSODY_BANDS = (9.0, 7.0, 5.0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def safe_float(x: Column) -> Column:
    """A finite number, else null."""
    d = x.try_cast("double")
    return F.when(finite(d), d)


def grid_score(x: Column, floor: float) -> Column:
    """Clipped to [0, 2] and rounded half-even to multiples of ``floor``."""
    return F.bround(F.least(F.greatest(x, F.lit(0.0)), F.lit(2.0)) / floor) * floor


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def band(score: Column, bounds: Sequence[float]) -> Column:
    """The index of the first bound that ``score`` reaches; their number if none."""
    out = F.when(score >= bounds[0], 0)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(score >= b, i)
    return out.otherwise(len(bounds))


def mean_or(values: Column, default: float) -> Column:
    """The mean of an array's numbers; ``default`` without any."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), F.size(kept)), F.lit(default))


def fit_length(values: Column, n: int, fill: Column) -> Column:
    """Cut or filled up to ``n`` items."""
    return F.slice(F.concat(values, F.array_repeat(fill, n)), 1, n)


def frame_bounds(start: Column, end: Column, step: float) -> tuple[Column, Column]:
    """First frame and end frame, at least one frame apart."""
    a = F.floor(start / step)
    return a, F.greatest(F.ceil(end / step), a + 1)


def uniform_segments(n: Column, duration: Column) -> Column:
    """``n`` equal parts of ``duration``; the last ends there."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((i * duration / n).alias("start"), F.least(duration, (i + 1) * duration / n).alias("end")))
    return F.when(n > 0, parts).otherwise(F.slice(parts, 1, 0))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of intervals; 0 if something is missing or the union is empty."""
    inter = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))
    union = F.greatest(e1, e2) - F.least(s1, s2)
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known & (union > 0), F.try_divide(inter, union)).otherwise(0.0)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))


def smooth_l1(d: Column, beta: float = 0.05) -> Column:
    a = F.abs(d)
    return F.when(a < beta, 0.5 * a * a / beta).otherwise(a - 0.5 * beta)


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def supervision_weight(original: Column, posterior: Column, acoustic: Column, relaxed: bool) -> Column:
    """The weight of a slot: the given one, or when that is 0 and the policy relaxed, the better share of the evidence."""
    return F.when(original > 0, original).otherwise(F.greatest(0.2 * posterior, 0.2 * acoustic)) if relaxed else original


def rounded(value: Column, digits: int) -> Column:
    """As DuckDB rounds a double: scaled by a power of ten, rounded half away from zero, scaled back.

    Spark's ``round`` goes by the decimal digits instead, so that 2.7009374999999998 to 6 digits gives 2.700937, not 2.700938.
    """
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale
