"""Functions of numeric arrays, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def softmax(logits: Column) -> Column:
    """Stable; equal shares of +inf take all, -inf counts as 50 below the least finite value, all non-finite is uniform."""
    top = F.lit(float("inf"))
    is_finite = lambda x: F.abs(x) < top
    least = F.array_min(F.filter(logits, is_finite))
    filled = F.transform(logits, lambda x: F.when(is_finite(x), x).otherwise(least - 50))
    exps = F.transform(filled, lambda x: F.exp(x - F.array_max(filled)))
    plain = F.transform(exps, lambda x: x / total(exps))
    hot = F.size(F.filter(logits, lambda x: x == top))
    shares = F.transform(logits, lambda x: F.when(x == top, 1.0 / F.greatest(hot, F.lit(1))).otherwise(0.0))
    uniform = F.transform(logits, lambda x: F.lit(1.0) / F.size(logits))
    return F.when(hot > 0, shares).when(least.isNull(), uniform).otherwise(plain)


def plain_softmax(logits: Column) -> Column:
    """For finite values. Pass a column, not a long expression: it is named three times."""
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.get(F.transform(F.array(exps), lambda e: F.transform(e, lambda x: x / total(e))), F.lit(0))


def entropy(p: Column) -> Column:
    return -total(F.transform(F.filter(p, lambda x: x > 0), lambda x: x * F.log(F.greatest(x, F.lit(EPS)))))


def normalized(p: Column) -> Column:
    """Clipped from below, then adding up to 1."""
    clipped = F.transform(p, lambda x: F.greatest(x, F.lit(EPS)))
    return F.get(F.transform(F.array(clipped), lambda c: F.transform(c, lambda x: x / total(c))), F.lit(0))


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon, natural logarithm, of arrays that add up to 1."""
    mid = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    kl = lambda a: total(F.zip_with(a, mid, lambda x, m: x * F.log(x / m)))
    return 0.5 * kl(p) + 0.5 * kl(q)


def top_and_margin(p: Column) -> tuple[Column, Column]:
    s = F.sort_array(p, asc=False)
    return F.get(s, F.lit(0)), F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def argmax(p: Column) -> Column:
    """Index of the first maximum."""
    return F.array_position(p, F.array_max(p)) - 1


def one_hot(p: Column) -> Column:
    return F.transform(p, lambda x, i: F.when(i == argmax(p), 1.0).otherwise(0.0))


def mean_by_place(a: Column, size: int) -> Column:
    """An aggregate: the mean of each of the first ``size`` items over the rows; partial sums are one row a task and group."""
    return F.array(*[F.avg(F.get(a, F.lit(i))) for i in range(size)])


def masked_mean(values: Column, mask: Column) -> Column:
    return total(F.zip_with(values, mask, lambda v, m: v * m)) / F.greatest(total(mask), F.lit(1.0))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading items are equal."""
    n = F.least(F.size(a), F.size(b))
    first = F.array_position(F.transform(F.sequence(F.lit(0), n), lambda i: (i == n) | ~F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))), True)
    return first - 1


def has_cycle(tokens: Column, repeats: int = 4, longest: int = 12) -> Column:
    """Whether some run of 1 to ``longest`` items comes ``repeats`` times in a row."""

    def at(n: Column) -> Column:
        starts = F.size(tokens) - n * repeats
        cell = lambda s: F.forall(F.sequence(F.lit(1), F.lit(repeats - 1)), lambda k: F.slice(tokens, s + 1 + k * n, n) == F.slice(tokens, s + 1, n))
        return (starts >= 0) & F.exists(F.sequence(F.lit(0), F.greatest(starts, F.lit(0))), cell)

    return F.exists(F.sequence(F.lit(1), F.lit(longest)), at)
