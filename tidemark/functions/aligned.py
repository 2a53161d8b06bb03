"""Edit alignment of two arrays as a column expression, and what is derived from it for each slot.

The table of costs is filled by anti-diagonals: no cell of one depends on another of the same, so each is one ``transform``
of the two before it. Moves are kept a diagonal at a time and followed back from the end. A table has size(a) + 1 times
size(b) + 1 cells, so this is for sequences of some hundreds of items; ``operators.align`` has forms for longer ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Costs of a gap and of a mismatch, and what overlap in time and confidence take off a pair's cost.
GAP, MISMATCH, OVERLAP_REWARD, CONFIDENCE_REWARD = 1.0, 1.0, 0.3, 0.1
#: Bounds below or above which a committed slot abstains.
WEAK_LABEL, UNSURE, DIVERGENT, UNSUPPORTED = 0.05, 0.75, 0.35, 0.2

_FAR = 1e18
_PAIRS = "array<struct<a:int,b:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _upto(n: Column, first: int) -> Column:
    """``first`` to n, or nothing."""
    return F.when(n >= first, F.sequence(F.lit(first), n)).otherwise(F.array().cast("array<int>"))


def edit_alignment(a: Column, b: Column, mismatch: float = MISMATCH, reward: Callable[[Column, Column], Column] | None = None) -> Column:
    """``struct(cost, pairs)``: a cheapest alignment, with places from 0 and null for a gap.

    ``reward(i, j)`` lowers the cost of pairing two places, to 0 at least. Ties prefer a pair, then a gap in ``b``, then one
    in ``a``; two gaps tie by the costs before them. Null arrays are empty; null items equal nothing.
    """
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a.cast("array<string>"), b.cast("array<string>")))
    return _let(F.struct(a.alias("a"), b.alias("b"), F.size(a).alias("n"), F.size(b).alias("m")), lambda x: _aligned(x, mismatch, reward))


def _aligned(x: Column, mismatch: float, reward: Callable[[Column, Column], Column] | None) -> Column:
    """``edit_alignment`` of ``struct(a, b, n, m)``. What a lambda names is computed again for each item, so only bound values are named."""
    n, m = x["n"], x["m"]
    way = lambda cost, move: F.struct(cost.alias("cost"), move.alias("move"))
    far = F.lit(_FAR)

    def cell(d: Column, one: Column, two: Column, i: Column) -> Column:
        j = d - i
        pair = F.when(F.coalesce(F.get(x["a"], i - 1) == F.get(x["b"], j - 1), F.lit(False)), F.lit(0.0)).otherwise(F.lit(mismatch))
        if reward is not None:
            pair = F.greatest(pair - F.coalesce(reward(i - 1, j - 1), F.lit(0.0)), F.lit(0.0))
        met = F.when((i > 0) & (j > 0), F.get(two, i - 1) + pair).otherwise(far)
        up, left = F.coalesce(F.get(one, i - 1), far), F.coalesce(F.get(one, i), far)
        gap = way(F.least(up, left) + GAP, F.when(up <= left, 1).otherwise(2))  # compared before the sum, which rounds
        return F.when((j >= 0) & (j <= m), F.least(way(met, F.lit(0)), gap)).otherwise(way(far, F.lit(0)))

    start = F.struct(F.array_repeat(far, n + 1).alias("two"), F.concat(F.array(F.lit(0.0)), F.array_repeat(far, n)).alias("one"), F.array().cast("array<array<int>>").alias("moves"))

    def diagonal(s: Column, d: Column) -> Column:
        cells = F.transform(F.sequence(F.lit(0), n), lambda i: cell(d, s["one"], s["two"], i))
        return _let(cells, lambda c: F.struct(s["one"].alias("two"), c["cost"].alias("one"), F.concat(s["moves"], F.array(c["move"])).alias("moves")))

    def back(moves: Column) -> Column:
        begin = F.struct(n.alias("i"), m.alias("j"), F.array().cast(_PAIRS).alias("pairs"))

        def step(s: Column, _: Column) -> Column:
            i, j = s["i"], s["j"]

            def moved(move: Column) -> Column:
                pair = F.struct(F.when(move != 2, i - 1).alias("a"), F.when(move != 1, j - 1).alias("b"))
                return F.struct((i - F.when(move != 2, 1).otherwise(0)).alias("i"), (j - F.when(move != 1, 1).otherwise(0)).alias("j"), F.concat(s["pairs"], F.array(pair)).alias("pairs"))

            return F.when(i + j == 0, s).otherwise(_let(F.get(F.get(moves, i + j - 1), i), moved))

        return F.reverse(F.aggregate(_upto(n + m, 1), begin, step)["pairs"])

    table = F.aggregate(_upto(n + m, 1), start, diagonal)
    return _let(table, lambda t: F.struct(F.get(t["one"], n).alias("cost"), back(t["moves"]).alias("pairs")))


def overlap_and_confidence(a_times: Column, b_times: Column, confidence: Column, overlap_reward: float = OVERLAP_REWARD) -> Callable[[Column, Column], Column]:
    """A reward by the overlap of two intervals (structs of ``start, end``), as intersection over union, and the second's confidence."""

    def shared(t: Column) -> Column:
        x, y = t["x"], t["y"]
        both = F.greatest(F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]), F.lit(0.0))
        whole = F.greatest(x["end"], y["end"]) - F.least(x["start"], y["start"])
        return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))

    def reward(i: Column, j: Column) -> Column:
        share = _let(F.struct(F.get(a_times, i).alias("x"), F.get(b_times, j).alias("y")), shared)
        sure = F.least(F.greatest(F.get(confidence, j), F.lit(0.0)), F.lit(1.0))
        return F.coalesce(share, F.lit(0.0)) * overlap_reward + F.coalesce(sure, F.lit(0.0)) * CONFIDENCE_REWARD

    return reward


def partners(pairs: Column) -> Column:
    """For each place of the second sequence its partner's place in the first, or null; an alignment has each place once, in order."""
    return F.transform(F.filter(pairs, lambda p: p["b"].isNotNull()), lambda p: p["a"])


def slot_targets(truth: Column, slots: Column, phones: list[str], seen_words: Column) -> Column:
    """For each slot a struct of training targets, from the truth that is aligned to it.

    ``truth``: structs ``phone, phone_score, word_id, accuracy, stress, total``. ``slots``: structs ``phone`` (null: none),
    ``posterior`` and ``support`` (arrays by phone), ``divergence``, ``committed``. ``seen_words``: ids of words that some
    hypothesis has. A slot without truth, or with a phone that isn't in ``phones``, has scores of -1 and weights of 0.
    """
    listed = F.array(*[F.lit(p) for p in phones])
    names = F.transform(slots, lambda s: F.coalesce(s["phone"], F.lit("<eps>")))
    of = partners(edit_alignment(F.transform(truth, lambda t: t["phone"]), names)["pairs"])

    def entropy(p: Column) -> Column:
        return -F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda acc, x: acc + x * F.ln(x)) / F.ln(F.greatest(F.size(p), F.lit(2)).cast("double"))

    def target(s: Column, t: Column) -> Column:
        phone = F.array_position(listed, t["phone"]).cast("int") - 1
        exact = F.coalesce(s["phone"] == t["phone"], F.lit(False))
        facts = F.struct(phone.alias("phone"), F.array_contains(seen_words, t["word_id"]).alias("seen"), exact.alias("exact"), entropy(s["posterior"]).alias("entropy"))
        return _let(facts, lambda f: weighed(s, t, f))

    def weighed(s: Column, t: Column, f: Column) -> Column:
        likely = F.get(s["posterior"], f["phone"])
        done = s["committed"] & f["seen"]
        weight = F.when(done & f["exact"], 1.0).when(done & (likely > 0), likely).otherwise(0.0)
        return _let(weight, lambda w: fields(s, t, f, w))

    def fields(s: Column, t: Column, f: Column, weight: Column) -> Column:
        phone, seen, exact, done = f["phone"], f["seen"], f["exact"], s["committed"]
        known = t.isNotNull() & (phone >= 0)
        unsure = F.least(F.greatest(f["entropy"], F.lit(0.0)), F.lit(1.0))
        support = F.get(s["support"], phone)
        no, yes = F.lit(0.0), F.lit(1.0)
        flag = lambda c: F.when(c, yes).otherwise(no)
        when = lambda value, other: F.when(known, value.cast("double")).otherwise(F.lit(other))
        abstains = ~seen | (weight < WEAK_LABEL) | ((f["entropy"] > UNSURE) & (s["divergence"] > DIVERGENT)) | (~exact & (support < UNSUPPORTED))
        return F.struct(
            when(phone, -1.0).alias("phone_id"),
            when(t["phone_score"], -1.0).alias("phone_score"),
            when(t["accuracy"], -1.0).alias("word_accuracy"),
            when(t["stress"], -1.0).alias("word_stress"),
            when(t["total"], -1.0).alias("word_total"),
            when(t["word_id"], -1.0).alias("word_id"),
            when(flag(exact & seen), 0.0).alias("asr_correct"),
            when(F.when(seen, unsure).otherwise(yes), 1.0).alias("uncertainty"),
            when(weight, 0.0).alias("soft_label_weight"),
            when(F.when(done, F.least(F.greatest(weight * (yes - unsure) * support, no), yes)).otherwise(no), 0.0).alias("confidence"),
            when(flag(done & seen), 0.0).alias("confidence_mask"),
            when(flag(done & abstains), 0.0).alias("abstention"),
            when(flag(done), 0.0).alias("abstention_mask"),
        )

    both = F.transform(of, lambda g, k: F.struct(F.get(slots, k).alias("s"), F.when(g.isNotNull(), F.get(truth, g)).alias("t")))
    return F.transform(both, lambda p: target(p["s"], p["t"]))
