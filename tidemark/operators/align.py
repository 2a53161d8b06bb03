"""Order-dependent alignments, as grouped Python operators.

One group is one utterance or prefix; its dynamic program needs it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _growth(a: list[str], b: list[str]) -> list[int]:
    """Bit-parallel lengths: the low t bits of item i have as many ones as the longest common subsequence of ``a[i:]`` and the last t items of ``b``."""
    mask = (1 << len(b)) - 1
    places: dict[str, int] = {}
    for t, w in enumerate(reversed(b)):
        places[w] = places.get(w, 0) | 1 << t
    flat, out = mask, [0]
    for w in reversed(a):
        hit = flat & places.get(w, 0)
        flat = ((flat + hit) | (flat - hit)) & mask
        out.append(flat ^ mask)
    return out[::-1]


def lcs_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence.

    Ties: items of ``a`` are taken in order. One that equals the next free item of ``b`` is paired with it; else it is
    dropped if a longest way remains without it, and otherwise paired with its next occurrence.
    """
    grown, out, free = _growth(a, b), [], 0
    for i, w in enumerate(a):
        if free == len(b):
            break
        rest = (1 << (len(b) - free)) - 1
        if w == b[free] or (grown[i] & rest).bit_count() > (grown[i + 1] & rest).bit_count():
            at = b.index(w, free)
            out.append((i, at))
            free = at + 1
    return out


#: Cells of a table up to which it is filled one by one.
FEW_CELLS = 400


def edit_pairs(a: list[str], b: list[str], mismatch: float = 1.0, bonus: np.ndarray | None = None) -> list[tuple[int | None, int | None]]:
    """A cheapest alignment; a gap is None. ``bonus`` lowers a pair's cost, to 0 at least. Ties: pair, then gap in b, then gap in a.

    Costs are kept for two anti-diagonals, each filled at once (short sequences: a cell at a time); a byte for each cell
    says how it was reached.
    """
    n, m = len(a), len(b)
    codes: dict[str, int] = {}
    x, y = ([codes.setdefault(w, len(codes)) for w in words] for words in (a, b))
    move = _few_moves(x, y, mismatch, bonus) if n * m <= FEW_CELLS else _moves(x, y, mismatch, bonus)
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        k = move[i][j]
        out.append((i - 1 if k != 2 else None, j - 1 if k != 1 else None))
        i, j = i - (k != 2), j - (k != 1)
    return out[::-1]


def _few_moves(x: list[int], y: list[int], mismatch: float, bonus: np.ndarray | None) -> list[list[int]]:
    """``_moves``, a cell at a time: for short sequences calls of NumPy cost more than cells."""
    above, moves = list(range(len(y) + 1)), [[2] * (len(y) + 1)]
    for i, v in enumerate(x):
        now, row = [i + 1], [1]
        for j, w in enumerate(y):
            pair = 0.0 if v == w else mismatch
            if bonus is not None:
                pair = max(0.0, pair - bonus[i, j])
            met, up, left = above[j] + pair, above[j + 1] + 1, now[j] + 1
            if met <= up and met <= left:
                now.append(met)
                row.append(0)
            elif up <= left:
                now.append(up)
                row.append(1)
            else:
                now.append(left)
                row.append(2)
        above = now
        moves.append(row)
    return moves


def _moves(a: list[int], b: list[int], mismatch: float, bonus: np.ndarray | None) -> np.ndarray:
    """How each cell of the table is reached: 0 by a pair, 1 by a gap in b, 2 by a gap in a."""
    n, m = len(a), len(b)
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    move = np.empty((n + 1, m + 1), np.int8)
    move[1:, 0], move[0, 1:] = 1, 2
    two, one = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by place in a, of the diagonals before
    one[0] = 0
    for d in range(1, n + m + 1):
        now = np.full(n + 1, np.inf)
        if d <= m:
            now[0] = d
        if d <= n:
            now[d] = d
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        if len(i):
            j = d - i
            pair = np.where(x[i - 1] == y[j - 1], 0.0, mismatch)
            if bonus is not None:
                pair = np.maximum(0.0, pair - bonus[i - 1, j - 1])
            met, up, left = two[i - 1] + pair, one[i - 1] + 1, one[i] + 1
            now[i] = np.minimum(np.minimum(met, up), left)
            move[i, j] = np.where((met <= up) & (met <= left), 0, np.where(up <= left, 1, 2))
        two, one = one, now
    return move


def viterbi_spans(scores: np.ndarray) -> list[tuple[int, int]] | None:
    """Frames by states: the best monotonic path that stays or advances by one; ``[start, end)`` a state. None if frames are too few."""
    frames, states = scores.shape
    if frames < states or states == 0:
        return None
    best = np.full((frames, states), -np.inf)
    moved = np.zeros((frames, states), bool)
    best[0, 0] = scores[0, 0]
    for t in range(1, frames):
        stay, step = best[t - 1], np.concatenate([[-np.inf], best[t - 1, :-1]])
        moved[t] = step > stay
        best[t] = np.where(moved[t], step, stay) + scores[t]
    path = np.empty(frames, int)
    s = states - 1
    for t in range(frames - 1, -1, -1):
        path[t] = s
        s -= moved[t, s]
    return [(int(np.argmax(path == k)), int(frames - np.argmax(path[::-1] == k))) for k in range(states)]


def _fold(hypotheses: list[tuple[list[int], list[float]]], weights: list[float], phones: int) -> list[dict[int, float]]:
    """The slots of ``confusion_network`` in order, each the mass of the phones that it has; what is missing isn't added yet."""
    order: list[dict[int, float]] = []
    done = 0.0
    for (own, quality), weight in zip(hypotheses, weights, strict=True):
        consensus = [max(s, key=lambda p: (p != phones, s[p], -p)) for s in order]  # noqa: B023
        new_order = []
        for i, j in edit_pairs(consensus, own) if order else zip([None] * len(own), range(len(own)), strict=True):
            slot = order[i] if i is not None else {phones: done}
            new_order.append(slot)
            if j is None:
                slot[phones] = slot.get(phones, 0.0) + weight
            else:
                p, q = own[j], quality[j]
                slot[p] = slot.get(p, 0.0) + weight * q
                slot[phones] = slot.get(phones, 0.0) + weight * (1 - q)
        order, done = new_order, done + weight
    return order


def _posteriors(slots: list[dict[int, float]], totals: np.ndarray, phones: int) -> np.ndarray:
    """Slots by ``phones + 1``: the mass missing to a slot's total goes to the last outcome, and each row sums up to 1."""
    out = np.array([[s.get(p, 0.0) for p in range(phones + 1)] for s in slots]).reshape(len(slots), phones + 1)
    out[:, phones] += np.maximum(0.0, totals - out.sum(1))
    sums = out.sum(1, keepdims=True)
    return np.divide(out, sums, out=np.zeros_like(out), where=sums > 0)


def confusion_network(hypotheses: list[list[tuple[int, float]]], weights: list[float], phones: int) -> np.ndarray:
    """Slots by ``phones + 1`` posteriors (the last: nothing), from weighted hypotheses of ``(phone, quality)``.

    Hypotheses are folded into a consensus in order; each gives its phone ``weight * quality`` and the slot's empty
    outcome the rest; a slot stays the same one, so later insertions don't move earlier mass.
    """
    slots = _fold([([p for p, _ in h], [q for _, q in h]) for h in hypotheses], weights, phones)
    return _posteriors(slots, np.full(len(slots), float(sum(weights))), phones)


def align_rows(df: DataFrame, key: str, a: str, b: str, method: str = "lcs") -> DataFrame:
    """``key, a_pos, b_pos`` of aligned items of the word arrays in columns ``a`` and ``b``; one row of ``df`` is one group."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x, y in zip(pdf[key], pdf[a], pdf[b], strict=True):
                x, y = list(x if x is not None else []), list(y if y is not None else [])
                found = lcs_pairs(x, y) if method == "lcs" else [(i, j) for i, j in edit_pairs(x, y) if i is not None and j is not None]
                rows += [(k, i, j) for i, j in found]
            yield pd.DataFrame(rows, columns=["k", "a_pos", "b_pos"]).rename(columns={"k": key})

    return df.select(key, a, b).mapInPandas(run, f"{key} {kind}, a_pos int, b_pos int")


def edit_distance(a: list[str], b: list[str]) -> int:
    """Between word lists; a row of the usual table at a time."""
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in words], np.int64) for words in (a, b))
    places = np.arange(len(y) + 1)
    row = places
    for i, w in enumerate(x):
        free = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != w))])
        row = np.minimum.accumulate(free - places) + places
    return int(row[-1])


def distance_rows(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, distance, size``: the edit distance of the word arrays in columns ``a`` and ``b``, and the words of ``a``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, edit_distance(list(x), list(y)), len(x)) for k, x, y in zip(pdf[key], pdf[a], pdf[b], strict=True)]
            yield pd.DataFrame(rows, columns=["k", "distance", "size"]).rename(columns={"k": key})

    return df.select(key, F.coalesce(a, F.array()).alias(a), F.coalesce(b, F.array()).alias(b)).mapInPandas(run, f"{key} {kind}, distance long, size long")


def viterbi_rows(df: DataFrame, key: str, scores: str) -> DataFrame:
    """``key, state, start, end`` of the best path through the matrix in column ``scores`` (frames of arrays by state)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, m in zip(pdf[key], pdf[scores], strict=True):
                spans = viterbi_spans(np.array([list(r) for r in m], float)) if m is not None and len(m) else None
                rows += [(k, s, x, y) for s, (x, y) in enumerate(spans or [])]
            yield pd.DataFrame(rows, columns=["k", "state", "start", "end"]).rename(columns={"k": key})

    return df.select(key, scores).mapInPandas(run, f"{key} {kind}, state int, start int, end int")


def confusion_rows(df: DataFrame, key: str, rank: str, hyp: str, quality: str, weight: str, phones: int) -> DataFrame:
    """Per key: slots of posteriors, from its hypotheses in order of ``rank``. A key is one prefix of a few hypotheses."""
    kind = df.schema[key].dataType.simpleString()
    each = F.struct(F.col(rank).alias("rank"), F.col(hyp).cast("array<int>").alias("h"), F.col(quality).cast("array<double>").alias("q"), F.col(weight).cast("double").alias("w"))
    grouped = df.groupBy(key).agg(F.sort_array(F.collect_list(each)).alias("x")).select(key, F.col("x.h").alias("h"), F.col("x.q").alias("q"), F.col("x.w").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hyps, qualities, weights = (batch.column(c) for c in "hqw")
            words, scores = hyps.flatten(), qualities.flatten()
            ids, marks = words.flatten(), scores.flatten()
            size = words.value_lengths()
            if size != scores.value_lengths() or hyps.value_lengths() != qualities.value_lengths() or ids.null_count or size.null_count:
                raise ValueError("a hypothesis needs a phone and a quality at each place")
            ids, marks, each = ids.to_pylist(), marks.to_numpy(zero_copy_only=False).tolist(), weights.flatten().to_numpy(zero_copy_only=False).tolist()
            ends = np.cumsum([0, *size.to_pylist()]).tolist()
            slots, counts, totals, begin = [], [], [], 0
            for n in hyps.value_lengths().to_pylist():
                w = each[begin : begin + n]
                of = [(ids[x:y], marks[x:y]) for x, y in zip(ends[begin : begin + n], ends[begin + 1 : begin + n + 1], strict=True)]
                found = _fold(of, w, phones)
                slots += found
                counts.append(len(found))
                totals.append(float(sum(w)))
                begin += n
            # arrays for all keys of a batch: made for each, they would cost more than its slots
            counts = np.array(counts, np.int64)
            at = np.repeat(np.arange(len(counts)), counts)
            values = _posteriors(slots, np.array(totals)[at], phones)
            places = np.arange(len(slots)) - np.repeat(np.cumsum(counts) - counts, counts)
            posterior = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, phones + 1), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(places, pa.int32()), posterior], [key, "slot", "posterior"])

    return grouped.mapInArrow(run, f"{key} {kind}, slot int, posterior array<double>")
